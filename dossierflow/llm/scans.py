"""Text of scanned pages repaired into continuous paragraphs.

Blocks of a page are labelled header, body, break (titles, table cells) or
footer by a hidden Markov model over layout features. Its probabilities start
from a rough guess and are learned from all pages: the most likely labels are
counted and the counts become the next probabilities. The words of the bodies are
then read as one stream across lines, blocks and pages: halves of cut words are
joined, torn words closed and misread words corrected against the vocabulary of
the whole corpus, by undoing confusions of shapes.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import bounded
from ..session import discard, materialize, ship_package

#: Blocks of a document that are read together, and neighbours on either side that give them context.
RUN, MARGIN = 1024, 24

#: How often a word must stand at least to belong to the vocabulary, and how many of its words, the most frequent, every task holds (about 60 MB). The others are asked for, run by run.
LEAST_COUNT, MOST_HELD = 3, 500_000

#: Passes over all pages that learn the model, and how many blocks its first guess counts as.
ROUNDS, GUESS = 2, 500.0

#: Lengths of beginnings that a misread word must share with some word of the vocabulary.
HEADS = (3, 5, 8, 12)

#: Bits of the filter that tells which words the rest of a huge vocabulary may hold (16 MB).
FILTER_BITS = 1 << 27

#: A word is taken for a misreading if its correction is this many times as frequent.
DOMINANCE = 12

# Shapes that recognition confuses, as printed by it -> as they stood on the page.
CONFUSED = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("c", "e"), ("o", "a"), ("b", "h"), ("f", "t"),
    ("ri", "n"), ("r1", "n"), ("rn", "m"), ("cl", "d"), ("c1", "d"), ("ii", "u"), ("1i", "u"), ("i1", "u"), ("11", "u"), ("vv", "w"), ("l", "i"), ("d", "cl"), ("m", "rn"),
)

_HYPHENS = "-‐‑¬­"
_MARKS = frozenset("|~*.·•¦'`,_^")
_PUNCT = ".,;:!?()[]{}\"“”„«»‘’'`|~*"
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_PLAIN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15, "xvi": 16, "xvii": 17, "xviii": 18, "xix": 19, "xx": 20}

STATES = ("header", "body", "break", "footer")
HEADER, BODY, BREAK, FOOTER = range(4)


def _log(*p: float) -> tuple[float, ...]:
    return tuple(math.log(x) for x in p)


class Layout:
    """Log probabilities of the page model: what a page opens and closes with, what follows what, and the features of a block in each state."""

    def __init__(self) -> None:
        """First guess."""
        self.opens = _log(0.5, 0.4, 0.09, 0.01)
        self.closes = _log(0.02, 0.45, 0.03, 0.5)
        self.moves = (_log(0.02, 0.8, 0.16, 0.02), _log(0.0001, 0.8, 0.08, 0.12), _log(0.0005, 0.85, 0.1, 0.05), _log(0.001, 0.004, 0.005, 0.01))
        # Form of the block: its page's number alone, another number alone, short with digits, short with rules or gaps, capitals, running text.
        self.forms = {
            "page": _log(0.1, 0.0003, 0.02, 0.35), "number": _log(0.002, 0.0005, 0.3, 0.002), "digits": _log(0.45, 0.01, 0.04, 0.55),
            "ruled": _log(0.25, 0.004, 0.03, 0.05), "capitals": _log(0.02, 0.003, 0.5, 0.01), "text": _log(0.0004, 0.97, 0.1, 0.0004),
        }
        self.places = {"first": _log(0.96, 0.3, 0.3, 0.02), "middle": _log(0.02, 0.4, 0.5, 0.02), "last": _log(0.02, 0.3, 0.2, 0.96)}
        self.places["only"] = tuple(map(max, self.places["first"], self.places["last"]))
        self.repeated = {False: _log(0.25, 0.97, 0.9, 0.25), True: _log(0.75, 0.03, 0.1, 0.75)}
        self.flags = {"h": _log(0.6, 0.08, 0.15, 0.15), "f": _log(0.1, 0.08, 0.15, 0.6), "": _log(0.3, 0.84, 0.7, 0.25)}

    def emit(self, seen: tuple[str, str, bool, str]) -> list[float]:
        """Log probability of a block's features in each state."""
        return [sum(x) for x in zip(self.forms[seen[0]], self.places[seen[1]], self.repeated[seen[2]], self.flags[seen[3]])]

    def label(self, page: list[tuple[str, str, bool, str]]) -> list[int]:
        """Most likely states of the blocks of one page (Viterbi)."""
        emits = [self.emit(seen) for seen in page]
        best = [o + e for o, e in zip(self.opens, emits[0])]
        back: list[list[int]] = []
        for emit in emits[1:]:
            link = [max(range(4), key=lambda q, s=s: best[q] + self.moves[q][s]) for s in range(4)]
            best = [best[q] + self.moves[q][s] + emit[s] for s, q in enumerate(link)]
            back.append(link)
        s = max(range(4), key=lambda q: best[q] + self.closes[q])
        path = [s]
        for link in reversed(back):
            s = link[s]
            path.append(s)
        return path[::-1]

    def learned(self, counts: dict[tuple[str, str, int], int], guess: float = GUESS) -> Layout:
        """The model of counted labels, ``(what, value, state) -> n``, this one counting as ``guess`` blocks in each state."""
        new = Layout()

        def weigh(what: str, table: dict) -> dict:
            n = {v: [counts.get((what, str(v), s), 0) + guess * math.exp(p[s]) for s in range(4)] for v, p in table.items()}
            sums = [sum(x[s] for x in n.values()) for s in range(4)]
            return {v: tuple(math.log(x[s] / sums[s]) for s in range(4)) for v, x in n.items()}

        new.forms, new.places, new.repeated, new.flags = (weigh(*x) for x in (("form", self.forms), ("place", self.places), ("repeated", self.repeated), ("flag", self.flags)))
        ends = lambda what, old: [counts.get((what, "", s), 0) + guess * math.exp(old[s]) for s in range(4)]
        opens, closes = ends("open", self.opens), ends("close", self.closes)
        new.opens = tuple(math.log(x / sum(opens)) for x in opens)
        # After each block comes another or the end of the page.
        own = lambda what, state: sum(n for (w, _, s), n in counts.items() if w == what and s == state)
        total = [own("form", s) + guess for s in range(4)]
        new.closes = tuple(math.log(x / n) for x, n in zip(closes, total))
        new.moves = tuple(tuple(math.log((counts.get(("move", str(q), s), 0) + guess * math.exp(self.moves[q][s])) / total[q]) for s in range(4)) for q in range(4))
        return new


def form(text: str, page: int | None, repeated: bool = False) -> str:
    """Form of a block for the emission of the model; a long line is running text unless it is repeated."""
    t = text.strip()
    bare = t.strip("-–— .[]()|~*").lower()
    if bare in _ROMAN or bare.isdigit():
        value = _ROMAN.get(bare) or int(bare)
        return "page" if page is not None and value == page else "number"
    if len(t) > 70 and not repeated or "\n" in t or t[-1:] in ".?!…,;\"”" or t[:1] in "[(<{‹*":
        return "text"
    if sum(w.isalpha() and w.islower() for w in t.split()) >= 4 or re.search(r"[\[({<‹*][^\W\d_].*[\])}>›*]", t):
        return "text"
    if re.search(r"\d", t) and not re.search(r"\d[a-z]?,?\s+[A-ZÀ-Þ][a-zß-ÿ]+ (?:St|Street|Road|Rd|Lane|Close|Way|Ave|Avenue|Terrace|Crescent)\b", t):
        return "digits"
    if re.search(r"\s{2,}|—| / ", t):
        return "ruled"
    letters = [c for c in t if c.isalpha()]
    if letters and sum(c.isupper() for c in letters) >= 0.8 * len(letters) and len(letters) > 3:
        return "capitals"
    return "text"


def key(text: str) -> str:
    """Text of a running header without what changes from page to page or is misread."""
    t = re.sub(r"\d+", "#", text.strip().lower().translate(str.maketrans("091568", "oolsbb")) if text.strip().isalpha() else text.strip().lower())
    words = ["#" if w in _ROMAN else w for w in t.split()]
    return " ".join(words).replace("f", "e").replace("o", "a").replace("c", "a").replace("e", "a").replace("l", "i")


def features(blocks: list[tuple[str, str, bool]], page: int | None) -> list[tuple[str, str, bool, str]]:
    """Form, place, repetition and flag of the blocks of one page. A block is (text, flag, repeated)."""
    last = len(blocks) - 1
    out = []
    for i, (text, flag, repeated) in enumerate(blocks):
        kind = form(text, page, repeated)
        out.append((kind, "only" if not last else "first" if not i else "last" if i == last else "middle", repeated and kind != "number", flag))
    return out


def label_page(blocks: list[tuple[str, str, bool]], page: int | None, layout: Layout | None = None) -> list[int]:
    """States of the blocks of one page."""
    return (layout or Layout()).label(features(blocks, page))


class Filter:
    """Which words and beginnings a huge vocabulary may hold: false alarms only cost a question."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, np.uint8)

    @staticmethod
    def places(text: str, size: int) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(text)
        return h % size, (h >> 64) % size

    def __contains__(self, text: str) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self.places(text, 8 * len(self.bits)))


class Speller:
    """Vocabulary with counts, and the corrections it leads to.

    ``rest`` tells what else the vocabulary may hold. With ``asking`` all words of
    the rest that a decision may need gather in ``asked``; their counts then come
    back as ``answers``.
    """

    def __init__(self, counts: dict[str, int], rest: Filter | None = None, asking: bool = False) -> None:
        self.counts, self.rest, self.asking = counts, rest, asking
        self.known: dict[str, str | None] = {}
        self.answers: dict[str, int] = {}
        self.asked: set[str] = set()
        self.heads = {w[:n] for w in counts for n in HEADS if len(w) >= n}
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for seen, meant in CONFUSED:
            self.rules.setdefault(seen[0], []).append((seen, meant))

    def count(self, word: str) -> int:
        """How often a word stands in the corpus; 0 if it is none of the vocabulary."""
        n = self.counts.get(word)
        if n is None and self.rest is not None:
            n = self.answers.get(word)
            if n is None and self.asking and word in self.rest:
                self.asked.add(word)
        return n or 0

    def correct(self, word: str) -> str | None:
        """The word itself if it is right, its correction, or None if neither is known."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = self._correct(word)
        return self.known[word]

    def good(self, word: str) -> bool:
        return self.correct(word) == word

    def _begins(self, text: str, n: int) -> bool:
        """Whether some word of the vocabulary may begin as the ``n`` first letters of ``text``."""
        size = max((k for k in HEADS if k <= n), default=0)
        return not size or text[:size] in self.heads or self.rest is not None and "^" + text[:size] in self.rest

    def _correct(self, word: str) -> str | None:
        own = self.count(word)
        found: list[tuple[int, int, str]] = []
        layer = {(word, 0)}
        seen = {word}
        for edits in range(1, 5):
            following = set()
            for text, start in layer:
                for i in range(start, len(text)):
                    if i in HEADS and not self._begins(text, i):
                        break  # what stands before i stays as it is
                    for shape, meant in self.rules.get(text[i], ()):
                        if text.startswith(shape, i) and (shape != "l" or i == 0):
                            new = text[:i] + meant + text[i + len(shape) :]
                            if new not in seen and self._begins(new, i + len(meant)):
                                seen.add(new)
                                following.add((new, i + len(meant)))
            for new, _ in following:
                n = self.count(new)
                if n and n >= DOMINANCE * own and not any(c.isdigit() for c in new):
                    new = self.correct(new) or new  # it may itself be a frequent misreading
                    found.append((edits, -self.count(new), new))
                elif self.asking and new in self.asked:
                    self.correct(new)
            if found:
                break
            layer = following
        if own and not found:
            return word
        return min(found, key=lambda x: (x[1], x[0], x[2]))[2] if found else None


def _bare(token: str) -> str:
    return token.strip(_PUNCT).lower().replace("’", "'").removesuffix("'s")


def _ending(token: str) -> str:
    """Punctuation at the end of a token."""
    return token[len(token.rstrip(_PUNCT)) :]


def repairs(bodies: list[tuple[int, str]], speller: Speller) -> tuple[list[tuple[int, str]], list[str]]:
    """Repaired words (index of the block where each begins, word), and the words of the paragraph stream.

    ``bodies``: (index of block, text) in reading order.
    """
    tokens: list[tuple[int, str, bool]] = []  # block, token, last of its line
    for index, text in bodies:
        for line in text.split("\n"):
            parts = [t for t in line.split() if not (len(t) == 1 and t in _MARKS)]
            for k, t in enumerate(parts):
                tokens.append((index, t, k == len(parts) - 1))
    out: list[tuple[int, str]] = []
    stream: list[str] = []
    i, n = 0, len(tokens)
    correct = speller.correct
    if speller.asking:
        # Whatever the answers will be: every word, every two neighbours as one, and every word cut by a hyphen.
        for (_, token, _), (_, tail, _) in zip(tokens, [*tokens[1:], (0, "", True)]):
            for w in {_bare(token), _bare(token) + _bare(tail), _bare(token[:-1].lstrip(_PUNCT) + tail), _bare(f"{token[:-1].lstrip(_PUNCT)}-{tail}")}:
                if _WORD.fullmatch(w):
                    correct(w)
        return [], []
    while i < n:
        index, token, last = tokens[i]
        if last and len(token) > 1 and token[-1] in _HYPHENS and i + 1 < n:
            head, tail = token[:-1].lstrip(_PUNCT), tokens[i + 1][1]
            whole = _bare(head + tail)
            if _WORD.fullmatch(whole) and _WORD.fullmatch(_bare(head) or "-"):
                solid, split = correct(whole), correct(_bare(f"{head}-{tail}"))
                pick = solid
                if split and (not solid or speller.count(split) > speller.count(solid)):
                    pick = split
                if pick:
                    out.append((index, pick))
                    stream.append(pick + _ending(tail))
                    i += 2
                    continue
        word = _bare(token)
        # A capital inside a sentence is a name: names have no vocabulary to be held against.
        if not word or token[0].isupper() and stream and not stream[-1].endswith((".", "?", "!")) and not any(c.isdigit() for c in token):
            stream.append(token)
            i += 1
            continue
        counts = speller.count(word)
        fixed = word if counts and speller.good(word) else None
        # Torn apart: this piece and the next make one word, and one of them alone is none, or hardly ever stands alone.
        if i + 1 < n and token[-1] not in _PUNCT:
            tail = tokens[i + 1][1]
            after = _bare(tail)
            if after and _WORD.fullmatch(word) and _WORD.fullmatch(after) and not tail[0].isupper() and not (word.isdigit() or after.isdigit()):
                joined = correct(word + after)
                rarer = min(counts, speller.count(after))
                if joined and (rarer * DOMINANCE <= speller.count(joined) if joined == word + after else _closer(word, after, joined, speller)):
                    out.append((index, joined))
                    stream.append(joined + _ending(tail))
                    i += 2
                    continue
        if fixed is None and _WORD.fullmatch(word) and len(word) > 1 and not word.isdigit():
            pick = correct(word)
            # House numbers and the like are no words, and a short known one before a capital is a first name.
            named = token[0].isupper() and len(word) <= 3 and counts > 0 and i + 1 < n and tokens[i + 1][1][0].isupper()
            if pick and pick != word and not named and 2 * sum(map(str.isalpha, word)) >= len(word):
                out.append((index, pick))
                stream.append(token.lower().replace(word, pick))
                i += 1
                continue
        stream.append(token)
        i += 1
    return out, stream


def _closer(word: str, after: str, joined: str, speller: Speller) -> bool:
    """Whether joining and correcting explains two pieces, as correcting each of them doesn't."""
    return speller.correct(word) is None or speller.correct(after) is None


def _pages(blocks: list[tuple[int, str, int | None, str | None, str, bool]]) -> Iterator[tuple[list[int], list[tuple[str, str, bool, str]]]]:
    """Indices of the blocks with text of each page, and their features."""
    keys = [key(b[3]) if b[3] and "\n" not in b[3] else None for b in blocks]
    repeats = Counter(k for k, _ in {(k, b[2]) for k, b in zip(keys, blocks) if k is not None})
    i = 0
    while i < len(blocks):
        j = i
        while j < len(blocks) and blocks[j][2] == blocks[i][2]:
            j += 1
        page = [k for k in range(i, j) if blocks[k][3] and blocks[k][3].strip()]
        if page:
            yield page, features([(blocks[k][3], blocks[k][4], repeats[keys[k]] > 1) for k in page], blocks[i][2])
        i = j


def read_run(blocks: list[tuple[int, str, int | None, str | None, str, bool]], speller: Speller, layout: Layout, scanned: bool) -> tuple[list[tuple[str, str, str]], str]:
    """Rows (block_id, kind, word) of a run, and its repaired text if the document is ``scanned``.

    A block is (ord, block_id, page, text, flag, own); blocks that aren't ``own``
    only give context.
    """
    rows: list[tuple[str, str, str]] = []
    bodies: list[tuple[int, str]] = []
    for page, seen in _pages(blocks):
        for k, s in zip(page, layout.label(seen)):
            if s in (HEADER, FOOTER) and blocks[k][5]:
                rows.append((blocks[k][1], STATES[s], ""))
            elif s == BODY:
                bodies.append((k, blocks[k][3]))
    text = ""
    if scanned:
        found, stream = repairs(bodies, speller)
        rows += [(blocks[k][1], "word", w) for k, w in found if blocks[k][5]]
        text = " ".join(stream)
    return rows, text


def _page_kinds(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Features of a task's pages as text, with the number of pages that look so."""
    total: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["page", "n"])
        total.clear()
        return rows

    for batch in bounded(batches):
        for _, blocks, _ in _blocks(batch, size):
            for page, seen in _pages(blocks):
                if blocks[page[0]][5]:  # else counted with its own run
                    total[";".join(f"{kind},{place},{repeated},{flag}" for kind, place, repeated, flag in seen)] += 1
        if len(total) > 100_000:
            yield flush()
    yield flush()


def _tally(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Counts of the labels of pages by what they stand with."""
    total: Counter[tuple[str, str, int]] = Counter()
    for batch in bounded(batches):
        for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = [(kind, place, repeated == "True", flag) for kind, place, repeated, flag in (x.split(",") for x in text.split(";"))]
            states = layout.label(seen)
            total["open", "", states[0]] += n
            total["close", "", states[-1]] += n
            for (kind, place, repeated, flag), s in zip(seen, states):
                total["form", kind, s] += n
                total["place", place, s] += n
                total["repeated", str(repeated), s] += n
                total["flag", flag, s] += n
            for q, s in zip(states, states[1:]):
                total["move", str(q), s] += n
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([k[2] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["what", "value", "state", "n"])


def learn(runs: DataFrame, rounds: int = ROUNDS, size: int = RUN) -> Layout:
    """The page model of all pages, by ``rounds`` of labelling and counting.

    Pages that look alike are counted once; the counts of labels are a few dozen
    rows.
    """
    pages = materialize(runs.mapInArrow(lambda bs: _page_kinds(bs, size), "page STRING, n BIGINT").groupBy("page").agg(F.sum("n").alias("n")), "pages")
    layout = Layout()
    for _ in range(rounds):
        sent = runs.sparkSession.sparkContext.broadcast(layout)
        rows = pages.mapInArrow(lambda bs, sent=sent: _tally(bs, sent.value), "what STRING, value STRING, state INT, n BIGINT").groupBy("what", "value", "state").agg(F.sum("n").alias("n")).collect()
        layout = Layout().learned({(r["what"], r["value"], r["state"]): r["n"] for r in rows})
    discard(pages)
    return layout


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial word counts of a task."""
    total: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        words: Counter[str] = Counter()
        for token, n in total.items():
            w = _bare(token)
            if _PLAIN.fullmatch(w):
                words[w] += n
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    for batch in bounded(batches):
        for text in batch.column(0).to_pylist():
            if text:
                total.update(text.lower().split())
        if len(total) > 400_000:
            yield flush()
    yield flush()


def vocabulary(content_blocks: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that stand at least ``least`` times in all texts."""
    words = content_blocks.select("text").where("text is not null").mapInArrow(_count, "word STRING, n BIGINT")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _filter_words(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the filter that a task's words set."""
    bits: Counter[int] = Counter()
    for batch in batches:
        for w in batch.column(0).to_pylist():
            for text in (w, *("^" + w[:n] for n in HEADS if len(w) >= n)):
                for i in Filter.places(text, size):
                    bits[i >> 3] |= 1 << (i & 7)
    yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array(list(bits.values()), pa.int32())], names=["at", "bits"])


def _filter(rest: DataFrame, size: int = FILTER_BITS) -> bytes:
    """The filter of a table of words: at most ``size`` / 8 bytes come to the driver."""
    out = bytearray(size >> 3)
    rows = rest.select("word").mapInArrow(lambda bs: _filter_words(bs, size), "at INT, bits INT").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    for r in rows.toLocalIterator():
        out[r["at"]] = r["bits"]
    return bytes(out)


_SPELLERS: dict[str, Speller] = {}


def _speller(sent: tuple[str, dict[str, int], bytes | None], asking: bool) -> Speller:
    """One speller for each vocabulary, by its tag, of a worker's life."""
    tag, counts, bits = sent
    tag += "?" * asking
    if tag not in _SPELLERS:
        _SPELLERS.clear()
        _SPELLERS[tag] = Speller(counts, Filter(bits) if bits is not None else None, asking)
    return _SPELLERS[tag]


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[tuple[str, int], list[tuple[int, str, int | None, str | None, str, bool]], bool]]:
    """Document and run, blocks in order, and whether the document is scanned, of each row."""
    for doc, run, ords, ids, pages, texts, flags in zip(*(batch.column(i).to_pylist() for i in range(7))):
        marked = {o: f for o, f in zip(ords, flags) if f in ("h", "f")}
        order = sorted((k for k in range(len(ords)) if flags[k] == "t"), key=lambda k: (ords[k], texts[k] or ""))
        blocks, last = [], None
        for k in order:
            if ords[k] != last:  # a block delivered twice counts once
                last = ords[k]
                blocks.append((last, ids[k], pages[k], texts[k], marked.get(last, ""), last // size == run))
        yield (doc, run), blocks, "n" in flags


def _questions(batches: Iterator[pa.RecordBatch], sent: tuple, layout: Layout, size: int) -> Iterator[pa.RecordBatch]:
    """Words of the rest of the vocabulary that a run may need."""
    speller = _speller(sent, True)
    for batch in bounded(batches):
        rows: list[tuple[str, int, str]] = []
        for at, blocks, scanned in _blocks(batch, size):
            speller.asked.clear()
            speller.known.clear()
            if scanned:
                read_run(blocks, speller, layout, True)
            rows += [(*at, w) for w in speller.asked]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["document_id", "run", "word"])


def _read(batches: Iterator[pa.RecordBatch], sent: tuple, layout: Layout, size: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    speller = _speller(sent, False)
    for batch in bounded(batches):
        docs: list[str] = []
        cols: list[list] = [[], [], []]
        answers = batch.column(7).to_pylist() if batch.num_columns > 7 else None
        for n, ((doc, run), blocks, scanned) in enumerate(_blocks(batch, size)):
            if answers is not None:
                speller.answers = dict(x.values() for x in answers[n] or ())
                speller.known.clear()
            rows, text = read_run(blocks, speller, layout, scanned)
            if with_text:
                rows = [(str(run), "text", text)] if text else []
            docs += [doc] * len(rows)
            for row in rows:
                for c, v in zip(cols, row):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), *(pa.array(c, pa.string()) for c in cols)], names=["document_id", "block_id", "kind", "word"])


def _runs(content_blocks: DataFrame, parsed_blocks: DataFrame, size: int) -> DataFrame:
    """Blocks and flags of each run of ``size`` blocks, with ``MARGIN`` neighbours.

    Flag ``t`` is a block, ``h`` and ``f`` the flags of one, and ``n`` says that some block
    of the document holds a line break, so that its words come from a scanned page.
    """
    at = F.col("ord")
    low, high = F.floor((at - MARGIN) / size), F.floor((at + MARGIN) / size)
    spread = F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), high.cast("int"))).alias("run")
    placed = content_blocks.where("document_id is not null and ord is not null")
    texts = placed.select("document_id", spread, "ord", "block_id", F.coalesce("page", F.lit(-1)).alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.lit("t").alias("flag"))
    mark = lambda flag: (F.lit("").alias("block_id"), F.lit(-1).alias("page"), F.lit("").alias("text"), flag.alias("flag"))
    flag = F.when(F.col("is_header"), "h").when(F.col("is_footer"), "f")
    flags = parsed_blocks.where("document_id is not null and ord is not null and (is_header or is_footer)").select("document_id", spread, "ord", *mark(flag))
    broken = placed.groupBy("document_id").agg(F.max(F.col("text").contains("\n")).alias("broken"), F.max(F.greatest(high, F.lit(0)).cast("int")).alias("last")).where("broken")
    scanned = broken.select("document_id", F.explode(F.sequence(F.lit(0), "last")).alias("run"), F.lit(-1).alias("ord"), *mark(F.lit("n")))
    both = texts.unionByName(flags).unionByName(scanned)
    # At most size + 2 * MARGIN blocks (and as many flags) come together in one row.
    return both.groupBy("document_id", "run").agg(*[F.collect_list(c).alias(c) for c in ("ord", "block_id", "page", "text", "flag")])


def scan_findings(content_blocks: DataFrame, parsed_blocks: DataFrame, with_text: bool = False, most_held: int = MOST_HELD, size: int = RUN) -> DataFrame:
    """``document_id, block_id, kind, word``: headers, footers and repaired words.

    Null and empty texts give no row, a null page counts as one page of its own,
    rows delivered twice count once, extra columns are ignored. The vocabulary
    counts all texts and has no limit: its ``most_held`` most frequent words are
    held by every task; of the others each run first asks for those that it may
    need, and they come to it by a join. The result is the same for any
    ``most_held``.
    """
    spark = content_blocks.sparkSession
    ship_package(spark)
    runs = materialize(_runs(content_blocks, parsed_blocks, size).where(F.exists("flag", lambda f: f == "t")), "runs")
    layout = learn(runs, size=size)
    words = materialize(vocabulary(content_blocks), "vocabulary")
    counts = {r["word"]: r["n"] for r in words.orderBy(F.desc("n"), "word").limit(most_held).toLocalIterator()}
    lowest = list(counts.items())[-1] if counts else None
    rest = words.where((F.col("n") < lowest[1]) | (F.col("n") == lowest[1]) & (F.col("word") > lowest[0])) if lowest else words
    bits = None if rest.isEmpty() else _filter(rest)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, counts, bits))
    if bits is not None:
        asked = runs.mapInArrow(lambda bs: _questions(bs, sent.value, layout, size), "document_id STRING, run INT, word STRING")
        answers = asked.join(rest, "word").groupBy("document_id", "run").agg(F.collect_list(F.struct("word", "n")).alias("answers"))
        runs = runs.join(answers, ["document_id", "run"], "left")
    return runs.mapInArrow(lambda bs: _read(bs, sent.value, layout, size, with_text), "document_id STRING, block_id STRING, kind STRING, word STRING").distinct()


def paragraphs(content_blocks: DataFrame, parsed_blocks: DataFrame) -> DataFrame:
    """``document_id, run, text``: repaired running text of scanned documents, one row per run of blocks."""
    return scan_findings(content_blocks, parsed_blocks, with_text=True).select("document_id", F.col("block_id").cast("int").alias("run"), F.col("word").alias("text"))
