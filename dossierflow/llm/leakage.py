"""Evaluation passages inside a training corpus, found through template windows.

Both sides are read as words, and every word as a typed slot or a fixed word:
numbers, names (words that an evaluation item writes with a capital inside a
sentence, or the document with a capital anywhere) and units become
placeholders. Document words that may be a name or a word of an item are read
both ways. Windows of template words are joined by hash; then the slots of a
joined window are compared: equal slots are a copy, other slots, consistently
renamed, a re-parameterised item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import bounded
from ..session import ship_package

WINDOW = 12
WORD = re.compile(r"[^\W_]+")
_CASED = re.compile(r"(?<![.!?\n]\s)(?<![.!?\n])(?<!^)\b[A-Z][^\W\d_]+")

_TITLED = re.compile(r"\b([A-Z][^\W\d_]+) (?=([A-Z][^\W\d_]+))")

# Words that stand for a unit of measure.
UNITS = frozenset("mm cm m km g kg mg l ml s min h hour hours minute minutes day days week weeks month months year years degree degrees percent euro euros dollar dollars pound pounds mile miles metre metres".split())

NUMBER, NAME, UNIT = -3, -4, -5
UNKNOWN = -1

#: Words of evaluation items that are sent to every task at once (about 60 MB); a larger set meets the documents in several passes.
PASS_WORDS = 200_000


def words(text: str) -> list[str]:
    """Unbroken runs of letters or digits of the lower-cased text."""
    return WORD.findall(text.lower())


def names_in(text: str) -> set[str]:
    """Lower-cased words that stand with a capital inside a sentence, or at its start before another such word ("Captain Driftmoor")."""
    inside = {w.lower() for w in _CASED.findall(text)}
    return inside | {w.lower() for w, after in _TITLED.findall(text) if after.lower() in inside and not re.search(rf"\b{w.lower()}\b", text)}


def capitalised(text: str) -> set[str]:
    """Lower-cased words that stand with a capital anywhere."""
    return {w.lower() for w in WORD.findall(text) if w[0].isupper()}


class Templates:
    """Vocabulary of a block of evaluation items, and its windows as (template hash, hash of own words)."""

    def __init__(self, items: list[Item], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[str, int] = {}
        self.names = {w for i in items for w, k in i.slots.items() if k == NAME}
        for i in items:
            for w in i.words:
                self.ids.setdefault(w, len(self.ids) + 1)
        rng = np.random.default_rng(20240229)
        self.powers = rng.integers(1, 2**63 - 1, window, dtype=np.int64).astype(np.uint64) | np.uint64(1)

    def slot(self, word: str) -> int:
        """Kind of placeholder of a word, or 0 for a fixed word."""
        return NUMBER if word.isdigit() else NAME if word in self.names else UNIT if word in UNITS else 0

    def code(self, found: list[str], seen: dict[str, tuple[int, int, int]], cased: set[str] | frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template id and own id of each word, and the other template id that a word of ``cased`` may have, or 0.

        A word of no item is a name if it is in ``cased``, else ``UNKNOWN``.
        """
        codes = []
        for w in found:
            key = "^" + w if w in cased else w
            p = seen.get(key)
            if p is None:
                i = self.ids.get(w, 0)
                kind = self.slot(w) or (NAME if w in cased and not i else 0)
                p = seen[key] = (kind or i or UNKNOWN, i or (hash_word(w) if kind else UNKNOWN), NAME if w in cased and kind not in (NAME, NUMBER) else 0)
            codes.append(p)
        all_ = np.array(codes, dtype=np.int64).reshape(-1, 3)
        return all_[:, 0], all_[:, 1], all_[:, 2]

    def hashes(self, template: np.ndarray, own: np.ndarray, other: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts of windows without unknown words, with the hash of their template and of their own words, about ``most`` at a time.

        A start stands once for each way to read the words that have an ``other`` template id.
        """
        n = len(template) - self.window + 1
        if n <= 0:
            return
        before = lambda x: np.concatenate(([0], np.cumsum(x)))
        unknown, open_ = before(template == UNKNOWN), before(other != 0)
        every = np.flatnonzero(unknown[self.window :] == unknown[:n])
        mix = lambda ids: (((ids.astype(np.uint64) + np.uint64(0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)) ^ (ids.astype(np.uint64) >> np.uint64(7)))
        plain, mine = mix(template), mix(own)
        change = np.where(other != 0, mix(other) - plain, np.uint64(0))
        readings = np.cumsum(1 << (open_[every + self.window] - open_[every]))
        for starts in np.split(every, np.flatnonzero(np.diff(readings // most)) + 1):
            if not len(starts):
                continue
            at = starts[:, None] + np.arange(self.window)
            by_template, by_own = ((x[at] * self.powers).sum(axis=1, dtype=np.uint64) for x in (plain, mine))
            row = np.arange(len(starts))
            for k in range(self.window) if other.any() else ():
                # Each position that can be read otherwise doubles the readings of its windows.
                also = np.flatnonzero(other[starts[row] + k])
                by_template = np.concatenate((by_template, by_template[also] + change[starts[row[also]] + k] * self.powers[k]))
                row = np.concatenate((row, row[also]))
            yield starts[row], by_template, by_own[row]


def hash_word(word: str) -> int:
    """Stable id of a slot word that no item contains."""
    value = 0
    for byte in word.encode("utf-8"):
        value = (value * 1099511628211 + byte) & 0x3FFFFFFFFFFFFFFF
    return value | (1 << 61)


class Item:
    """Words of one evaluation item, and which of them are slots: its own names, numbers and units."""

    def __init__(self, item_id: int, text: str) -> None:
        self.item_id, self.words = item_id, words(text)
        names = names_in(text)
        self.slots = {w: k for w in self.words if (k := NUMBER if w.isdigit() else NAME if w in names else UNIT if w in UNITS else 0)}

    def renamed(self, found: list[str], at: int, templates: Templates, cased: set[str]) -> bool:
        """Whether a window of a document, whose words ``cased`` may be names, equals the item's window at ``at`` up to a one-to-one renaming of slots of the same kind."""
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        for x, y in zip(found, self.words[at:]):
            kind = self.slots.get(y)
            if not (x == y or kind and (templates.slot(x) == kind or kind == NAME and x in cased)) or there.setdefault(x, y) != y or back.setdefault(y, x) != x:
                return False
        return True


def _scan(batches: Iterator[pa.RecordBatch], templates: Templates, items: list[Item], table: dict[int, list[tuple[int, int]]], by_case: bool) -> Iterator[pa.RecordBatch]:
    """Join each document's windows with the table of evaluation windows and compare the words behind equal hashes."""
    size = templates.window
    known = np.array(sorted(table), dtype=np.uint64)
    seen: dict[str, tuple[int, int, int]] = {}
    for batch in bounded(batches):
        out: dict[tuple[int, int], list[int]] = {}
        if len(seen) > 500_000:
            seen.clear()
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text or doc is None or not len(known):
                continue
            found, cased = words(text), capitalised(text) if by_case else set()
            for starts, by_template, _ in templates.hashes(*templates.code(found, seen, cased)):
                where = np.searchsorted(known, by_template)
                hit = known[np.minimum(where, len(known) - 1)] == by_template
                for at, key in zip(starts[hit].tolist(), by_template[hit].tolist()):
                    mine = found[at : at + size]
                    for n, pos in table[key]:
                        item = items[n]
                        exact = mine == item.words[pos : pos + size]
                        if exact or item.renamed(mine, pos, templates, cased):
                            count = out.setdefault((doc, item.item_id), [0, 0])
                            count[0 if exact else 1] += 1
        keys = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([out[k][0] for k in keys], pa.int32()), pa.array([out[k][1] for k in keys], pa.int32())], names=["doc_id", "item_id", "copied", "renamed"])


LEAKS = "doc_id BIGINT, item_id BIGINT, copied INT, renamed INT"


def leaks(documents: DataFrame, eval_items: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS, by_case: bool = True) -> DataFrame:
    """``doc_id, item_id, copied, renamed``: windows of the document that copy the item, or re-parameterise it.

    Held-out material is small, but nothing rests on that: items are spread by
    their hash over passes of about ``pass_words`` words, and only one pass of
    them comes to the driver and is sent to the tasks at a time. What is a slot of an item
    depends on its own text alone, so the number of passes changes nothing. Null
    and empty texts on either side give no row, nor do texts of fewer words than
    a window. Extra columns are ignored; an item delivered twice counts once, and
    different texts under one item_id count together. Without ``by_case`` only
    the items' own words can be names in a document; copies are the same.
    """
    spark = documents.sparkSession
    ship_package(spark)
    items = eval_items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    passes = -(-total // pass_words) or 1
    found = []
    for number in range(passes):
        own = [Item(*r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).toLocalIterator()]
        templates = Templates(own, window)
        table: dict[int, list[tuple[int, int]]] = {}
        for n, item in enumerate(own):
            for starts, by_template, _ in templates.hashes(*templates.code(item.words, {})):
                for at, key in zip(starts.tolist(), by_template.tolist()):
                    table.setdefault(key, []).append((n, at))
        sent = spark.sparkContext.broadcast((templates, own, table))
        found.append(docs.mapInArrow(lambda batches, sent=sent: _scan(batches, *sent.value, by_case), LEAKS))
    raw = reduce(DataFrame.unionByName, found)
    return raw.groupBy("doc_id", "item_id").agg(F.sum("copied").cast("int").alias("copied"), F.sum("renamed").cast("int").alias("renamed"))


def leaked_documents(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of documents that share at least 12 consecutive words with an item."""
    return leaks(documents, eval_items, by_case=False).where("copied > 0").select("doc_id", "item_id")
