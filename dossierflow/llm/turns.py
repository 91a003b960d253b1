"""Speech transcripts into clean, ordered speaker turns.

A transcript is read in runs of ``RUN`` blocks, so that no task ever holds more
than a run, however long one document is. Each label is compared with the
document's roster; labels that fit several people, or nobody, are decided by a
hidden Markov model whose states are the speakers, with transitions and word
profiles counted from the labels of the whole document that are certain. Runs
are then stitched: what a run begins without a label continues the speaker before
it, and turns are numbered from a summary of each run.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..batches import bounded
from ..session import materialize, ship_package
from .lexicon import NICKNAMES, TITLES, near

#: Blocks of a document that are read together, and neighbours on either side that show the model what comes before and after.
RUN, MARGIN = 2048, 64

# Words and short forms for a role.
ROLES = {
    "interviewer": "interviewer", "int": "interviewer", "witness": "witness", "wit": "witness", "suspect": "suspect", "sus": "suspect",
    "counsel": "counsel", "cou": "counsel", "observer": "observer", "obs": "observer",
}
# Letters for the side that asks and the side that answers.
SIDES = {"q": ("interviewer",), "a": ("witness", "suspect")}

_MARK = re.compile(r"\s*(?:[\[(<{]\s?\d{1,2}(?::\d{2}){1,2}\s?[\])>}]|[\[(<{]?\d{1,2}h?\d{0,2}m\d{2}s[\])>}]?|\d{1,2}(?::\d{2}){1,2}(?:\s-(?=\s)|>|\]))\s*")
_NAME = r"(?:[^\W\d_][\w'’]*\.?)"
_LABEL = re.compile(rf"({_NAME}(?:[ ,]+{_NAME}){{0,4}}\s?(?:\((?:interviewer|witness|suspect|counsel|observer)\))?)(\s?:-?(?=\s|$)|\s-(?=\s|$)|(?<=\b[QA])\.(?=\s))", re.I)
_INNER = re.compile(rf"(?<=[.?!…\])}}>›*,—])\s+((?:[A-ZÀ-Þ][\w'’]*\.?)(?:[ ,]+(?:[A-ZÀ-Þ][\w'’]*\.?)){{0,4}}\s?(?:\((?:interviewer|witness|suspect|counsel|observer)\))?)(\s?:-?(?=\s|$)|\s-(?=\s|$)|(?<=\b[QA])\.(?=\s))")
_NOTE = re.compile(r"\[\[?[^\]\[]*\]\]?|\(\(?[^)(]*\)\)?|\{[^}{]*\}|<[^><]*>|‹[^›‹]*›|\*[^*\s][^*]*\*")
_SOUND = re.compile(r"(?<![^\W_])(?:u+h+m*|u+m+|e+r+m*|e+h+m*|h+m+)(?![^\W_])(?:\.{2,}|[…,—–-])*", re.I)
_FURNITURE = re.compile(r"[^a-zß-ÿ]*\bPAGE\s+\d+(?:\s*(?:OF|/)\s*\d+)?\s*")
_OPEN = re.compile(r"[\[({<‹*]")
_TOKEN = re.compile(r"[^\W\d_]+")


def clean_speech(text: str) -> str:
    """Speech without time marks in brackets, sound notes and hesitation sounds; pieces without a letter or digit are kept."""
    if _OPEN.search(text):
        text = _NOTE.sub(" ", text)
    return _SOUND.sub(" ", text)


def speech_words(text: str) -> list[str]:
    """Blank-separated pieces with a letter or digit."""
    return [w for w in text.split() if any(map(str.isalnum, w))]


class Roster:
    """Speakers of one document and what their labels may look like."""

    def __init__(self, people: list[tuple[str, str, str]]) -> None:
        self.people = [(i, _TOKEN.findall((name or "").lower()), (role or "").lower()) for i, name, role in people]
        self.known: dict[str, tuple[str, ...]] = {}

    def resolve(self, label: str) -> tuple[str, ...]:
        """Ids of the speakers that a label may mean; empty if it is no label."""
        found = self.known.get(label)
        if found is None:
            found = self.known[label] = self._resolve(label)
        return found

    def _resolve(self, label: str) -> tuple[str, ...]:
        words = _TOKEN.findall(label.lower())
        role = None
        if len(words) > 1 and label.rstrip().endswith(")") and words[-1] in ROLES:
            role = ROLES[words.pop()]
        while len(words) > 1 and (words[0] in TITLES or words[0] == "the"):
            words.pop(0)
        if len(words) == 1:
            if words[0] in SIDES and not role:
                return tuple(i for i, _, r in self.people if r in SIDES[words[0]])
            if words[0] in ROLES:
                return tuple(i for i, _, r in self.people if r == ROLES[words[0]])
        scores = {}
        for i, name, r in self.people:
            total = 0.0
            surname = False
            for w in words:
                best = 0.0
                for k, x in enumerate(name):
                    if w == x or NICKNAMES.get(w) == x:
                        s = 1.0
                    elif len(w) == 1:
                        s = 0.5 if x[0] == w else 0.0
                    elif len(w) > 3 and near(w, x):
                        s = 0.9
                    elif len(w) > 4 and len(x) > 4 and _alike(w, x):
                        s = 0.6
                    else:
                        s = 0.0
                    if s >= 0.6 and (k or len(name) == 1):
                        surname = True
                    best = max(best, s)
                total += best if best or len(w) == 1 else -1.0
            if total > 0 and (surname or total >= len(words) * 0.9):
                scores[i] = total + (0.2 if role and role == r else 0.0)
        if not scores:
            return ()
        top = max(scores.values())
        return tuple(i for i, s in scores.items() if s == top)


def _alike(a: str, b: str) -> bool:
    """Two errors: a common head and tail leave at most a third of the longer word."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return max(len(a), len(b)) - head - tail <= max(len(a), len(b)) // 3


def segments(speaker: str | None, text: str | None, roster: Roster) -> list[tuple[tuple[str, ...] | None, str]]:
    """Pieces of one block: (candidates, raw speech), where None continues whoever spoke before.

    A typed label that fits nobody of the roster may be any of them.
    """
    text = text or ""
    label: tuple[str, ...] | None = None
    if speaker and speaker.strip():
        label = roster.resolve(speaker.strip()) or tuple(i for i, _, _ in roster.people)
    if _FURNITURE.fullmatch(text):
        return []
    at = m.end() if (m := _MARK.match(text)) else 0
    if label is None:
        m = _LABEL.match(text, at)
        if m and (found := roster.resolve(m[1].strip())):
            label = found
            at = m.end()
            if n := _MARK.match(text, at):
                at = n.end()
    out = []
    for m in _INNER.finditer(text, at):
        name = m[1].strip()
        if found := roster.resolve(name):
            out.append((label, text[at : m.start()]))
            label, at = found, m.end()
    out.append((label, text[at:]))
    return out


Event = tuple[tuple[str, ...], list[str]]
#: Words of each speaker, and how often one speaker follows another.
Counts = tuple[dict[str, Counter[str]], Counter[tuple[str, str]]]


def certain(events: list[Event], own: list[bool] | None = None) -> Counts:
    """Profiles and transitions of the labels that fit one person only, from the events that are ``own`` to whatever follows."""
    moves: Counter[tuple[str, str]] = Counter()
    profile: dict[str, Counter[str]] = defaultdict(Counter)
    for k, ((a, words), (b, _)) in enumerate(zip(events, [*events[1:], ((), [])])):
        if len(a) == 1 and (own is None or own[k]):
            profile[a[0]].update(w.lower() for w in words)
            if len(b) == 1:
                moves[a[0], b[0]] += 1
    return profile, moves


def decide(events: list[Event], counts: Counts | None = None) -> list[str]:
    """Most likely speaker of each labelled event (Viterbi).

    ``events``: the candidates of a label and the words spoken under it. With one
    candidate everywhere there is nothing to decide. ``counts`` are those of the
    whole document, if the events are only a part of it.
    """
    if all(len(c) == 1 for c, _ in events):
        return [c[0] for c, _ in events]
    profile, moves = counts or certain(events)
    totals = {s: sum(p.values()) for s, p in profile.items()}
    size = len({w for p in profile.values() for w in p}) + 1
    starts: Counter[str] = Counter()
    for (a, _), n in moves.items():
        starts[a] += n

    def emit(s: str, words: list[str]) -> float:
        p, n = profile.get(s, Counter()), totals.get(s, 0)
        return sum(math.log((p[w.lower()] + 1) / (n + size)) for w in words) / len(words) if words else 0.0

    best: dict[str, float] = {}
    back: list[dict[str, str | None]] = []
    for candidates, words in events:
        now: dict[str, float] = {}
        link: dict[str, str | None] = {}
        for s in candidates:
            score, before = max(((v + math.log((moves[r, s] + 1) / (starts[r] + len(candidates) + 1)), r) for r, v in best.items()), default=(0.0, None))
            now[s] = score + (emit(s, words) if len(candidates) > 1 else 0.0)
            link[s] = before
        best = now
        back.append(link)
    s = max(best, key=lambda x: (best[x], x))
    path = []
    for link in reversed(back):
        path.append(s)
        s = link[s]
    return path[::-1]


def read_events(blocks: list[tuple[int, str | None, str | None]], roster: Roster) -> tuple[list[Event], list[int], list[tuple[int, int, str, int]]]:
    """Labelled events, the block of each, and the pieces of speech (event or -1, block, clean speech, words) of blocks in order."""
    events: list[Event] = []
    at: list[int] = []
    parts: list[tuple[int, int, str, int]] = []
    last = None
    for ord_, speaker, text in blocks:
        if ord_ == last:  # delivered twice
            continue
        last = ord_
        for label, raw in segments(speaker, text, roster):
            clean = clean_speech(raw)
            words = speech_words(clean)
            if label:
                events.append((label, words))
                at.append(ord_)
            if words:
                parts.append((len(events) - 1, ord_, " ".join(clean.split()), len(words)))
    return events, at, parts


def run_turns(blocks: list[tuple[int, str | None, str | None]], roster: Roster, own: tuple[int, int] | None = None, counts: Counts | None = None) -> tuple[list[tuple[str | None, int, int, int, str]], str | None]:
    """Pieces (speaker or None, first_ord, last_ord, n_words, text) of one run of blocks in order, and whom its last label names.

    Blocks outside the range ``own`` only help to decide.
    """
    low, high = own or (0, 1 << 31)
    events, at, parts = read_events(blocks, roster)
    speakers = decide(events, counts) if events else []
    out: list[tuple[str | None, int, int, int, str]] = []
    for event, ord_, clean, n in parts:
        if not low <= ord_ < high:
            continue
        who = speakers[event] if event >= 0 else None
        if out and out[-1][0] == who:
            _, first, _, count, text = out[-1]
            out[-1] = (who, first, ord_, count + n, f"{text} {clean}")
        else:
            out.append((who, ord_, ord_, n, clean))
    return out, next((s for s, o in zip(reversed(speakers), reversed(at)) if low <= o < high), None)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[tuple[int, str | None, str | None]], Roster]]:
    for doc, run, ords, speakers, texts, people in zip(*(batch.column(i).to_pylist() for i in range(6))):
        order = sorted(range(len(ords)), key=lambda k: (ords[k], texts[k] is None, texts[k] or "", speakers[k] or ""))
        yield doc, run, [(ords[k], speakers[k], texts[k]) for k in order], Roster([tuple(p.values()) for p in people])


def _certain(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Counts of each run's certain labels: words ``b`` of speaker ``a``, or transitions from ``a`` to ``b``."""
    for batch in bounded(batches):
        rows: list[tuple[str, bool, str, str, int]] = []
        for doc, run, blocks, roster in _rows(batch):
            events, at, _ = read_events(blocks, roster)
            profile, moves = certain(events, [o // size == run for o in at])
            rows += [(doc, False, s, w, n) for s, p in profile.items() for w, n in p.items()]
            rows += [(doc, True, a, b, n) for (a, b), n in moves.items()]
        kinds = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["document_id", "move", "a", "b", "n"])


def _read(batches: Iterator[pa.RecordBatch], size: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """One row for each run: its pieces, each with the number of changes of speaker before it, and what stitching needs to know."""
    piece = pa.struct([("speaker_id", pa.string()), ("first_ord", pa.int32()), ("last_ord", pa.int32()), ("n_words", pa.int64()), ("text", pa.string()), ("changes", pa.int32())])
    for batch in bounded(batches):
        rows: list[tuple] = []
        counted = batch.column(6).to_pylist()
        for known, (doc, run, blocks, roster) in zip(counted, _rows(batch)):
            counts = None
            if known is not None:
                counts = defaultdict(Counter), Counter()
                for x in known:
                    if x["move"]:
                        counts[1][x["a"], x["b"]] = x["n"]
                    else:
                        counts[0][x["a"]][x["b"]] = x["n"]
            pieces, last = run_turns(blocks, roster, (run * size, (run + 1) * size), counts)
            changes, before, out = 0, None, []
            for who, first, end, n, text in pieces:
                changes += who is not None and before is not None and who != before
                before = who or before
                out.append({"speaker_id": who, "first_ord": first, "last_ord": end, "n_words": n, "text": text if with_text else None, "changes": changes})
            spoken = [who for who, *_ in pieces if who is not None]
            rows.append((doc, run, out, bool(pieces) and pieces[0][0] is None, spoken[0] if spoken else None, spoken[-1] if spoken else None, changes, last))
        kinds = [pa.string(), pa.int32(), pa.list_(piece), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["document_id", "run", "pieces", "leads", "first_spoken", "last_spoken", "changes", "last_label"])


PIECES = "document_id STRING, run INT, pieces ARRAY<STRUCT<speaker_id: STRING, first_ord: INT, last_ord: INT, n_words: BIGINT, text: STRING, changes: INT>>, leads BOOLEAN, first_spoken STRING, last_spoken STRING, changes INT, last_label STRING"


def speaker_turns(parsed_blocks: DataFrame, roster: DataFrame, with_text: bool = False, run: int = RUN) -> DataFrame:
    """``document_id, turn_no, speaker_id, first_ord, last_ord, n_words`` (and ``text``) of each document in the roster.

    Blocks without speech belong to no turn; speech before any label has no
    speaker and makes no turn. Blocks with a null or negative ``ord`` or a null document, and
    documents without a roster, give no row; a block delivered twice counts once;
    null and empty texts are no speech. Extra columns are ignored.
    """
    ship_package(parsed_blocks.sparkSession)
    at = F.col("ord")
    blocks = parsed_blocks.where("document_id is not null and ord >= 0").select("document_id", "ord", F.coalesce("speaker", F.lit("")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    margin = min(MARGIN, run)
    placed = blocks.select("*", F.explode(F.sequence(F.greatest(F.floor((at - margin) / run), F.lit(0)).cast("int"), F.floor((at + margin) / run).cast("int"))).alias("run"))
    people = roster.where("document_id is not null and speaker_id is not null").groupBy("document_id").agg(F.sort_array(F.collect_set(F.struct("speaker_id", "full_name", "role"))).alias("people"))
    # The roster is spread over the runs of its document, so that both sides meet by document and run: one long transcript is then many tasks.
    extent = blocks.groupBy("document_id").agg(F.floor(F.max("ord") / run).cast("int").alias("last"))
    spread = people.join(extent, "document_id").select("document_id", "last", F.explode(F.sequence(F.lit(0), "last")).alias("run"), "people")
    spoken = placed.join(spread.select("document_id", "run"), ["document_id", "run"], "left_semi")
    # At most ``run`` blocks and two margins (twice delivered ones apart) come together in one row.
    runs = spoken.groupBy("document_id", "run").agg(F.collect_list("ord").alias("ords"), F.collect_list("speaker").alias("speakers"), F.collect_list("text").alias("texts")).join(spread, ["document_id", "run"]).select("document_id", "run", "ords", "speakers", "texts", "people", "last")
    none = F.lit(None).cast("array<struct<move: boolean, a: string, b: string, n: bigint>>").alias("counts")
    # A document of one run is counted where it is read; of a longer one every run gets the counts of all.
    counted = runs.where("last > 0").drop("last").mapInArrow(lambda bs: _certain(bs, run), "document_id STRING, move BOOLEAN, a STRING, b STRING, n BIGINT").groupBy("document_id", "move", "a", "b").agg(F.sum("n").alias("n"))
    known = counted.groupBy("document_id").agg(F.collect_list(F.struct("move", "a", "b", "n")).alias("counts"))
    told = known.join(extent, "document_id").select("document_id", F.explode(F.sequence(F.lit(0), "last")).alias("run"), "counts")
    long = runs.where("last > 0").drop("last").join(told, ["document_id", "run"], "left").withColumn("counts", F.coalesce("counts", F.array().cast("array<struct<move: boolean, a: string, b: string, n: bigint>>")))
    read = materialize(runs.where("last = 0").drop("last").withColumn("counts", none).unionByName(long).mapInArrow(lambda bs: _read(bs, run, with_text), PIECES), "runs")
    # Windows over one short row for each run: who speaks when it begins, who spoke last before it, and how many turns there were.
    order = Window.partitionBy("document_id").orderBy("run")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = read.drop("pieces").withColumn("enters", F.last("last_label", ignorenulls=True).over(before))
    leads = F.col("leads") & F.col("enters").isNotNull()
    joined = leads & F.col("first_spoken").isNotNull() & (F.col("first_spoken") != F.col("enters"))
    ends = carried.withColumns({"leads": leads, "joined": joined.cast("int"), "opens": F.when(leads, F.col("enters")).otherwise(F.col("first_spoken")), "closes": F.coalesce("last_spoken", F.when(leads, F.col("enters")))})
    fresh = F.col("opens").isNotNull() & (F.col("previous").isNull() | (F.col("opens") != F.col("previous")))
    opened = ends.withColumn("previous", F.last("closes", ignorenulls=True).over(before)).withColumn("fresh", fresh.cast("int"))
    numbered = opened.withColumn("base", F.coalesce(F.sum(F.col("fresh") + F.col("joined") + F.col("changes")).over(before), F.lit(0)) + F.col("fresh")).select("document_id", "run", "enters", "joined", "base")
    each = read.select("document_id", "run", F.inline("pieces")).join(numbered, ["document_id", "run"])
    known_ = each.withColumn("turn_no", (F.col("base") + F.when(F.col("speaker_id").isNull(), F.lit(0)).otherwise(F.col("joined") + F.col("changes"))).cast("int")).withColumn("speaker_id", F.coalesce("speaker_id", "enters")).where("speaker_id is not null")
    text = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "run", "last_ord", "text"))), lambda x: x["text"]), " ").alias("text")] if with_text else []
    turns = known_.groupBy("document_id", "turn_no").agg(F.first("speaker_id").alias("speaker_id"), F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"), F.sum("n_words").cast("int").alias("n_words"), *text)
    return turns.select("document_id", "turn_no", "speaker_id", "first_ord", "last_ord", "n_words", *(["text"] if with_text else []))
