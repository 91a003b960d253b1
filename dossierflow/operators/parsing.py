"""Structure of blocks: page furniture, sections, speakers, raw timestamps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..session import ship_package, size_in_bytes
from .base import once
from .order import WINDOW_BYTES, Ordered

# Notations of times and dates inside text, in the order in which they are tried.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
MENTION_PATTERNS = (
    rf"(?i)\b((?:{_MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:\s*,?\s*\d{{4}})?\s+(?:at\s+)?\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s*[AaPp][Mm])\b",
    r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?)\b",
    r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:[+-]\d{2}:?\d{2}|Z)?)\b",
    rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTHS})(?:\s*,?\s*\d{{4}})?)\b",
    rf"(?i)\b((?:{_MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:\s*,?\s*\d{{4}})?)\b",
    rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_SHORT})\.?(?:\s*,?\s*\d{{4}})?)\b",
    rf"(?i)\b((?:{_SHORT})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:\s*,?\s*\d{{4}})?)\b",
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b",
    r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b",
    r"\b(\d{1,2}\.\d{1,2}\.\d{2,4})\b",
    rf"(?i)\b((?:{_MONTHS})\s+\d{{4}})\b",
    r"\b(\d{1,2}:\d{2}(?::\d{2})?\s*[AaPp][Mm])\b",
    r"\b(\d{1,2}:\d{2}(?::\d{2})?)\b(?!\s*[AaPp][Mm])",
    r"(?i)\b(\d{4}\s*(?:hours?|hrs?))\b",
    r"(?i)\b(\d{1,2}\s+o'clock(?:\s*[AaPp][Mm])?)\b",
    r"(?i)\b((?:around|approximately|about|approx\.?)\s+\d{1,2}(?::\d{2})?\s*[AaPp][Mm])\b",
    r"(?i)\b((?:last|this|next)\s+(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|week|month|year|night|morning|evening|afternoon))\b",
    r"(?i)\b(yesterday|today|tonight|tomorrow)\b",
    r"(?i)\b(the\s+(?:night|morning|afternoon|evening)\s+of)\b",
)
# Some piece of text that every match of the pattern holds, in lower case, so that most patterns need not be tried.
_MONTH_CUES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_CUES = (
    _MONTH_CUES, "-/", "-", _MONTH_CUES, _MONTH_CUES, _MONTH_CUES, _MONTH_CUES, "-", "/", "-/", ".", _MONTH_CUES, ("am", "pm"), ":",
    ("hour", "hr"), ("o'clock",), ("around", "approx", "about"), ("last", "this", "next"), ("yesterday", "today", "tonight", "tomorrow"), ("the",),
)
_COMPILED = tuple((re.compile(p), tuple(c)) for p, c in zip(MENTION_PATTERNS, _CUES, strict=True))
_LIKELY = re.compile(r"\d|(?i:yesterday|today|tonight|tomorrow|last|this|next|the\s+(?:night|morning|afternoon|evening)\s+of)")


def mentions(text: str | None, longer_wins: bool = True) -> list[tuple[int, int, str]]:
    """Spans of times and dates in order. Of two that overlap the longer stays (or the one tried first)."""
    if not text or not _LIKELY.search(text):
        return []
    kept: list[tuple[int, int]] = []
    low = text.lower()
    for pattern, cues in _COMPILED:
        if not any(map(low.__contains__, cues)):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1)
            rival = min((s for s in kept if a < s[1] and b > s[0]), default=None)
            if rival is None:
                kept.append((a, b))
            elif longer_wins and b - a > rival[1] - rival[0]:
                kept.remove(rival)
                kept.append((a, b))
    return [(a, b, text[a:b].strip()) for a, b in sorted(kept)]


@F.pandas_udf(ArrayType(StringType()))
def raw_timestamps(text: pd.Series) -> pd.Series:
    """Times and dates exactly as they stand in the text; Spark has no builtin that yields match positions."""
    return text.map(lambda t: [x for _, _, x in mentions(t)])


def timestamp_spans(blocks: DataFrame) -> DataFrame:
    """``document_id, block_id, start, end, raw``: positions of times and dates; the notation tried first wins an overlap."""

    ship_package(blocks.sparkSession)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, b, *span) for d, b, t in zip(f["document_id"], f["block_id"], f["text"]) for span in mentions(t, longer_wins=False)]
            yield pd.DataFrame(rows, columns=["document_id", "block_id", "start", "end", "raw"])

    own = once(blocks.select("document_id", "block_id", "text"), "document_id", "block_id").where("text is not null")
    return own.mapInPandas(scan, "document_id STRING, block_id STRING, start INT, end INT, raw STRING")


def _furnished(own: DataFrame, least_pages: int, longest: int, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """Blocks once each, with ``is_header, is_footer``.

    The pages of a line are counted in a window of its document; where the input
    is too large for one line to be one task they are summed first and joined.
    """
    divided = size_in_bytes(own) > window_bytes
    bare = T.strip(F.col("text"))
    page = Window.partitionBy("document_id", "page")
    placed = own.withColumns({
        "_key": F.when((F.length(bare) <= longest) & (bare != ""), T.comparable(F.col("text"))), "_number": T.is_page_number(F.col("text")),
        "_rank": F.row_number().over(page.orderBy("ord", "block_id")), "_of": F.count(F.lit(1)).over(page),
    })
    if divided:
        counts = placed.where("_key is not null").groupBy(F.col("document_id").alias("_doc"), F.col("_key").alias("_line")).agg(F.countDistinct("page").alias("_pages"))
        counted = placed.join(counts, F.col("document_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_line")), "left").drop("_doc", "_line")
        return _marked(counted, own.columns, least_pages)
    # The pages of a line are its ranks by page; lines without a key stand apart from each other and from all others.
    line = Window.partitionBy("document_id", F.coalesce("_key", F.concat(F.lit("\u0001"), "block_id")))
    ranked = placed.withColumn("_nth", F.when(F.col("page").isNotNull(), F.dense_rank().over(line.orderBy(F.col("page").asc_nulls_last()))))
    counted = ranked.withColumn("_pages", F.when(F.col("_key").isNotNull(), F.max("_nth").over(line)))
    return _marked(counted, own.columns, least_pages)


def _marked(counted: DataFrame, columns: list[str], least_pages: int) -> DataFrame:
    repeated = ~F.col("_number") & (F.coalesce("_pages", F.lit(0)) >= least_pages)
    last = (F.col("_rank") == F.col("_of")) & (F.col("_rank") > 1)
    return counted.withColumn("_repeated", repeated).select(*columns, (F.col("_repeated") & ~last).alias("is_header"), (F.col("_number") | (F.col("_repeated") & last)).alias("is_footer"))


def page_furniture(blocks: DataFrame, least_pages: int = 2, longest: int = 100, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """``document_id, block_id, is_header, is_footer``.

    Page numbers are footers. Short text on several pages of a document is a
    header where it opens its page or stands inside it, a footer where it ends
    it. Blank and null texts are neither.
    """
    own = once(blocks.select("document_id", "block_id", "ord", "page", "text"), "document_id", "block_id")
    return _furnished(own, least_pages, longest, window_bytes).select("document_id", "block_id", "is_header", "is_footer")


def _sectioned(own: DataFrame, longest: int) -> DataFrame:
    """Blocks once each, with ``section``."""
    named = own.withColumn("_name", T.section_name(F.col("text"), longest))
    return Ordered(named, ["document_id"], ["ord", "block_id"]).last("_name", "section").drop("_name")


def sections(blocks: DataFrame, longest: int = 50) -> DataFrame:
    """``document_id, block_id, section``: the last heading at or before each block; null before the first."""
    own = once(blocks.select("document_id", "block_id", "ord", "text"), "document_id", "block_id")
    return _sectioned(own, longest).select("document_id", "block_id", "section")


def speakers(blocks: DataFrame) -> DataFrame:
    """``document_id, block_id, speaker, rest``: label at the start of each block, and the text without it."""
    own = once(blocks.select("document_id", "block_id", "text"), "document_id", "block_id")
    return own.select("document_id", "block_id", T.detect_speaker(F.col("text")).alias("s")).select("document_id", "block_id", "s.speaker", "s.rest")


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """All of the above in one row per block, with ``raw_timestamps``; blocks without a document or an id give none."""
    ship_package(blocks.sparkSession)
    own = once(blocks.select("case_id", "document_id", "block_id", "ord", "page", "text"), "document_id", "block_id").where("document_id is not null and block_id is not null")
    known = _furnished(_sectioned(own, longest=50), least_pages=2, longest=100)
    said = known.select("case_id", "document_id", "block_id", "ord", "page", T.detect_speaker(F.col("text")).alias("s"), raw_timestamps("text").alias("raw_timestamps"), "is_header", "is_footer", "section")
    return said.select("document_id", "block_id", "case_id", "ord", "page", "s.speaker", F.col("s.rest").alias("text"), "raw_timestamps", "is_header", "is_footer", "section")
