"""Cleaned blocks, and the cascade that reads one raw timestamp against a reference date."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..session import ship_package
from .base import once

# Forms of times without date, of relative or vague references, and of dates that read only one way.
TIME_ONLY = (r"^\d{1,2}:\d{2}(?::\d{2})?\s*[AaPp][Mm]$", r"^\d{1,2}:\d{2}(?::\d{2})?$", r"(?i)^\d{4}\s*(?:hours?|hrs?)$", r"(?i)^\d{1,2}\s+o'clock(?:\s*[AaPp][Mm])?$")
VAGUE = (r"^(?:yesterday|today|tonight|tomorrow)$", r"^(?:last|this|next)\s+", r"^the\s+(?:night|morning|afternoon|evening)\s+of$", r"^(?:around|approximately|about|approx\.?)\s+")
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ONE_WAY = (r"^\d{4}-\d{2}-\d{2}", rf"(?:{_MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}")
ABOUT = r"(?i)(?:around|approximately|about|approx\.?)"


def _rlike(text: Column, patterns: tuple[str, ...], flags: str = "(?iU)") -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(flags + p if not p.startswith("(?") or p.startswith("(?:") else p)
    return F.coalesce(found, F.lit(False))


def is_time_only(raw: Column) -> Column:
    return _rlike(T.strip(raw), TIME_ONLY, "(?U)")


def is_vague(raw: Column) -> Column:
    return _rlike(T.strip(raw), VAGUE)


def reads_one_way(raw: Column) -> Column:
    return _rlike(raw, ONE_WAY)


def military_seconds(raw: Column) -> Column:
    """Seconds since midnight of ``0815 hours``; null for anything else and for impossible times."""
    digits = F.regexp_extract(T.strip(raw), r"(?iU)^(\d{4})\s*(?:hours?|hrs?)$", 1)
    h, m = F.try_element_at(F.split(F.regexp_replace(digits, r"^(..)(..)$", "$1:$2"), ":"), F.lit(1)), F.try_element_at(F.split(F.regexp_replace(digits, r"^(..)(..)$", "$1:$2"), ":"), F.lit(2))
    return F.when((digits != "") & (h.try_cast("int") <= 23) & (m.try_cast("int") <= 59), h.try_cast("int") * 3600 + m.try_cast("int") * 60)


def clock_seconds(raw: Column) -> Column:
    """Seconds since midnight of ``8:15 PM``, ``20:15`` and ``20:15:30``; null for anything else."""
    bare = T.strip(raw)
    pattern = r"(?U)^(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?$"
    part = lambda i: F.nullif(F.regexp_extract(bare, pattern, i), F.lit(""))
    h, m, s, half = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(0)), F.upper(part(4))
    hour = F.when((half == "PM") & (h != 12), h + 12).when((half == "AM") & (h == 12), 0).otherwise(h)
    return F.when((hour <= 23) & (m <= 59) & (s <= 59), hour * 3600 + m * 60 + s)


@F.pandas_udf(StringType())
def read_date(raw: pd.Series) -> pd.Series:
    """ISO text of any full date or time that the general date reader accepts; its missing parts are those of the first of January 1."""
    from dateutil import parser

    start = datetime(1, 1, 1)

    def one(text: str | None) -> str | None:
        try:
            return parser.parse(text, default=start, fuzzy=False, ignoretz=True).isoformat() if text else None
        except (ValueError, OverflowError, TypeError):
            return None

    return raw.map(one)


def normalized(raw: Column, reference_date: Column) -> Column:
    """``struct(original, iso, confidence)``: blank 0, vague 0.1, military 0.85, time alone 0.7, else by the date reader.

    Times without a date stand on ``reference_date``; with a null one they have
    no value. Date readings get 0.9 where they read one way, else 0.7, less 0.2
    where the text says about.
    """
    bare = T.strip(raw)
    seconds = F.coalesce(military_seconds(bare), F.when(is_time_only(bare), clock_seconds(bare)))
    clock = lambda s: F.concat(F.lit("T"), F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(s / 60 % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    # Only what no builtin rule settles goes to Python; other rows send it null.
    open_ = F.when((bare != "") & ~is_vague(bare) & seconds.isNull(), bare)
    parsed = read_date(open_)
    iso = F.when(is_vague(bare), None).when(seconds.isNotNull(), F.concat(reference_date.cast("string"), clock(seconds))).otherwise(parsed)
    score = F.lit(0.5) + F.when(reads_one_way(bare), 0.4).when(~is_time_only(bare), 0.2).otherwise(0.1) - F.when(bare.rlike(ABOUT), 0.2).otherwise(0.0)
    confidence = F.when(F.coalesce(bare, F.lit("")) == "", 0.0).when(is_vague(bare), 0.1).when(military_seconds(bare).isNotNull(), 0.85).when(seconds.isNotNull(), 0.7).when(parsed.isNotNull(), score).otherwise(0.0)
    return F.struct(bare.alias("original"), iso.alias("iso"), F.round(confidence, 6).alias("confidence"))


def clean_blocks(parsed: DataFrame) -> DataFrame:
    """``document_id, block_id, clean_text``: encoding, blanks and noise put right; null stays null."""
    ship_package(parsed.sparkSession)
    own = once(parsed.select("document_id", "block_id", "text"), "document_id", "block_id")
    return own.select("document_id", "block_id", T.clean_text(F.col("text")).alias("clean_text"))


def readings(blocks: DataFrame) -> DataFrame:
    """``document_id, block_id, pos, original, iso, confidence`` of every entry of ``raw_timestamps`` by the cascade."""
    ship_package(blocks.sparkSession)
    own = once(blocks.select("document_id", "block_id", "reference_date", "raw_timestamps"), "document_id", "block_id")
    each = own.select("document_id", "block_id", "reference_date", F.posexplode("raw_timestamps").alias("pos", "raw")).where("raw is not null")
    return each.select("document_id", "block_id", "pos", normalized(F.col("raw"), F.col("reference_date")).alias("t")).select("document_id", "block_id", "pos", "t.*")


def time_classes(blocks: DataFrame) -> DataFrame:
    """``document_id, block_id, pos, kind, seconds``: class of every raw timestamp, and the time of day where it has only that."""
    own = once(blocks.select("document_id", "block_id", "raw_timestamps"), "document_id", "block_id")
    each = own.select("document_id", "block_id", F.posexplode("raw_timestamps").alias("pos", "raw")).where("raw is not null")
    r = F.col("raw")
    kind = F.when(is_vague(r), "vague").when(is_time_only(r), "time").when(reads_one_way(r), "one_way").otherwise("other")
    return each.select("document_id", "block_id", "pos", kind.alias("kind"), F.when(~is_vague(r), F.coalesce(military_seconds(r), F.when(is_time_only(r), clock_seconds(r)))).alias("seconds"))
