"""Timelines: events from dated blocks, gaps, conflicts and their summaries.

Order inside a case comes from ``order.Ordered``, so that a case of any size may be
many tasks; conflicts are grouped by instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from .base import once
from .order import Ordered


def instant(iso: Column) -> Column:
    """ISO text as a timestamp without zone; a date alone is its midnight, anything else null."""
    return F.coalesce(F.try_to_timestamp(F.substring(F.regexp_replace(iso, "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def events_from_blocks(blocks: DataFrame) -> DataFrame:
    """One event per normalised timestamp with a value: ``case_id, document_id, block_id, pos, event_id, ts, speaker, confidence, original``.

    The confidence is the lower of block and timestamp, 1 for a null. Event ids
    number the events of a case in document order. Null and empty arrays give
    none; blocks delivered twice count once.
    """
    own = once(blocks.select("case_id", "document_id", "block_id", "ord", "speaker", "confidence", "normalized_timestamps"), "document_id", "block_id")
    each = own.select("case_id", "document_id", "block_id", "ord", "speaker", "confidence", F.posexplode("normalized_timestamps").alias("pos", "t")).where(F.coalesce(F.col("t.iso"), F.lit("")) != "")
    return Ordered(each, ["case_id"], ["document_id", "ord", "block_id", "pos"]).number("n").select(
        "case_id", "document_id", "block_id", "pos", scores.numbered("EVT", F.col("case_id"), F.col("n")).alias("event_id"), F.col("t.iso").alias("ts"),
        "speaker", F.least(F.coalesce("confidence", F.lit(1.0)), F.coalesce("t.confidence", F.lit(1.0))).alias("confidence"), F.col("t.original").alias("original"),
    )


def chunk_readings(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """``document_id, chunk_id, pos, original, iso, confidence``: the normalised timestamps of the blocks of each chunk, in their order."""
    own = once(chunks.select("document_id", "chunk_id", "source_block_ids"), "document_id", "chunk_id").select("document_id", "chunk_id", F.posexplode("source_block_ids").alias("at", "block_id"))
    read = once(blocks.select("document_id", "block_id", "normalized_timestamps"), "document_id", "block_id").where(F.size("normalized_timestamps") > 0)
    each = own.join(read, ["document_id", "block_id"]).groupBy("document_id", "chunk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "normalized_timestamps"))), lambda x: x["normalized_timestamps"])).alias("t"))
    return each.select("document_id", "chunk_id", F.posexplode("t").alias("pos", "t")).select("document_id", "chunk_id", "pos", "t.original", "t.iso", "t.confidence")


def last_readings(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """``document_id, chunk_id, ts``: the last value, as text, among the ``chunk_readings`` of each chunk that has one."""
    own = chunks.where("chunk_id is not null").select("document_id", "chunk_id", F.explode("source_block_ids").alias("block_id"))
    read = blocks.select("document_id", "block_id", F.array_max(F.filter("normalized_timestamps.iso", lambda x: x != "")).alias("ts")).where("ts is not null")
    return own.join(read, ["document_id", "block_id"]).groupBy("document_id", "chunk_id").agg(F.max("ts").alias("ts"))


def events_from_chunks(chunks: DataFrame, readings: DataFrame) -> DataFrame:
    """One event per reading with a value of each chunk: ``case_id, document_id, chunk_id, pos, event_id, ts, speaker, confidence, original, description``.

    ``readings`` has ``document_id, chunk_id, pos, original, iso, confidence``.
    The description is the chunk's text, the confidence the lower of chunk and
    reading, 1 for a null. Ids number the events of a case in document order; a
    chunk delivered twice counts once.
    """
    own = once(chunks.select("case_id", "document_id", "chunk_id", "ord", "speaker", "text", "chunk_confidence"), "document_id", "chunk_id")
    dated = readings.where(F.coalesce("iso", F.lit("")) != "").select("document_id", "chunk_id", "pos", "original", "iso", "confidence")
    each = own.join(dated, ["document_id", "chunk_id"])
    return Ordered(each, ["case_id"], ["document_id", "ord", "chunk_id", "pos"]).number("n").select(
        "case_id", "document_id", "chunk_id", "pos", scores.numbered("EVT", F.col("case_id"), F.col("n")).alias("event_id"), F.col("iso").alias("ts"),
        "speaker", F.least(F.coalesce("chunk_confidence", F.lit(1.0)), F.coalesce("confidence", F.lit(1.0))).alias("confidence"), "original", F.col("text").alias("description"),
    )


def by_hour(events: DataFrame) -> DataFrame:
    """Events with their timestamp cut to the hour, to compare sources that differ by minutes."""
    return events.withColumn("ts", F.concat(F.substring("ts", 1, 13), F.lit(":00:00")))


def sorted_events(events: DataFrame) -> DataFrame:
    """Position of each event in its case: by instant, unreadable ones first, ties by id."""
    return Ordered(events.withColumn("at", instant(F.col("ts"))), ["case_id"], ["at", "event_id"]).number("position")


def gaps(events: DataFrame, least: int = 60, significant: int = 120) -> DataFrame:
    """Gaps of at least ``least`` minutes between neighbours: ``case_id, before_id, after_id, start, end, minutes, severity, confidence``."""
    placed = events.select("case_id", "event_id", "ts", instant(F.col("ts")).alias("at"), "confidence")
    following = Ordered(placed, ["case_id"], ["at", "event_id"]).following("event_id", "ts", "at", "confidence")
    minutes = F.timestamp_diff("MINUTE", F.col("at"), F.col("next_at"))
    return following.withColumn("minutes", minutes).where(F.col("minutes") >= least).select(
        "case_id", F.col("event_id").alias("before_id"), F.col("next_event_id").alias("after_id"), F.col("ts").alias("start"), F.col("next_ts").alias("end"),
        "minutes", scores.gap_severity(F.col("minutes"), significant).alias("severity"), F.least("confidence", "next_confidence").alias("confidence"),
    )


def gap_summary(found: DataFrame) -> DataFrame:
    """Counts by severity and total minutes of each case."""
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "MODERATE").alias("moderate"), F.count_if(F.col("severity") == "SIGNIFICANT").alias("significant"), F.sum("minutes").alias("minutes"))


def largest_gap(found: DataFrame) -> DataFrame:
    """Longest gap of each case; of equal ones the first."""
    best = F.min(F.struct((-F.col("minutes")).alias("m"), "start", "before_id", "after_id", "end", "severity")).alias("g")
    return found.groupBy("case_id").agg(best).select("case_id", "g.before_id", "g.after_id", "g.start", "g.end", (-F.col("g.m")).alias("minutes"), "g.severity")


def conflicts(events: DataFrame, by: str = "speaker") -> DataFrame:
    """Instants of a case at which events of different speakers (or documents) stand.

    Events are compared by the text of their timestamp. Null and empty values of
    ``by`` don't differ from any other.
    """
    value = F.nullif(F.col(by), F.lit(""))
    grouped = events.groupBy("case_id", "ts").agg(
        F.array_sort(F.collect_set(value)).alias("values"), F.array_sort(F.collect_list("event_id")).alias("event_ids"),
        F.array_sort(F.collect_set(F.concat_ws("/", "document_id", "block_id"))).alias("blocks"), F.min("confidence").alias("confidence"),
    )
    differ = grouped.where(F.size("values") > 1)
    what = "with different speakers" if by == "speaker" else "from different documents"
    return differ.select("case_id", "ts", F.concat(F.lit(f"Multiple events at same time {what}: "), F.array_join("values", ", ")).alias("reason"), "event_ids", "blocks", "confidence")


def conflict_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("ts").alias("unique_timestamps"), F.sum(F.size("event_ids")).alias("total_events"))


def blocks_in_conflict(found: DataFrame) -> DataFrame:
    return found.select("case_id", F.explode("blocks").alias("block")).distinct()


def confidence_summary(events: DataFrame, low: float = 0.7) -> DataFrame:
    """Mean, histogram and number of low confidences of each case."""
    c = F.col("confidence")
    return events.groupBy("case_id").agg(
        F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("mean"), F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"),
        F.count_if(c < 0.7).alias("low"), F.count_if(c < low).alias("below"),
    )


def time_range(events: DataFrame) -> DataFrame:
    """First and last readable instant of each case, as written."""
    own = events.withColumn("at", instant(F.col("ts"))).where("at is not null")
    return own.groupBy("case_id").agg(F.min(F.struct("at", "ts"))["ts"].alias("first"), F.max(F.struct("at", "ts"))["ts"].alias("last"))


def chronology(events: DataFrame) -> DataFrame:
    """Whether the events of a document stand in order of time in its text; unreadable ones are skipped."""
    own = events.select("document_id", "event_id", instant(F.col("ts")).alias("at")).where("at is not null")
    kept = Ordered(own, ["document_id"], ["event_id"]).following("at").withColumn("ok", F.coalesce(F.col("at") <= F.col("next_at"), F.lit(True)))
    return kept.groupBy("document_id").agg(F.bool_and("ok").alias("ordered"), F.count(F.lit(1)).alias("n"))


def low_events(events: DataFrame, least: float = 0.7) -> DataFrame:
    return events.where(F.col("confidence") < least)


def relevant(events: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Events whose ``on`` columns stand among ``keys``."""
    return events.join(keys.select(*on).distinct(), list(on), "left_semi")


def conflicts_among(found: DataFrame, events: DataFrame) -> DataFrame:
    """Conflicts that one of the given events takes part in."""
    each = found.select("case_id", "ts", "reason", "confidence", F.explode("event_ids").alias("event_id"))
    return each.join(events.select("case_id", "event_id").distinct(), ["case_id", "event_id"], "left_semi").drop("event_id").distinct()
