"""Append-only logs as JSON lines, and filters over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACTION_LOG = "event STRING, tool STRING, tool_version STRING, case_id STRING, document_id STRING, input_hash STRING, output_hash STRING, timestamp STRING, operator STRING, original_filename STRING"
ACCESS_LOG = "timestamp STRING, user_id STRING, role STRING, action STRING, case_id STRING, ip_address STRING, status STRING, details STRING"


def append(rows: DataFrame, path: str, by: str = "case_id") -> None:
    """Add rows to a log, one folder for each value of ``by``."""
    rows.write.mode("append").partitionBy(by).json(path)


def entries(rows: DataFrame) -> DataFrame:
    """Rows of the access log for events ``user_id, role, action, case_id, ip_address, details``, of this moment (UTC); ``status`` is SUCCESS where there is none."""
    status = F.coalesce("status", F.lit("SUCCESS")) if "status" in rows.columns else F.lit("SUCCESS")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.select(now.alias("timestamp"), "user_id", "role", "action", "case_id", "ip_address", status.alias("status"), "details")


def append_daily(rows: DataFrame, path: str) -> None:
    """Add rows to a log with a folder for each day of their timestamps, so that a query over some days reads only those."""
    append(rows.withColumn("day", F.substring("timestamp", 1, 10)), path, by="day")


def read(spark: SparkSession, path: str, schema: str = ACCESS_LOG) -> DataFrame:
    """Rows of a log; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def select(log: DataFrame, **equal: str | None) -> DataFrame:
    """Rows that have all given values; ``since`` and ``until`` bound the timestamp's date. A filter left None doesn't count."""
    since, until = equal.pop("since", None), equal.pop("until", None)
    for name, value in equal.items():
        if value is not None:
            log = log.where(F.col(name) == value)
    day = F.substring("timestamp", 1, 10)
    if since is not None:
        log = log.where(day >= since)
    return log.where(day <= until) if until is not None else log


def latest(log: DataFrame, n: int = 100) -> DataFrame:
    """The last n rows, newest first; ties by the other columns."""
    return log.orderBy(F.desc("timestamp"), *[c for c in log.columns if c != "timestamp"]).limit(n)
