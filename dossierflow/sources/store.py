"""Tables of vectors and graphs: write once, append, replace a case, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def write_once(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write a new table; an existing one is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def replace_cases(df: DataFrame, path: str) -> None:
    """Write the cases of ``df`` over their old rows; other cases stay. The table is partitioned by case_id."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _after(last: int | None) -> int:
    return 0 if last is None else last + 1


def add_vectors(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Vectors with ids after those in use, in order of their chunk: ``vector_id`` plus the columns of ``new``.

    Ids are counted by range partitions and their offsets, without one task
    that sees all rows.
    """
    start = 0 if stored is None else _after(stored.agg(F.max("vector_id")).first()[0])
    placed = new.repartitionByRange("document_id", "chunk_id").sortWithinPartitions("document_id", "chunk_id").withColumn("part", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id())
    keyed = materialize(placed, "vectors")  # written, as a second run might cut the ranges elsewhere
    sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("local").alias("base"))
    ahead = sizes.alias("x").join(sizes.select(F.col("part").alias("p"), F.col("size").alias("s")), F.col("p") < F.col("part"), "left").groupBy("part", "base").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("ahead"))
    numbered = keyed.join(F.broadcast(ahead), "part").withColumn("vector_id", F.col("local") - F.col("base") + F.col("ahead") + start).drop("part", "local", "base", "ahead")
    return numbered if stored is None else stored.unionByName(numbered)


def vectors_of(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of chunks ``document_id, chunk_id``; chunks without a vector give none."""
    return stored.join(chunks.select("document_id", "chunk_id").distinct(), ["document_id", "chunk_id"], "left_semi")


def vector(stored: DataFrame, vector_id: int) -> DataFrame:
    """The row of a vector id; empty if there is none."""
    return stored.where(F.col("vector_id") == vector_id)
