"""Order inside groups of any size: numbers, what came last, what comes next.

A window puts all rows of a group into one task. Where the input is too large for
that to be safe, rows are cut into ranges of group and order instead, so that one
group may be many tasks; a short summary of each range then carries numbers and
values over from one range to the next. Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, size_in_bytes

#: Bytes of input, by Catalyst's estimate, up to which even a group that holds all rows may be one task.
WINDOW_BYTES = 1 << 30


class Ordered:
    """Rows of ``df`` in the order of columns ``order`` (ascending, nulls first) within ``group``; the order must be total."""

    def __init__(self, df: DataFrame, group: list[str], order: list[str], window_bytes: int = WINDOW_BYTES) -> None:
        self.group, self.order = group, order
        self.ranged = size_in_bytes(df) > window_bytes
        if self.ranged:
            spark = df.sparkSession
            ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
            # Written, as a second run might cut the ranges elsewhere.
            df = materialize(df.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
        self.df = df
        self.keys = [*group, "_range"] if self.ranged else group
        self.window = Window.partitionBy(*self.keys).orderBy(*order)
        self.before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def _carry(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        """``df`` with the summary of its range; groups may be null."""
        other = summary.select(*[F.col(c).alias(f"_{c}") for c in self.keys], *[c for c in summary.columns if c not in self.keys])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.keys])
        return df.join(other, same).drop(*[f"_{c}" for c in self.keys], *(["_range"] if "_range" in df.columns else []))

    def number(self, name: str) -> DataFrame:
        """With the number of each row in its group, from 1."""
        local = self.df.withColumn(name, F.row_number().over(self.window))
        if not self.ranged:
            return local
        sizes = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_size"))
        ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_size").over(self.before), F.lit(0))).drop("_size")
        return self._carry(local, ahead).withColumn(name, (F.col(name) + F.col("_ahead")).cast("int")).drop("_ahead")

    def last(self, value: str, name: str) -> DataFrame:
        """With the last value that isn't null at or before each row."""
        local = self.df.withColumn(name, F.last(value, ignorenulls=True).over(self.window.rowsBetween(Window.unboundedPreceding, 0)))
        if not self.ranged:
            return local
        ends = self.df.groupBy(*self.keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*self.order))).alias("_end"))
        carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(self.before)).drop("_end")
        return self._carry(local, carried).withColumn(name, F.coalesce(name, "_carried")).drop("_carried")

    def following(self, *columns: str) -> DataFrame:
        """With ``next_`` columns of the row after each; null for the last of a group."""
        nexts = F.struct(*[F.col(c).alias(f"next_{c}") for c in columns])
        local = self.df.withColumn("_next", F.lead(nexts).over(self.window))
        if self.ranged:
            firsts = self.df.groupBy(*self.keys).agg(F.min_by(nexts, F.struct(*self.order)).alias("_first"))
            after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*self.group).orderBy("_range"))).drop("_first")
            local = self._carry(local, after).withColumn("_next", F.coalesce("_next", "_after")).drop("_after")
        return local.select(*[c for c in local.columns if c not in ("_next", "_range")], "_next.*")
