"""Items that appear together, kept as an incremental pair table.

A changed basket emits signed deltas: -1 for everything its old version held,
+1 for everything its new version holds. A delta is a pair of items, one item
(the marginal) or the basket itself (the total). Deltas are summed on the map
side and merged into counts that are stored in one folder per hash bucket; a
merge reads and rewrites only the buckets that its deltas fall into, and only the
groups that a change touched get their association scores computed again.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, drop_path, list_path, materialize, shared_path

#: Counts: ``b`` is null in a marginal and in a total. Ids are hashes of group and item.
COUNTS = "a BIGINT, b BIGINT, n BIGINT"
#: What an id stands for; ``item`` is null where it stands for the group itself.
ITEMS = "id BIGINT, grp STRING, item STRING"
SCORES = "grp STRING, item_a STRING, item_b STRING, n_ab BIGINT, n_a BIGINT, n_b BIGINT, n_all BIGINT, lift DOUBLE"

#: Items of a basket whose pairs one row emits; the pairs of a larger basket are spread over tasks, block against block.
BLOCK = 256


class SharedId(RuntimeError):
    """Two items have one id under this seed."""


#: Entity types of ner_results whose texts are items (fixed values).
ITEM_TYPES = ("PERSON", "WITNESS", "SUSPECT", "LOCATION", "EVIDENCE", "WEAPON")


def clean_item(text: Column) -> Column:
    """Trimmed (any Unicode blank) and lower-cased."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""))


def item_set(items: Column) -> Column:
    """Sorted distinct non-empty items of an array of texts; null gives an empty array."""
    cleaned = F.transform(F.coalesce(items, F.array().cast("array<string>")), clean_item)
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))))


def case_records(ner_results: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Baskets ``grp, items``: one per chunk of ner_results and per contradiction.

    A row delivered twice counts once; rows without an item or with a null case
    are left out; null arrays count as empty; extra columns are ignored.
    """
    return case_versions(ner_results, contradictions).select("grp", F.col("new").alias("items")).where(F.size("items") > 0)


def case_versions(ner_results: DataFrame, contradictions: DataFrame, late: int = 0) -> DataFrame:
    """Baskets ``grp, old, new``: what was known ``late`` days before the last delivery, null if nothing was, and what is known now.

    Of several deliveries of a row the latest counts. A null time of delivery
    counts as the earliest, as does the missing one of contradictions.
    """
    of_type = F.filter("entities", lambda e: e["entity_type"].isin(*ITEM_TYPES))
    start = F.lit("0001-01-01").cast("timestamp_ntz")
    at = F.coalesce(F.col("ingested_at").cast("timestamp_ntz"), start)
    last = ner_results.agg(F.max(at).alias("last"))
    chunks = ner_results.select("document_id", "chunk_id", F.col("case_id").alias("grp"), item_set(F.transform(of_type, lambda e: e["text"])).alias("items"), at.alias("at"))
    claims = contradictions.select(F.lit(None).cast("string").alias("document_id"), F.col("contradiction_id").alias("chunk_id"), F.col("case_id").alias("grp"), item_set(F.col("shared_entities")).alias("items"), start.alias("at"))
    rows = chunks.withColumn("claim", F.lit(False)).unionByName(claims.withColumn("claim", F.lit(True))).where("grp is not null").crossJoin(F.broadcast(last))  # one row
    early = (F.col("at") <= F.col("last") - F.make_dt_interval(F.lit(late))) | F.col("last").isNull()
    latest = lambda when: F.max(F.when(when, F.struct("at", "items")))["items"]
    return rows.groupBy("grp", "claim", "document_id", "chunk_id").agg(latest(early).alias("old"), latest(F.lit(True)).alias("new")).select("grp", "old", "new")


def _id(seed: int, grp: Column, item: Column | None = None) -> Column:
    return F.xxhash64(F.lit(seed), grp, F.lit("\u0001") if item is None else F.concat(F.lit("\u0002"), item))


def deltas(baskets: DataFrame, sign: int = 1, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Signed deltas ``a, b, n`` of baskets ``grp, items`` (items sorted and distinct), each with its own sign ``n`` if it has one.

    Pairs are two 64-bit ids and not two texts, which is what most of the
    shuffle is made of. The pairs of one basket are emitted by an inner loop
    over its own sorted items, those of a basket of more than ``block`` items
    block by block.
    """
    signed = baskets if "n" in baskets.columns else baskets.withColumn("n", F.lit(sign).cast("long"))
    ids = signed.select("n", _id(seed, F.col("grp")).alias("g"), F.transform("items", lambda x: _id(seed, F.col("grp"), x)).alias("ids"))
    head = ids.select(F.explode(F.concat(F.array("g"), "ids")).alias("a"), F.lit(None).cast("long").alias("b"), "n")
    firsts = ids.where(F.size("ids").between(2, block)).select(F.posexplode("ids").alias("i", "a"), "ids", "n")
    pairs = firsts.select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b"), "n")
    # Large baskets: each block of items meets itself and every later block in a row of its own, and the rows are spread over all tasks.
    large = ids.where(F.size("ids") > block)
    starts = lambda low: F.sequence(low, F.size("ids"), F.lit(block))
    blocks = large.select("ids", "n", F.explode(starts(F.lit(1))).alias("i")).select("i", "ids", "n", F.explode(starts(F.col("i"))).alias("j"))
    cut = blocks.select("i", "j", "n", F.slice("ids", F.col("i"), F.lit(block)).alias("left"), F.slice("ids", F.col("j"), F.lit(block)).alias("right"))
    spread = cut.repartition(baskets.sparkSession.sparkContext.defaultParallelism)
    crossed = spread.select("i", "j", "n", "right", F.posexplode("left").alias("k", "a")).select("a", F.explode(F.when(F.col("i") == F.col("j"), F.expr("slice(right, k + 2, size(right))")).otherwise(F.col("right"))).alias("b"), "n")
    return head.unionByName(pairs).unionByName(crossed)


def named_ids(baskets: DataFrame, seed: int = 0) -> DataFrame:
    """``id, grp, item`` of the groups and items of baskets."""
    items = F.concat(F.array(F.lit(None).cast("string")), "items")
    each = baskets.select("grp", F.explode(items).alias("item")).distinct()
    return each.select(F.when(F.col("item").isNull(), _id(seed, F.col("grp"))).otherwise(_id(seed, F.col("grp"), F.col("item"))).alias("id"), "grp", "item")


class PairTable:
    """Persistent pair and marginal counts below ``path``, one folder per hash bucket, and the items behind their ids.

    A merge writes the buckets it touches as a new version beside the old ones,
    then points to them; what they replace is deleted one merge later, so that a
    reader or a failed merge never sees half a table. Ids are checked to be
    unique in the buckets that are written; ``SharedId`` asks for another seed,
    so counts are exact. ``buckets`` is rounded up to a multiple of the shuffle
    partitions (by default it is their number): a bucket is cut from the hash
    that the sums are shuffled by, so that each lies in one task and is written
    as one file. More buckets make small changes rewrite less.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 1, seed: int = 0) -> None:
        self.spark, self.seed = spark, seed
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = -(-buckets // tasks) * tasks
        self.path = path or shared_path(spark, "pair-table")
        self.version = 0
        #: Version in which each bucket was last written; an empty bucket has none.
        self.written: dict[str, dict[int, int]] = {"counts": {}, "items": {}}
        self.retired: list[str] = []

    def _at(self, what: str, version: int, bucket: int) -> str:
        return f"{self.path}/{what}/version={version}/bucket={bucket}"

    def _read(self, what: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        paths = [self._at(what, v, k) for k, v in sorted(self.written[what].items()) if buckets is None or k in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """The current counts; empty before the first merge."""
        return self._read("counts", COUNTS)

    def items(self) -> DataFrame:
        return self._read("items", ITEMS)

    def _merge(self, what: str, schema: str, changed: DataFrame, keys: tuple[str, ...], merge) -> None:
        """Rewrite the buckets of ``what`` that ``changed`` falls into as ``merge`` of their rows and its own."""
        bucket = F.pmod(F.hash(*keys), F.lit(self.buckets)).cast("int")
        stored = None
        if self.written[what]:
            changed = stored = materialize(merge(changed), "pair-deltas")
            touched = {r["bucket"] for r in stored.select(bucket.alias("bucket")).distinct().collect()}
            changed = merge(self._read(what, schema, touched).unionByName(changed))
        else:
            touched = set()
            changed = merge(changed)
        kept = changed.where("n <> 0") if "n" in changed.columns else changed
        target = f"{self.path}/{what}/version={self.version + 1}"
        kept.withColumn("bucket", bucket).write.option("parquet.enable.dictionary", "false").partitionBy("bucket").parquet(target)
        filled = {int(name.partition("=")[2]) for name in list_path(self.spark, target) if name.startswith("bucket=")}
        now = self.written[what]
        self.retired += [self._at(what, now.pop(k), k) for k in touched | filled if k in now]
        now.update(dict.fromkeys(filled, self.version + 1))
        if stored is not None:
            discard(stored)

    def update(self, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
        """Replace baskets ``old`` by ``new`` (either may be None). Returns the touched groups.

        Counts that reach 0 disappear.
        """
        parts = [b.select("grp", "items", F.lit(s).cast("long").alias("n")) for b, s in ((old, -1), (new, 1)) if b is not None]
        changed = reduce(DataFrame.unionByName, parts)
        gone, self.retired = self.retired, []
        self._merge("counts", COUNTS, deltas(changed, seed=self.seed), ("a", "b"), lambda d: d.groupBy("a", "b").agg(F.sum("n").alias("n")))
        self._merge("items", ITEMS, named_ids(changed, self.seed), ("id",), lambda d: d.groupBy("id").agg(F.collect_set(F.struct("grp", "item")).alias("e")).select("id", F.inline("e")))
        self.version += 1
        fresh = {k for k, v in self.written["items"].items() if v == self.version}
        if not self._read("items", ITEMS, fresh).groupBy("id").count().where("count > 1").isEmpty():
            raise SharedId(f"two items share an id under seed {self.seed}")
        for path in gone:
            drop_path(self.spark, path)
        return changed.select("grp").distinct()

    def drop(self) -> None:
        """Delete all that is stored."""
        drop_path(self.spark, self.path)

    def associations(self, least: int = 5, lift: int = 3, groups: DataFrame | None = None) -> DataFrame:
        """Pairs with ``n_ab >= least`` and ``n_ab * n >= lift * n_a * n_b``, of all groups or of touched ones."""
        counts, items = self.counts(), self.items()
        if groups is not None:
            items = items.join(groups, "grp", "left_semi")
        # An item of a frequent pair is itself frequent, so both sides shrink before they meet.
        pairs = counts.where(F.col("b").isNotNull() & (F.col("n") >= least)).select("a", "b", F.col("n").alias("n_ab"))
        single = counts.where(F.col("b").isNull() & (F.col("n") >= least)).select(F.col("a").alias("id"), "n")
        named = single.join(items, "id")
        total = named.where("item is null").select("grp", F.col("n").alias("n_all"))
        side = lambda s: named.where("item is not null").select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("item").alias(f"item_{s}"), *(["grp"] if s == "a" else []))
        return (
            pairs.join(side("a"), "a").join(side("b"), "b").join(total, "grp")
            .where(F.col("n_ab") * F.col("n_all") >= lift * F.col("n_a") * F.col("n_b"))
            .select("grp", "item_a", "item_b", "n_ab", "n_a", "n_b", "n_all", (F.col("n_ab") * F.col("n_all") / (F.col("n_a") * F.col("n_b")).cast("double")).alias("lift"))
        )


def frequent_pairs(ner_results: DataFrame, contradictions: DataFrame, least: int = 5, lift: int = 3, late: int = 30) -> DataFrame:
    """``case_id, item_a, item_b`` of pairs that occur together much more often than chance, smaller item first.

    The table is built from what was known ``late`` days before the last
    delivery and scored; baskets that came or changed since are merged as signed
    deltas, and the groups they touch scored again. The result is that of all
    rows whatever ``late`` is.
    """
    spark = ner_results.sparkSession
    versions = materialize(case_versions(ner_results, contradictions, late), "baskets")
    side = lambda c: versions.where(F.size(c) > 0).select("grp", F.col(c).alias("items"))
    changed = versions.where(~F.col("old").eqNullSafe(F.col("new")))
    before = changed.where(F.size("old") > 0).select("grp", F.col("old").alias("items"))
    after = changed.where(F.size("new") > 0).select("grp", F.col("new").alias("items"))
    for seed in count():
        table = PairTable(spark, seed=seed)
        try:
            table.update(None, side("old"))
            scores = materialize(table.associations(least, lift), "pair-scores")
            touched = materialize(table.update(before, after), "pair-groups")
        except SharedId:
            table.drop()
            continue
        kept = scores.join(touched, "grp", "left_anti")
        result = materialize(kept.unionByName(table.associations(least, lift, touched)), "pair-scores")
        discard(versions, scores, touched)
        table.drop()
        return result.select(F.col("grp").alias("case_id"), "item_a", "item_b")
    raise AssertionError("unreachable")
