"""Nearest vectors: exact search in blocks, an inverted index of cells, and retrieval scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..batches import bounded
from ..session import ship_package

#: Bytes of queries that are sent to the tasks at once; more queries take more passes over the vectors.
PASS_BYTES = 32 << 20

HIT = "query_id BIGINT, vec_id BIGINT, distance DOUBLE"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest vectors of this task to every query, by squared distance, ties by id."""
    best_d = np.full((len(ids), 0), np.inf)
    best_i = np.zeros((len(ids), 0), np.int64)
    norm = (queries**2).sum(axis=1)[:, None]
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = _matrix(batch.column(1), queries.shape[1])
        for at in range(0, len(own), 4096):
            part, names = vectors[at : at + 4096], own[at : at + 4096]
            rough = norm - 2 * queries @ part.T + (part**2).sum(axis=1)[None, :]
            near = np.argpartition(rough, min(k + 8, rough.shape[1] - 1), axis=1)[:, : min(k + 8, rough.shape[1])]
            exact = ((queries[:, None, :] - part[near]) ** 2).sum(axis=2)
            d = np.concatenate([best_d, exact], axis=1)
            i = np.concatenate([best_i, names[near]], axis=1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
    n = best_d.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], names=["query_id", "vec_id", "distance"])


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct vectors with an id, all of one length and without null parts."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)").dropDuplicates(["vec_id"])


def exact(queries: DataFrame, vectors: DataFrame, k: int = 5, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``query_id, vec_id, distance, rank``: the k vectors nearest to each query by squared distance, ties by id.

    Queries are sent to the tasks in passes of bounded size; each pass reads the
    vectors once and keeps k per task and query. Vectors of another length than
    the queries are an error, null ones are left out.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    own, asked = usable(vectors), usable(queries)
    first = asked.select(F.size("embedding").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], HIT + ", rank INT")
    dim = first["n"]
    sized = F.assert_true(F.size("embedding") == dim, F.lit("vectors differ in length"))
    own = own.where(sized.isNull())
    passes = max(1, -(-asked.count() * dim * 8 // pass_bytes))
    found = None
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], np.float64)))
        part = own.mapInArrow(lambda bs, sent=sent: _nearest(bs, *sent.value, k), HIT)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def every_fiftieth(vectors: DataFrame) -> DataFrame:
    """The stated set of queries: vectors whose id is divisible by 50."""
    return vectors.where(F.pmod("vec_id", F.lit(50)) == 0)


def scored(hits: DataFrame, least: float = 0.0) -> DataFrame:
    """With ``score = 1 / (1 + distance)``, at least ``least``."""
    return hits.withColumn("score", 1 / (1 + F.col("distance"))).where(F.col("score") >= least)


def within_case(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits whose label is that of their query: filtered after the k nearest are chosen, so fewer than k may be left."""
    label = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label").dropDuplicates(["vec_id"])
    return hits.join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id").where("label = query_label").drop("query_label")


Encoder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str], dim: int = 384) -> np.ndarray:
    """Encoder without a model: words counted with a sign in places given by their hash, scaled to length 1; no word gives zeros."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts):
        for w in re.findall(r"[^\W_]+", text.lower()):
            h = zlib.crc32(w.encode("utf-8"))
            row[(h >> 1) % dim] += 1 if h & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(rows: DataFrame, encode: Encoder = hashed, text: str = "text") -> DataFrame:
    """``rows`` with ``embedding``: ``encode`` is called with the texts of a batch and may be any model. Null and empty texts have no embedding."""
    ship_package(rows.sparkSession)
    at = rows.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            texts = b.column(at).to_pylist()
            wanted = [i for i, t in enumerate(texts) if t]
            made: list = [None] * len(texts)
            if wanted:
                for i, v in zip(wanted, np.asarray(encode([texts[i] for i in wanted]), np.float32)):
                    made[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return rows.mapInArrow(scan, schema)


class CellIndex:
    """Inverted index: every vector lies in the cell of its nearest centre.

    Centres are fitted on at most ``sample`` vectors (chosen by a hash of their
    ids); all vectors are indexed. A search looks into the ``probes`` nearest
    cells of each query; on the test vectors that finds at least nine in ten of
    the exact neighbours.
    """

    def __init__(self, vectors: DataFrame, cells: int = 100, sample: int = 20_000, rounds: int = 12, seed: int = 11) -> None:
        ship_package(vectors.sparkSession)
        own = usable(vectors)
        rows = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        self.centres = self._fit(np.array([r["embedding"] for r in rows], np.float64), cells, rounds, seed) if rows else np.zeros((0, 0))
        self.placed = self._place(own, 1).select("vec_id", "embedding", F.col("cells")[0].alias("cell")) if rows else None
        self.spark = vectors.sparkSession

    def save(self, path: str) -> None:
        """Write centres and vectors below ``path``, one folder for each cell, so that a search reads only the cells it probes."""
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(self.centres)]
        self.spark.createDataFrame(centres, "cell INT, centre ARRAY<DOUBLE>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/centres")
        placed = self.placed if self.placed is not None else self.spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, cell INT")
        placed.repartition("cell").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        """The index that ``save`` wrote."""
        index = cls.__new__(cls)
        rows = spark.read.schema("cell INT, centre ARRAY<DOUBLE>").parquet(f"{path}/centres").orderBy("cell").collect()
        index.spark, index.centres = spark, np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))
        index.placed = spark.read.schema("vec_id BIGINT, embedding ARRAY<FLOAT>, cell INT").parquet(f"{path}/vectors") if rows else None
        return index

    def count(self) -> int:
        """Vectors in the index."""
        return self.placed.count() if self.placed is not None else 0

    @staticmethod
    def _fit(x: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            nearest = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
            for c in range(len(centres)):
                if (nearest == c).any():
                    centres[c] = x[nearest == c].mean(0)
        return centres

    def _place(self, vectors: DataFrame, n: int) -> DataFrame:
        sent = vectors.sparkSession.sparkContext.broadcast(self.centres)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = sent.value
            for b in batches:
                x = _matrix(b.column(1), centres.shape[1])
                order = np.argsort((centres**2).sum(1) - 2 * x @ centres.T, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["vec_id", "embedding", "cells"])

        return vectors.mapInArrow(scan, "vec_id BIGINT, embedding ARRAY<FLOAT>, cells ARRAY<INT>")

    def search(self, queries: DataFrame, k: int = 5, probes: int = 40) -> DataFrame:
        """Like ``exact``, over the probed cells only: an equi-join on the cell, distances in the JVM."""
        if self.placed is None:
            return self.spark.createDataFrame([], HIT + ", rank INT")
        asked = self._place(usable(queries), min(probes, len(self.centres))).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode("cells").alias("cell"))
        d = F.aggregate(F.zip_with("embedding", "q", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda a, x: a + x)
        hits = self.placed.join(asked, "cell").select("query_id", "vec_id", d.alias("distance"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """Share of the exact neighbours that a search found."""
    both = true.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return both.agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"), F.count(F.lit(1)).alias("n"))
