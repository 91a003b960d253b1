"""Encoding a corpus with a public byte-level BPE vocabulary by merge replay.

The distinct pieces of the whole corpus are counted and spread over hash buckets.
Each bucket replays the merges once for all its pieces: an inverted index maps
every token pair to the positions where it stands, a heap gives the pairs in rank
order, each merge is applied to all its positions at once, and only the
neighbours of a merged pair are indexed anew. Texts then look their pieces up:
the most frequent ones, a bounded number, in a table that every task holds, the
others by a join. A piece costs its merges once in the corpus, however often and
wherever it stands.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import bounded
from ..session import materialize, ship_package

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

#: Pieces whose ids every task holds (about 40 MB), and the letters that such a piece has at most.
MOST_COMMON, LONGEST_COMMON = 200_000, 40

#: Bytes of pieces that share one inverted index (some 300 bytes of memory for each).
INDEX_BYTES = 1 << 20

# Fixed value: how this family of vocabularies cuts text into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes of every token with its id, which is also the rank of its merge."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def replay(pieces: Iterable[str], ranks: dict[bytes, int], tokens: list[bytes]) -> dict[str, list[int]]:
    """Ids of each distinct piece.

    All pieces stand in one row of symbols with gaps between them; ``left`` and
    ``right`` link the symbols that are alive.
    """
    symbol: list[int] = []
    left: list[int] = []
    right: list[int] = []
    starts: list[tuple[str, int]] = []
    for piece in pieces:
        raw = piece.encode("utf-8")
        first = len(symbol)
        starts.append((piece, first))
        symbol += [ranks[raw[i : i + 1]] for i in range(len(raw))]
        left += [-1, *range(first, first + len(raw) - 1)]
        right += [*range(first + 1, first + len(raw)), -1]

    index: dict[tuple[int, int], list[int]] = defaultdict(list)
    for at, after in enumerate(right):
        if after >= 0:
            index[symbol[at], symbol[after]].append(at)
    joined: dict[tuple[int, int], int | None] = {}
    heap: list[tuple[int, tuple[int, int]]] = []

    def enter(pair: tuple[int, int]) -> None:
        if pair not in joined:
            joined[pair] = ranks.get(tokens[pair[0]] + tokens[pair[1]])
        if joined[pair] is not None:
            heapq.heappush(heap, (joined[pair], pair))

    for pair in index:
        enter(pair)
    while heap:
        rank, pair = heapq.heappop(heap)
        positions = index.pop(pair, None)
        if not positions:
            continue
        a, b = pair
        positions.sort()
        touched = set()
        for at in positions:
            after = right[at]
            if after < 0 or symbol[at] != a or symbol[after] != b:
                continue  # one of the two has merged since
            symbol[at] = rank
            symbol[after] = -1
            right[at] = beyond = right[after]
            if beyond >= 0:
                left[beyond] = at
                key = (rank, symbol[beyond])
                index[key].append(at)
                touched.add(key)
            before = left[at]
            if before >= 0:
                key = (symbol[before], rank)
                index[key].append(before)
                touched.add(key)
        for key in touched:
            enter(key)
    ids = {}
    for piece, at in starts:
        out = []
        while at >= 0:
            out.append(symbol[at])
            at = right[at]
        ids[piece] = out
    return ids


def _cutter():
    import regex

    return regex.compile(PIECES).findall


def _count(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a task's texts with their number; partial sums leave whenever ``most`` distinct ones are held."""
    cut, total = _cutter(), Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"])
        total.clear()
        return rows

    for batch in bounded(batches):
        for text in batch.column(0).to_pylist():
            total.update(cut(text))
            if len(total) > most:
                yield flush()
    yield flush()


def _replay(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Ids of the pieces of a bucket, one inverted index for as many as fit into memory."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    for batch in bounded(batches, INDEX_BYTES):
        ids = replay(batch.column(0).to_pylist(), ranks, tokens)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(ids.values()), pa.list_(pa.int32()))], names=["piece", "n", "ids"])


def _look_up(batches: Iterator[pa.RecordBatch], known: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
    """Texts as runs of ids with a gap for each rare piece, and those pieces in order."""
    cut = _cutter()
    for batch in bounded(batches):
        runs, rare = [], []
        for text in batch.column(1).to_pylist():
            own, gaps, run = [], [], []
            for p in cut(text) if text else ():
                found = known.get(p)
                if found is None:
                    own.append(run)
                    gaps.append(p)
                    run = []
                else:
                    run += found
            runs.append([*own, run])
            rare.append(gaps)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.list_(pa.int32()))), pa.array(rare, pa.list_(pa.string()))], names=["doc_id", "runs", "rare"])


def piece_ids(documents: DataFrame, vocabulary: str = VOCABULARY, most_held: int = 200_000) -> DataFrame:
    """``piece, n, ids`` of every distinct piece of all texts: how often it stands in the corpus, and its ids.

    Pieces are summed on the map side and spread by their hash over as many
    buckets as there are shuffle partitions; each bucket is replayed by itself.
    """
    spark = documents.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    pieces = documents.select("text").where(F.length("text") > 0).mapInArrow(lambda bs: _count(bs, most_held), "piece STRING, n BIGINT")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # An explicit number, as replaying is work for the processor: adaptive execution would put small buckets together into one task.
    counted = pieces.groupBy("piece").agg(F.sum("n").alias("n")).repartition(buckets, "piece")
    return counted.mapInArrow(lambda bs: _replay(bs, ranks.value), "piece STRING, n BIGINT, ids ARRAY<INT>")


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, most_common: int = MOST_COMMON) -> DataFrame:
    """``doc_id, ids`` of every document, without special tokens.

    Null and empty texts have an empty list; strings of special tokens are
    ordinary text; a doc_id that repeats or is null has a row for each of its
    texts. The vocabulary (under 1 MB, of fixed size) is read by the driver and
    sent to the executors once, as are the ids of the ``most_common`` pieces; all
    other pieces meet their ids in a join. Extra columns are ignored.
    """
    spark: SparkSession = documents.sparkSession
    encoded = materialize(piece_ids(documents, vocabulary), "pieces")
    short = encoded.where(F.length("piece") <= LONGEST_COMMON)
    common = {r["piece"]: r["ids"] for r in short.orderBy(F.desc("n"), "piece").limit(most_common).select("piece", "ids").toLocalIterator()}
    sent = spark.sparkContext.broadcast(common)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    looked = texts.mapInArrow(lambda bs: _look_up(bs, sent.value), "doc_id BIGINT, runs ARRAY<ARRAY<INT>>, rare ARRAY<STRING>")
    # The number of a row is written down with it, so that it stays the same when a lost task is run again.
    skeleton = materialize(looked.withColumn("row", F.monotonically_increasing_id()), "encoded")
    whole = skeleton.where(F.size("rare") == 0).select("doc_id", F.col("runs")[0].alias("ids"))
    open_ = skeleton.where(F.size("rare") > 0)
    gaps = open_.select("row", F.posexplode("rare").alias("pos", "piece")).join(encoded.select("piece", "ids"), "piece")
    filled = gaps.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("found"))
    ids = F.flatten(F.concat(F.slice("runs", 1, 1), F.flatten(F.transform("found", lambda x: F.array(x["ids"], F.col("runs")[x["pos"] + 1])))))
    return whole.unionByName(open_.select("row", "doc_id", "runs").join(filled, "row").select("doc_id", ids.alias("ids")))
