"""Chunks of bounded size that keep page, speaker and order of their blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..batches import bounded
from .base import once
from .order import Ordered

Tokenizer = Callable[[str], list[str]]

# Fixed value: how this family of vocabularies cuts text into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def words(text: str) -> list[str]:
    """Default tokenizer: words with the blanks before them, so that joining gives the text back."""
    import re

    return re.findall(r"\s*\S+|\s+\Z", text)


class Bpe:
    """Tokenizer of a public byte-level vocabulary: ranks in a file of base64 tokens, read once by each worker.

    A token may end inside a letter; ``join`` puts tokens together and only then
    reads them as text.
    """

    _known: dict[str, object] = {}

    def __init__(self, path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", pattern: str = PIECES) -> None:
        self.path, self.pattern = path, pattern

    def encoding(self):
        if self.path not in Bpe._known:
            import base64

            import tiktoken

            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            Bpe._known[self.path] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return Bpe._known[self.path]

    def __call__(self, text: str) -> list[str]:
        return [t.decode("utf-8", "surrogateescape") for t in self.encoding().decode_tokens_bytes(self.encoding().encode_ordinary(text))] if text else []

    @staticmethod
    def join(tokens: list[str]) -> str:
        return "".join(tokens).encode("utf-8", "surrogateescape").decode("utf-8", "replace")

    def count(self, text: str | None) -> int:
        return len(self.encoding().encode_ordinary(text)) if text else 0

    def split(self, text: str | None, most: int) -> list[str]:
        """Pieces of at most ``most`` tokens; none of an empty text."""
        tokens = self(text or "")
        return [text] if 0 < len(tokens) <= most else [self.join(tokens[i : i + most]) for i in range(0, len(tokens), most)]


def bpe_counts(chunks: DataFrame, tokenizer: Bpe | None = None) -> DataFrame:
    """``document_id, chunk_id, tokens``: tokens of each chunk's whole text, 0 for null and empty ones; a chunk delivered twice counts once."""
    ship_package(chunks.sparkSession)
    bpe = tokenizer or Bpe()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bpe.count(t) for t in b.column(2).to_pylist()], pa.int32())], names=["document_id", "chunk_id", "tokens"])

    own = once(chunks.select("document_id", "chunk_id", "text"), "document_id", "chunk_id")
    return own.mapInArrow(scan, "document_id STRING, chunk_id STRING, tokens INT")


def token_count(text: Column) -> Column:
    """Tokens of the default tokenizer, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def boundary_groups(blocks: DataFrame) -> DataFrame:
    """Groups of one page and speaker, in the order in which they first appear: ``document_id, page, speaker, grp, n_blocks, n_tokens, confidence``.

    A null speaker is a speaker of its own. Blocks that come back to a page and
    speaker join the first group. The confidence is the lowest, 1 without any.
    """
    own = once(blocks.select("document_id", "block_id", "ord", "page", "speaker", "clean_text", "confidence"), "document_id", "block_id")
    grouped = own.groupBy("document_id", "page", "speaker").agg(
        F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_blocks"), F.sum(token_count(F.col("clean_text"))).alias("n_tokens"),
        F.coalesce(F.min(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))), F.lit(1.0)).alias("confidence"),
    )
    return Ordered(grouped, ["document_id"], ["first_ord", "page", "speaker"]).number("grp").select("document_id", "page", "speaker", "grp", "n_blocks", "n_tokens", "confidence")


CHUNK = "case_id STRING, document_id STRING, page INT, speaker STRING, first_ord INT, part INT, text STRING, source_block_ids ARRAY<STRING>, token_count INT, chunk_confidence DOUBLE"


def _pack(frames: Iterator[pd.DataFrame], most: int, tokenizer: Tokenizer) -> Iterator[pd.DataFrame]:
    """Greedy packing over blocks sorted by group; the state of one open chunk is all that is kept."""
    columns = [c.split()[0] for c in CHUNK.split(", ")]
    join = getattr(tokenizer, "join", "".join)
    group, part, first = None, 0, 0
    texts: list[str] = []
    ids: list[str] = []
    scores: list[float] = []
    size = 0
    out: list[tuple] = []

    def close() -> None:
        nonlocal part, size
        if texts:
            joined = " ".join(texts)
            n = len(tokenizer(joined))
            if n:
                part += 1
                out.append((*group, first, part, joined, list(ids), n, min(scores)))
        texts.clear()
        ids.clear()
        scores.clear()
        size = 0

    for f in frames:
        for case, doc, page, speaker, named, block, ord_, text, confidence in zip(*(f[c] for c in ("case_id", "document_id", "page", "speaker", "named", "block_id", "ord", "clean_text", "confidence"))):
            key = (case, doc, None if pd.isna(page) else int(page), speaker if named else None)
            if key != group:
                close()
                group, part, first = key, 0, int(ord_)
            tokens = tokenizer(text)
            score = 1.0 if pd.isna(confidence) else max(0.0, min(1.0, float(confidence)))
            if len(tokens) > most:
                close()
                for i in range(0, len(tokens), most):
                    texts.append(join(tokens[i : i + most]).strip())
                    ids.append(block)
                    scores.append(score)
                    close()
                continue
            if size + len(tokens) > most:
                close()
            texts.append(text)
            ids.append(block)
            scores.append(score)
            size += len(tokens)
        if out:
            yield pd.DataFrame(out, columns=columns)
            out.clear()
    close()
    if out:
        yield pd.DataFrame(out, columns=columns)


def chunk_blocks(blocks: DataFrame, most: int = 1000, tokenizer: Tokenizer = words) -> DataFrame:
    """Chunks of at most ``most`` tokens: ``chunk_id`` (restarts in each document), page, speaker, text, block ids, tokens, lowest confidence.

    Blocks are packed in order within their page and speaker; a block over the
    limit is cut into slices of ``most`` tokens. Null and empty texts add
    nothing. Blocks stream through a sort, so groups of any size work.
    """
    ship_package(blocks.sparkSession)
    own = once(blocks.select("case_id", "document_id", "block_id", "ord", "page", "speaker", "clean_text", "confidence"), "document_id", "block_id").where("length(clean_text) > 0 and document_id is not null and ord is not null")
    named = own.withColumn("named", F.col("speaker").isNotNull())
    keys = ["case_id", "document_id", "page", "named", "speaker"]
    placed = named.repartition(*keys).sortWithinPartitions(*keys, "ord", "block_id")
    packed = placed.mapInPandas(lambda fs: _pack(fs, most, tokenizer), CHUNK)
    numbered = Ordered(packed, ["document_id"], ["first_ord", "page", "speaker", "part"]).number("n")
    return numbered.withColumn("chunk_id", F.format_string("C-%04d", F.col("n"))).withColumn("page_range", F.array("page", "page")).select("chunk_id", "case_id", "document_id", "page_range", "speaker", "text", "source_block_ids", "token_count", "chunk_confidence")


def boundary_check(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Whether all blocks of a chunk share page and speaker: ``document_id, chunk_id, one_page, one_speaker``."""
    own = once(chunks.select("document_id", "chunk_id", "source_block_ids"), "document_id", "chunk_id")
    each = own.select("document_id", "chunk_id", F.explode("source_block_ids").alias("block_id"))
    parts = once(blocks.select("document_id", "block_id", "page", "speaker"), "document_id", "block_id")
    joined = each.join(parts, ["document_id", "block_id"])
    return joined.groupBy("document_id", "chunk_id").agg((F.countDistinct("page") <= 1).alias("one_page"), (F.countDistinct(F.coalesce("speaker", F.lit("\u0001"))) <= 1).alias("one_speaker"))
