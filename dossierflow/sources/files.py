"""Documents from files: any parser behind one function, errors kept as rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..session import ship_package

# File types that are taken in; any other needs a parser of its own.
EXTENSIONS = (".pdf", ".docx", ".png", ".jpg", ".jpeg", ".tiff", ".tif")

Parser = Callable[[bytes], list[tuple[str, str, int, float | None]]]
BLOCKS = "path STRING, document_id STRING, ord INT, block_id STRING, type STRING, text STRING, page INT, confidence DOUBLE, error STRING"


def allowed(path: Column, more: Iterable[str] = ()) -> Column:
    """Whether the file type is taken in, or one of ``more``."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*EXTENSIONS, *more)


def plain_text(content: bytes) -> list[tuple[str, str, int, float | None]]:
    """Blocks (type, text, page, confidence) of a text file: paragraphs between blank lines, pages at form feeds."""
    text = content.decode("utf-8", errors="replace")
    return [("paragraph", part.strip(), n, None) for n, page in enumerate(text.split("\f"), 1) for part in re.split(r"\n\s*\n", page) if part.strip()]


def _parse(frames: Iterator[pd.DataFrame], parsers: dict[str, Parser]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, doc, content in zip(f["path"], f["document_id"], f["content"]):
            try:
                blocks = parsers[PurePosixPath(path).suffix.lower()](bytes(content))
                rows += [(path, doc, i, f"b{i + 1}", kind, text, page, 0.90 if confidence is None else confidence, None) for i, (kind, text, page, confidence) in enumerate(blocks)]
            except Exception as e:  # one bad file must not end the whole run
                rows.append((path, doc, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def read_documents(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Blocks of all files below ``path`` whose type is taken in, or has a parser, and whose content isn't empty.

    Plain text has a parser here; others come from the caller.

    The document id comes from the content, so equal files are one document. A
    file without parser, or whose parser fails, is one row with ``error``.
    """
    ship_package(spark)
    known = {".txt": plain_text} | (parsers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(allowed(F.col("path"), known) & (F.col("length") > 0))
    keyed = files.select("path", F.concat(F.lit("doc-"), F.substring(F.sha2("content", 256), 1, 32)).alias("document_id"), "content")
    return keyed.mapInPandas(lambda fs: _parse(fs, known), BLOCKS)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, hash`` of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", scores.content_hash(F.col("content")).alias("hash"))


def changed_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files whose hash isn't the expected one ``path, hash``, or that are gone."""
    now = file_hashes(spark, path).withColumnRenamed("hash", "found")
    return expected.join(now, "path", "left").where(~F.col("hash").eqNullSafe(F.col("found")))
