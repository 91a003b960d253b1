"""Confidences of extracted blocks, and the merge of recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .base import once
from .order import Ordered

# Labels of layout items and the block types they stand for; the first that a label contains holds.
ITEM_TYPES = (
    ("paragraph", "paragraph"), ("text", "paragraph"), ("heading", "heading"), ("title", "heading"), ("section_header", "heading"), ("section-header", "heading"),
    ("table", "table"), ("list_item", "list_item"), ("list-item", "list_item"), ("listitem", "list_item"), ("caption", "caption"), ("footnote", "footnote"),
    ("code", "code"), ("formula", "formula"), ("equation", "formula"),
)


def block_type(label):
    """Type of a layout label; paragraph for null and unknown ones."""
    low = F.lower(label)
    out = None
    for part, kind in ITEM_TYPES:
        out = F.when(low.contains(part), kind) if out is None else out.when(low.contains(part), kind)
    return out.otherwise("paragraph")


def _blocks(content: DataFrame) -> DataFrame:
    own = once(content.select("case_id", "document_id", "block_id", "ord", "page", "type", "text", "confidence"), "document_id", "block_id")
    return own.withColumn("score", scores.block_confidence(F.col("confidence"), F.lit(False)))


def block_types(content: DataFrame) -> DataFrame:
    """Number of blocks of each type of each document."""
    own = once(content.select("document_id", "block_id", "type"), "document_id", "block_id")
    return own.groupBy("document_id", block_type(F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def page_confidence(content: DataFrame) -> DataFrame:
    """Mean confidence of every page from 1 to the last of each document; 1 for a page without blocks."""
    own = _blocks(content).where("page is not null")
    means = own.groupBy("document_id", "page").agg(F.round(F.avg("score"), 9).alias("confidence"))
    pages = own.groupBy("document_id").agg(F.max("page").alias("last")).select("document_id", F.explode(F.sequence(F.lit(1), F.greatest("last", F.lit(1)))).alias("page"))
    return pages.join(means, ["document_id", "page"], "left").select("document_id", "page", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def low_pages(content: DataFrame, least: float = 0.7) -> DataFrame:
    return page_confidence(content).where(F.col("confidence") < least)


def document_confidence(content: DataFrame) -> DataFrame:
    """Mean confidence of each document, by length of text (1 at least) and plain."""
    weight = F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0)))
    own = _blocks(content)
    return own.groupBy("document_id").agg(F.round(F.sum(F.col("score") * weight) / F.sum(weight), 9).alias("weighted"), F.round(F.avg("score"), 9).alias("plain"), F.count(F.lit(1)).alias("n_blocks"))


# Confidences from which a document is accepted, or to be looked through.
ACCEPTED, FLAGGED = 0.85, 0.70

#: Blocks whose hashes are hashed together; the hash of a document is that of these hashes in order.
HASH_RUN = 1024


def status(confidence: Column) -> Column:
    """What a document's confidence is good for; null counts as 0."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= ACCEPTED, "ACCEPTED").when(c >= FLAGGED, "FLAGGED_FOR_REVIEW").otherwise("REJECTED")


def document_hashes(content: DataFrame) -> DataFrame:
    """``document_id, hash``: SHA-256 over the blocks (id, type, text, page) in order, by runs of ``HASH_RUN``, so that no task holds a whole document."""
    own = once(content.select("document_id", "block_id", "ord", "type", "text", "page"), "document_id", "block_id")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = F.sha2(F.concat_ws("\u0001", *map(part, ("block_id", "type", "text", "page"))), 256)
    joined = lambda *order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "h"))), lambda x: x["h"]), ""), 256).alias("h")
    runs = own.withColumn("h", each).groupBy("document_id", F.floor(F.coalesce("ord", F.lit(0)) / HASH_RUN).alias("run")).agg(joined("ord", "block_id"))
    return runs.groupBy("document_id").agg(joined("run")).select("document_id", F.concat(F.lit("sha256:"), "h").alias("hash"))


def results(content: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row per document: ``case_id, document_id, source_file, pages, n_blocks, confidence, status, hash``.

    The confidence is weighted by length and rounded to 2 digits; ``failed``
    (``case_id, document_id, source_file``) are documents without any block: no
    pages, confidence 0, rejected.
    """
    own = once(content.select("case_id", "document_id", "source_file", "block_id", "page"), "document_id", "block_id")
    found = own.groupBy("document_id").agg(F.min("case_id").alias("case_id"), F.min("source_file").alias("source_file"), F.coalesce(F.max("page"), F.lit(0)).alias("pages"), F.count(F.lit(1)).alias("n_blocks"))
    weighed = document_confidence(content).select("document_id", F.col("weighted").alias("confidence"))
    whole = found.join(weighed, "document_id").join(document_hashes(content), "document_id").select("case_id", "document_id", "source_file", "pages", "n_blocks", F.round("confidence", 2).alias("confidence"), status(F.col("confidence")).alias("status"), "hash")
    if failed is None:
        return whole
    none = failed.select("case_id", "document_id", "source_file", F.lit(0).alias("pages"), F.lit(0).cast("long").alias("n_blocks"), F.lit(0.0).alias("confidence"), F.lit("REJECTED").alias("status"), F.lit(None).cast("string").alias("hash"))
    return whole.unionByName(none.join(whole.select("document_id"), "document_id", "left_anti"))


def renumbered(content: DataFrame) -> DataFrame:
    """``document_id, ord, block_id, new_id``: blocks numbered b1, b2 and so on in order."""
    own = once(content.select("document_id", "block_id", "ord"), "document_id", "block_id")
    return Ordered(own, ["document_id"], ["ord", "block_id"]).number("n").select("document_id", "ord", "block_id", F.concat(F.lit("b"), "n").alias("new_id"))


def replace_pages(native: DataFrame, recognised: DataFrame) -> DataFrame:
    """Native blocks, with the blocks of recognised pages in place of their own: both ``document_id, page, ord, text``."""
    kept = native.join(recognised.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti")
    columns = ["document_id", "page", "ord", "text"]
    both = kept.select(*columns).unionByName(recognised.select(*columns))
    numbered = Ordered(both, ["document_id"], ["page", "ord", "text"]).number("n")
    return numbered.select(*columns, F.concat(F.lit("b"), "n").alias("new_id"))


def word_paragraphs(boxes: DataFrame) -> DataFrame:
    """Paragraphs of recognised words ``document_id, page, i, word, percent``: blank words separate them, words below 0 percent are left out."""
    order = Window.partitionBy("document_id", "page").orderBy("i")
    blank = F.coalesce(F.trim("word"), F.lit("")) == ""
    marked = boxes.withColumn("blank", blank).withColumn("island", F.sum(F.col("blank").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = marked.where(~F.col("blank") & (F.col("percent") >= 0))
    return kept.groupBy("document_id", "page", "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("text"), scores.recognition_confidence(F.avg("percent")).alias("confidence")
    )


def block_hashes(content: DataFrame) -> DataFrame:
    """``document_id, block_id, hash``: SHA-256 of each text; null for null."""
    own = once(content.select("document_id", "block_id", "text"), "document_id", "block_id")
    return own.select("document_id", "block_id", scores.content_hash(F.col("text")).alias("hash"))
