"""Property graph of entities: nodes, five kinds of edges, upserts, statistics and neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .base import once

# Node type of each entity type.
NODE_TYPES = {
    "PERSON": "Person", "WITNESS": "Person", "SUSPECT": "Person", "LOCATION": "Location", "ADDRESS": "Location", "TIME": "Event", "EVIDENCE": "Evidence", "WEAPON": "Evidence", "PHONE": "Evidence",
}
# Phrases on lower case that let the edges of a chunk be drawn.
WITNESSED = r"(?U)\b(?:saw|witnessed|observed|noticed|watched)\b"
FOUND_IN = r"(?U)\b(?:found|located|discovered)\s+(?:at|in|near)\b"
OWNS = r"(?U)\b(?:his|her|their)\s+(\w+)|(\w+(?:\s+\w+)?)'s\s+(\w+)|\b(?:owned\s+by|belongs?\s+to)\s+(\w+(?:\s+\w+)?)"
ARGUED_WITH = r"(?U)\b(\w+(?:\s+\w+)?)\s+(?:argued|fought|quarreled|had\s+an?\s+argument)\s+with\s+(\w+(?:\s+\w+)?)"
ACCOMPANIED_BY = r"(?U)\b(\w+(?:\s+\w+)?)\s+(?:with|accompanied\s+by|together\s+with)\s+(\w+(?:\s+\w+)?)"
# Phrases by which a text is said to hold an edge type.
EDGE_CUES = {
    "WITNESSED": (r"\b(?:saw|witnessed|observed|noticed|watched)\b",),
    "FOUND_IN": (r"\b(?:found\s+(?:at|in|near)|located\s+(?:at|in)|discovered\s+(?:at|in))\b",),
    "OWNS": (r"\b(?:his|her|their|my)\s+\w+", r"\b(?:owned\s+by|belongs?\s+to|possession\s+of)\b"),
    "ACCOMPANIED_BY": (r"\b(?:with|accompanied\s+by|together\s+with|alongside)\b",),
    "ARGUED_WITH": (r"\b(?:argued\s+with|fought\s+with|dispute\s+with|quarreled\s+with)\b", r"\b(?:altercation\s+with|confrontation\s+with|argument\s+with)\b"),
}
PEOPLE, PLACES, THINGS, EVENTS = ("PERSON", "WITNESS", "SUSPECT"), ("LOCATION", "ADDRESS"), ("EVIDENCE", "WEAPON", "PHONE"), ("TIME",)
CHUNK = ["case_id", "document_id", "chunk_id"]


def node_type(entity_type: Column) -> Column:
    """Null for types that have no node."""
    return F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])[F.upper(entity_type)]


def edge_cues(text: Column) -> Column:
    """Edge types whose phrases occur in a text."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns)), kind) for kind, patterns in EDGE_CUES.items()]))


def _identified(entities: DataFrame) -> DataFrame:
    kind = node_type(F.col("entity_type"))
    return entities.withColumn("node_type", kind).where("node_type is not null and text is not null").withColumn("node_id", scores.node_id(F.col("node_type"), F.col("text"), F.col("case_id")))


def nodes(entities: DataFrame) -> DataFrame:
    """One node per id: the first entity in order of document, chunk and position gives its name and origin; ``n`` counts all, ``best`` is the highest confidence."""
    order = F.struct("document_id", "chunk_id", "pos")
    return _identified(entities).groupBy("node_id").agg(
        F.first("node_type").alias("node_type"), F.first("case_id").alias("case_id"), F.min_by("text", order).alias("name"), F.min_by("document_id", order).alias("document_id"),
        F.min_by("chunk_id", order).alias("chunk_id"), F.min_by("confidence", order).alias("confidence"), F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n"),
    )


def document_nodes(chunks: DataFrame) -> DataFrame:
    """A node for each document, with its first chunk."""
    own = once(chunks.select("case_id", "document_id", "chunk_id", "ord"), "document_id", "chunk_id")
    return own.groupBy("case_id", "document_id").agg(F.min_by("chunk_id", F.struct("ord", "chunk_id")).alias("chunk_id")).select(scores.node_id(F.lit("Document"), F.col("document_id"), F.col("case_id")).alias("node_id"), "case_id", "document_id", "chunk_id")


def upsert(stored: DataFrame) -> DataFrame:
    """Stored nodes with one row per id and case: properties of the first, highest confidence of all."""
    order = F.struct("provenance.document_id", "provenance.source_chunk_id", "provenance.confidence")
    return stored.groupBy("node_id", "case_id").agg(F.first("node_type").alias("node_type"), F.min_by(F.col("properties")["name"], order).alias("name"), F.max("provenance.confidence").alias("confidence"), F.countDistinct("provenance.document_id").alias("n_documents"))


def upsert_edges(stored: DataFrame, more: DataFrame, node: DataFrame) -> DataFrame:
    """Stored edges ``case_id, edge_type, from_node, to_node`` and what else they have, with those of ``more`` that are new and whose ends exist in their case.

    An edge that is stored keeps its properties; of several new ones with the
    same type and ends the first by document and chunk counts.
    """
    ends = ["case_id", "edge_type", "from_node", "to_node"]
    ids = node.select("case_id", "node_id").distinct()
    held = more
    for end in ("from_node", "to_node"):
        held = held.join(ids.withColumnRenamed("node_id", end), ["case_id", end], "left_semi")
    whole = F.struct("document_id", "chunk_id", *[c for c in stored.columns if c not in (*ends, "document_id", "chunk_id")])
    fresh = held.join(stored.select(*ends), ends, "left_anti").groupBy(*ends).agg(F.min(whole).alias("e"))
    return stored.unionByName(fresh.select(*ends, "e.*"))


def _chunk_edges(chunks: DataFrame, entities: DataFrame, *kinds: str) -> DataFrame:
    """``case_id, document_id, chunk_id, edge_type, from_node, to_node``: edges of the given kinds, one for each pair of mentions.

    The entities of a chunk are gathered into one row and meet its text once;
    all rules are then asked of that row, without further joins.
    """
    own = once(chunks.select(*CHUNK, "text"), "document_id", "chunk_id").select(F.col("case_id").alias("_case"), "document_id", "chunk_id", F.lower("text").alias("low"))
    mention = F.struct("pos", "entity_type", F.col("node_id").alias("node"), F.lower("text").alias("text"))
    gathered = _identified(entities).groupBy(*CHUNK).agg(F.array_sort(F.collect_list(mention)).alias("found"))
    # By document and chunk only, as both sides are already spread by them.
    met = gathered.join(own, ["document_id", "chunk_id"]).where("case_id = _case")
    of = lambda types: F.filter("found", lambda e: e["entity_type"].isin(*types))
    none = F.array().cast("array<struct<edge_type: string, from_node: string, to_node: string>>")
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("edge_type"), a["node"].alias("from_node"), b["node"].alias("to_node"))

    def crossed(kind: str, cue: str, left: Column, right: Column) -> Column:
        return F.when(F.col("low").rlike(cue), F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: edge(kind, a, b))))).otherwise(none)

    def spoken(kind: str, pattern: str, cues: tuple[str, ...]) -> Column:
        """Between the people named on both sides of a phrase; of several that fit a side the last holds. Every match holds one of ``cues``."""
        people = of(PEOPLE)
        fits = lambda side: F.filter(people, lambda e: e["text"].contains(side) | side.contains(e["text"]))
        group = lambda m, n: F.trim(F.regexp_extract(m, pattern, n))
        ends = F.transform(F.regexp_extract_all("low", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.try_element_at(fits(group(m, 1)), F.lit(-1)).alias("a"), F.try_element_at(fits(group(m, 2)), F.lit(-1)).alias("b")))
        good = F.filter(ends, lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"]["node"] != x["b"]["node"]))
        held = reduce(lambda x, y: x | y, [F.col("low").contains(c) for c in cues])
        return F.when(held & (F.size(people) >= 2), F.transform(good, lambda x: edge(kind, x["a"], x["b"]))).otherwise(none)

    rules = {
        "ARGUED_WITH": lambda: spoken("ARGUED_WITH", ARGUED_WITH, ("with",)),
        "WITNESSED": lambda: crossed("WITNESSED", WITNESSED, of(PEOPLE), of(EVENTS)),
        "FOUND_IN": lambda: crossed("FOUND_IN", FOUND_IN, of(THINGS), of(PLACES)),
        "ACCOMPANIED_BY": lambda: spoken("ACCOMPANIED_BY", ACCOMPANIED_BY, ("with", "accompanied")),
        "OWNS": lambda: crossed("OWNS", OWNS, F.slice(of(PEOPLE), 1, 1), of(THINGS)),
    }
    return met.select(*CHUNK, F.inline(F.concat(*[rules[k]() for k in kinds])))


def witnessed(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    return _chunk_edges(chunks, entities, "WITNESSED")


def found_in(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    return _chunk_edges(chunks, entities, "FOUND_IN")


def owns(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    return _chunk_edges(chunks, entities, "OWNS")


def argued_with(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    return _chunk_edges(chunks, entities, "ARGUED_WITH")


def accompanied_by(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    return _chunk_edges(chunks, entities, "ACCOMPANIED_BY")


def edges(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """All edges, each once per type and ends, with the chunk that names it first."""
    every = _chunk_edges(chunks, entities, "ARGUED_WITH", "WITNESSED", "FOUND_IN", "ACCOMPANIED_BY", "OWNS")
    first = F.min(F.struct("document_id", "chunk_id")).alias("at")
    return every.groupBy("case_id", "edge_type", "from_node", "to_node").agg(first, F.count(F.lit(1)).alias("n")).select("case_id", "edge_type", "from_node", "to_node", "at.document_id", "at.chunk_id", "n")


def live_edges(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = node.select("node_id").distinct()
    return edge.join(ids.withColumnRenamed("node_id", "from_node"), "from_node", "left_semi").join(ids.withColumnRenamed("node_id", "to_node"), "to_node", "left_semi")


def stats(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes, and edges with both ends, of each case."""
    n = node.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = live_edges(edge, node).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "case_id", "left").select("case_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def without_case(rows: DataFrame, case_id: str) -> DataFrame:
    """Nodes or edges of all other cases; write it over the old table, or drop the partition of the case."""
    return rows.where(~F.col("case_id").eqNullSafe(case_id))


def neighbours(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges at either end of nodes ``node_id``, each once: two equi-joins, no scan of pairs."""
    wanted = ids.select("node_id").distinct()
    out = edge.join(wanted, edge["from_node"] == wanted["node_id"], "left_semi")
    into = edge.join(wanted, edge["to_node"] == wanted["node_id"], "left_semi")
    return out.unionByName(into).distinct()


#: Names in question that are sent to the tasks at once.
NAMES_A_PASS = 1000


def people_named(node: DataFrame, names: DataFrame) -> DataFrame:
    """People whose name holds, or is held by, a name in question ``name``.

    Parts of words count, so no key can bring both sides together: the names in
    question are sent out in passes of ``NAMES_A_PASS``, each of which reads the
    nodes once. Null and empty names match nothing.
    """
    people = node.where(F.col("node_type") == "Person").select("node_id", "case_id", F.lower("name").alias("own"))
    asked = names.select(F.lower("name").alias("asked")).where("asked <> ''").distinct()
    passes = max(1, -(-asked.count() // NAMES_A_PASS))
    hit = F.col("own").contains(F.col("asked")) | F.col("asked").contains(F.col("own"))
    found = [people.join(F.broadcast(asked.where(F.pmod(F.xxhash64("asked"), F.lit(passes)) == p)), hit) for p in range(passes)]
    return reduce(DataFrame.unionByName, found).select("node_id", "case_id", "asked").distinct()


def duplicates(node: DataFrame) -> DataFrame:
    """Rank of each stored row within its node id, the most confident first."""
    order = Window.partitionBy("node_id", "case_id").orderBy(F.desc("provenance.confidence"), "provenance.document_id", "provenance.source_chunk_id")
    return node.withColumn("rank", F.row_number().over(order))
