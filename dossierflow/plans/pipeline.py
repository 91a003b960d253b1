"""The operators in their order: from extracted blocks to chunks, entities, graph, timeline and claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, chunking, cleaning, contradictions, entities, graph, parsing, timeline, vectors
from ..operators.base import once
from ..session import materialize
from ..sources import store


def analyse(content_blocks: DataFrame, reference_date: str | None = None, most: int = 1000) -> dict[str, DataFrame]:
    """All tables that follow from extracted blocks; each is lazy and runs only if it is used.

    ``reference_date`` is the day of times without a date; without it they have
    no value. Blocks delivered twice count once, null texts pass through.
    """
    at = ["document_id", "block_id"]
    parsed = parsing.parse_blocks(content_blocks)
    day = F.lit(reference_date).cast("date")
    readings = parsed.withColumn("reference_date", day)
    read = cleaning.readings(readings).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("pos", "original", "iso", "confidence"))).alias("t")).select(*at, F.transform("t", lambda x: F.struct(x["original"].alias("original"), x["iso"].alias("iso"), x["confidence"].alias("confidence"))).alias("normalized_timestamps"))
    confidence = once(content_blocks.select(*at, "confidence"), *at)
    cleaned = parsed.join(cleaning.clean_blocks(parsed), at).join(read, at, "left").join(confidence, at, "left")
    chunks = chunking.chunk_blocks(cleaned, most)
    found = entities.extract(chunks)
    listed = found.withColumn("pos", F.col("start_char"))
    ordered = chunks.withColumn("ord", F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int"))
    events = timeline.events_from_blocks(cleaned)
    return {
        "parsed": parsed, "cleaned": cleaned, "chunks": chunks, "entities": found, "nodes": graph.nodes(listed), "document_nodes": graph.document_nodes(ordered), "edges": graph.edges(chunks, listed),
        "events": events, "gaps": timeline.gaps(events), "conflicts": timeline.conflicts(events), "claims": contradictions.claims(chunks),
    }


def graph_facts(questions: DataFrame, retrieved: DataFrame, node: DataFrame, edge: DataFrame) -> DataFrame:
    """``query_id, subject, predicate, object``: edges of the question's case at a person it names, or at a node that a retrieved chunk was the first to hold.

    ``questions`` has ``query_id, case_id, question``, ``retrieved`` has
    ``query_id, case_id, document_id, chunk_id``.
    """
    asked = questions.select("query_id", "case_id", F.explode(answers.asked_entities(F.col("question"))).alias("name")).withColumn("asked", F.lower("name"))
    named = graph.people_named(node, asked.select("name")).join(asked.select("query_id", "case_id", "asked"), ["case_id", "asked"]).select("query_id", "node_id")
    held = node.select("node_id", "case_id", "document_id", "chunk_id").join(retrieved.select("query_id", "case_id", "document_id", "chunk_id"), ["case_id", "document_id", "chunk_id"]).select("query_id", "node_id")
    wanted = named.unionByName(held).distinct()
    ends = edge.select("edge_type", "from_node", "to_node")
    at = lambda end: ends.join(wanted.withColumnRenamed("node_id", end), end)
    found = at("from_node").select("query_id", "edge_type", "from_node", "to_node").unionByName(at("to_node").select("query_id", "edge_type", "from_node", "to_node")).distinct()
    name = lambda end: node.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_name"))
    told = found.join(name("from_node"), "from_node", "left").join(name("to_node"), "to_node", "left")
    return told.select("query_id", F.coalesce("from_node_name", "from_node").alias("subject"), F.col("edge_type").alias("predicate"), F.coalesce("to_node_name", "to_node").alias("object"))


def answer_questions(questions: DataFrame, chunks: DataFrame, entity_rows: DataFrame, blocks: DataFrame, stored: DataFrame, k: int = 5, encode: vectors.Encoder = vectors.hashed, generate=None) -> DataFrame:
    """Answers ``query_id, n_sources, context, limitations, answer, confidence`` to ``query_id BIGINT, case_id, question``.

    The ``k`` chunks nearest to a question are retrieved and those of its case
    kept; graph, timeline and contradictions add what they know of them. A
    question without a chunk of its case gets no row; null questions neither.
    """
    asked = vectors.embed(questions.select("query_id", "case_id", "question").where("query_id is not null and question <> ''").dropDuplicates(["query_id"]), encode, "question")
    own = once(chunks.select("case_id", "document_id", "chunk_id", "speaker", "text"), "document_id", "chunk_id")
    known = materialize(store.add_vectors(None, vectors.embed(own.where("text <> ''"), encode)), "chunk-vectors")
    hits = vectors.exact(asked.select(F.col("query_id").alias("vec_id"), "embedding"), known.select(F.col("vector_id").alias("vec_id"), "embedding"), k)
    near = hits.join(known.select(F.col("vector_id").alias("vec_id"), "case_id", "document_id", "chunk_id", "speaker", "text"), "vec_id").join(asked.select("query_id", F.col("case_id").alias("asked_case")), "query_id").where("case_id = asked_case")
    retrieved = materialize(near.select("query_id", "rank", "case_id", "document_id", "chunk_id", "speaker", "text"), "retrieved")
    ranked = retrieved.select("query_id", "rank", F.concat_ws("/", "document_id", "chunk_id").alias("chunk"), "speaker", "text")
    facts = graph_facts(asked.join(retrieved.select("query_id").distinct(), "query_id", "left_semi"), retrieved, graph.nodes(entity_rows), graph.edges(chunks, entity_rows))
    events = timeline.events_from_chunks(chunks, timeline.chunk_readings(chunks, blocks))
    seen = retrieved.select("query_id", "document_id", "chunk_id").join(events.select("case_id", "document_id", "chunk_id", "ts", "original"), ["document_id", "chunk_id"])
    gap_notes = answers.gaps_inside(timeline.gaps(events), seen.select("query_id", "case_id", "ts"))
    clash = timeline.conflicts(events.withColumn("block_id", F.col("chunk_id"))).select("case_id", "ts")
    clash_notes = seen.select("query_id", "case_id", "ts").join(clash, ["case_id", "ts"]).select("query_id", answers.conflict_limitation(F.col("ts")).alias("limitation"))
    told = stored.dropDuplicates(["case_id", "contradiction_id"])
    side = lambda s: told.select(f"chunk_{s}.document_id", f"chunk_{s}.chunk_id", "case_id", "severity", "explanation", "type")
    against = retrieved.select("query_id", "case_id", "document_id", "chunk_id").join(side("a").unionByName(side("b")), ["case_id", "document_id", "chunk_id"]).select("query_id", "severity", "explanation", "type").distinct()
    return answers.answer(ranked, facts, seen.select("query_id", "ts", F.col("original").alias("description")), against, gap_notes, generate, clash_notes)


def case_summary(chunks: DataFrame, content_blocks: DataFrame, cleaned_blocks: DataFrame, ner_results: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of each kind for every case: blocks, chunks, entities, events and contradictions."""
    count = lambda df, name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    parts = [
        count(once(content_blocks.select("case_id", "document_id", "block_id"), "document_id", "block_id"), "n_blocks"),
        count(once(chunks.select("case_id", "document_id", "chunk_id"), "document_id", "chunk_id"), "n_chunks"),
        count(entities.listed_entities(ner_results), "n_entities"),
        count(timeline.events_from_blocks(cleaned_blocks), "n_events"),
        count(stored.dropDuplicates(["case_id", "contradiction_id"]), "n_contradictions"),
    ]
    joined = reduce(lambda a, b: a.join(b, "case_id", "full"), parts)
    return joined.select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c != "case_id"])
