"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table
from . import cooccurrence, leakage, names, packing, pii, scans, subjects, tokenize, turns

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.frequent_pairs(read_table(spark, sf_dir, "ner_results"), read_table(spark, sf_dir, "contradictions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(read_table(spark, sf_dir, "parsed_blocks"), read_table(spark, sf_dir, "speaker_roster"))


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(read_table(spark, sf_dir, "parsed_blocks"), read_table(spark, sf_dir, "speaker_roster"), with_text=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_nodes(read_table(spark, sf_dir, "ner_results"), read_table(spark, sf_dir, "graph_nodes"), read_table(spark, sf_dir, "contradictions"))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(read_table(spark, sf_dir, "ner_results"), read_table(spark, sf_dir, "graph_nodes"), read_table(spark, sf_dir, "contradictions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_findings(read_table(spark, sf_dir, "content_blocks"), read_table(spark, sf_dir, "parsed_blocks"))


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(read_table(spark, sf_dir, "content_blocks"), read_table(spark, sf_dir, "parsed_blocks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_items(read_table(spark, sf_dir, "content_blocks"), read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "speaker_roster"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(read_table(spark, sf_dir, "content_blocks"), read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "speaker_roster"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "cleaned_blocks"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(read_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "subject_labels"), read_table(spark, sf_dir, "subject_areas"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_turns": p2_turns, "p4_found": p4_found, "p4_entities": p4_entities, "p5_found": p5_found, "p5_text": p5_text, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_renamed": p9_renamed, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH chunk_items AS (
                SELECT DISTINCT case_id, document_id || '/' || chunk_id AS record, lower(trim(e.text)) AS item
                FROM (SELECT case_id, document_id, chunk_id, unnest(entities) AS e FROM ner_results)
                WHERE e.entity_type IN ('PERSON', 'WITNESS', 'SUSPECT', 'LOCATION', 'EVIDENCE', 'WEAPON')
            ), claim_items AS (
                SELECT DISTINCT case_id, '#' || contradiction_id AS record, lower(trim(i)) AS item
                FROM (SELECT case_id, contradiction_id, unnest(shared_entities) AS i FROM contradictions)
            ), items AS (
                SELECT * FROM (SELECT * FROM chunk_items UNION ALL SELECT * FROM claim_items)
                WHERE item <> '' AND case_id IS NOT NULL
            ), single AS (SELECT case_id, item, count(*) AS n FROM items GROUP BY ALL),
            total AS (SELECT case_id, count(DISTINCT record) AS n FROM items GROUP BY ALL),
            pairs AS (
                SELECT a.case_id, a.item AS item_a, b.item AS item_b, count(*) AS n
                FROM items a JOIN items b ON a.case_id = b.case_id AND a.record = b.record AND a.item < b.item
                GROUP BY ALL HAVING count(*) >= 5
            )
            SELECT p.case_id, p.item_a, p.item_b
            FROM pairs p JOIN total t USING (case_id)
            JOIN single a ON a.case_id = p.case_id AND a.item = p.item_a
            JOIN single b ON b.case_id = p.case_id AND b.item = p.item_b
            WHERE p.n * t.n >= 3 * a.n * b.n
        """,
        "p9_found": r"""
            WITH texts AS (
                SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
                UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items
            ), windows AS (
                SELECT side, id, array_to_string(w[i:i + 11], ' ') AS words FROM (SELECT side, id, w, unnest(range(1, len(w) - 10)) AS i FROM texts WHERE len(w) >= 12)
            )
            SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM windows d JOIN windows i USING (words) WHERE d.side = 'd' AND i.side = 'i'
        """,
    }
