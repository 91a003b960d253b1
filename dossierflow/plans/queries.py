"""Core queries and their SQL.

Each query runs over its whole tables. SQL is given where DuckDB can say the same
over whole tables; queries without it are held against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..operators import answers, chunking, cleaning, contradictions, entities, extraction, graph, parsing, timeline, vectors
from ..operators.base import once
from ..operators.timestamps import normalize_timestamps
from ..session import read_table, ship_package
from ..sources import logs
from . import pipeline, timestamp_sql

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[..., DataFrame], *tables: str, sql: str | None = None) -> None:
    """Register ``query`` over ``tables``."""
    _QUERIES[name] = lambda spark, sf_dir: query(*[read_table(spark, sf_dir, t) for t in tables])
    if sql:
        _SQL[name] = sql


# Views that several SQL texts use; rows delivered twice are equal but for their time of delivery.
_CONTENT = "SELECT DISTINCT * EXCLUDE (ingested_at) FROM content_blocks"
_PARSED = "SELECT DISTINCT * EXCLUDE (ingested_at) FROM parsed_blocks"
_CLEANED = "SELECT DISTINCT * EXCLUDE (ingested_at) FROM cleaned_blocks"
_CHUNKS = "SELECT DISTINCT * EXCLUDE (ingested_at) FROM chunks"
_CONTRA = "SELECT DISTINCT ON (case_id, contradiction_id) * FROM contradictions"
_SCORED = f"SELECT *, greatest(0.0, least(1.0, coalesce(confidence, 0.9))) AS score FROM ({_CONTENT})"
_ENTITIES = "SELECT case_id, document_id, chunk_id, pos - 1 AS pos, e.entity_type AS entity_type, e.text AS text, e.confidence AS confidence FROM (SELECT case_id, document_id, chunk_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS pos FROM (SELECT DISTINCT ON (document_id, chunk_id) * FROM ner_results))"
_NODE_TYPE = "CASE WHEN upper(entity_type) IN ('PERSON', 'WITNESS', 'SUSPECT') THEN 'Person' WHEN upper(entity_type) IN ('LOCATION', 'ADDRESS') THEN 'Location' WHEN upper(entity_type) = 'TIME' THEN 'Event' WHEN upper(entity_type) IN ('EVIDENCE', 'WEAPON', 'PHONE') THEN 'Evidence' END"
_NODES = f"SELECT *, node_type || ':' || lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) || ':' || case_id AS node_id FROM (SELECT *, {_NODE_TYPE} AS node_type FROM ({_ENTITIES})) WHERE node_type IS NOT NULL AND text IS NOT NULL"
_EVENTS = f"""
    SELECT case_id, document_id, block_id, ord, pos - 1 AS pos, t.iso AS ts, speaker, least(coalesce(confidence, 1.0), coalesce(t.confidence, 1.0)) AS confidence, t.original AS original
    FROM (SELECT *, unnest(normalized_timestamps) AS t, generate_subscripts(normalized_timestamps, 1) AS pos FROM ({_CLEANED}))
    WHERE coalesce(t.iso, '') <> ''
"""
_NUMBERED = f"SELECT *, format('EVT_{{}}_{{:04d}}', translate(case_id, '- ', '__'), row_number() OVER (PARTITION BY case_id ORDER BY document_id, ord, block_id, pos)) AS event_id, try_cast(ts AS TIMESTAMP) AS moment FROM ({_EVENTS})"
_GAPS = f"""
    SELECT case_id, event_id AS before_id, next_id AS after_id, ts AS start, next_ts AS "end", minutes,
           CASE WHEN minutes >= 120 THEN 'SIGNIFICANT' ELSE 'MODERATE' END AS severity, least(confidence, next_confidence) AS confidence
    FROM (
        SELECT *, date_sub('minute', moment, next_moment) AS minutes FROM (
            SELECT *, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts, lead(moment) OVER w AS next_moment, lead(confidence) OVER w AS next_confidence
            FROM ({_NUMBERED}) WINDOW w AS (PARTITION BY case_id ORDER BY moment NULLS FIRST, event_id)
        )
    ) WHERE minutes >= 60
"""


def _conflict_sql(by: str, what: str, events: str = _NUMBERED) -> str:
    value = by if by == "document_id" else f"nullif({by}, '')"
    return f"""
        SELECT case_id, ts, 'Multiple events at same time {what}: ' || array_to_string(vals, ', ') AS reason, array_to_string(ids, ',') AS event_ids, array_to_string(blocks, ',') AS blocks, confidence
        FROM (
            SELECT case_id, ts, list_sort(list_distinct(list({value}) FILTER ({value} IS NOT NULL))) AS vals, list_sort(list(event_id)) AS ids,
                   list_sort(list_distinct(list(document_id || '/' || block_id))) AS blocks, min(confidence) AS confidence
            FROM ({events}) GROUP BY case_id, ts
        ) WHERE len(vals) > 1
    """


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, so that both engines compare plain values."""
    return df.withColumns({c: F.array_join(F.col(c), ",") for c in columns})


# --- timestamps, extraction -------------------------------------------------

_add("p3_found", normalize_timestamps, "cleaned_blocks", "offices", sql=timestamp_sql.build())
_add("block_types", extraction.block_types, "content_blocks", sql=f"""
    SELECT document_id, CASE WHEN type LIKE '%paragraph%' OR type LIKE '%text%' THEN 'paragraph' WHEN type LIKE '%heading%' OR type LIKE '%title%' THEN 'heading' WHEN type LIKE '%table%' THEN 'table'
        WHEN type LIKE '%list_item%' THEN 'list_item' WHEN type LIKE '%caption%' THEN 'caption' WHEN type LIKE '%footnote%' THEN 'footnote' WHEN type LIKE '%code%' THEN 'code'
        WHEN type LIKE '%formula%' OR type LIKE '%equation%' THEN 'formula' ELSE 'paragraph' END AS type, count(*) AS n
    FROM (SELECT document_id, block_id, lower(type) AS type FROM ({_CONTENT})) GROUP BY ALL""")
_PAGES = f"""
    SELECT p.document_id, p.page, coalesce(c.confidence, 1.0) AS confidence
    FROM (SELECT document_id, unnest(range(1, max(page) + 1))::INT AS page FROM ({_SCORED}) GROUP BY document_id) p
    LEFT JOIN (SELECT document_id, page, round(avg(score), 9) AS confidence FROM ({_SCORED}) GROUP BY ALL) c USING (document_id, page)"""
_add("page_confidence", extraction.page_confidence, "content_blocks", sql=_PAGES)
_add("low_confidence_pages", extraction.low_pages, "content_blocks", sql=f"SELECT * FROM ({_PAGES}) WHERE confidence < 0.7")
_add("document_confidence", extraction.document_confidence, "content_blocks", sql=f"""
    SELECT document_id, round(sum(score * greatest(1, coalesce(length(text), 0))) / sum(greatest(1, coalesce(length(text), 0))), 9) AS weighted, round(avg(score), 9) AS plain, count(*) AS n_blocks
    FROM ({_SCORED}) GROUP BY document_id""")
_RESULT_HASH = "sha256(string_agg(h, '' ORDER BY {}))"
_add("document_results", extraction.results, "content_blocks", sql=f"""
    WITH own AS (SELECT *, sha256(coalesce(block_id, '') || chr(1) || coalesce(type, '') || chr(1) || coalesce(text, '') || chr(1) || coalesce(page::VARCHAR, '')) AS h FROM ({_CONTENT})),
    hashed AS (SELECT document_id, 'sha256:' || {_RESULT_HASH.format('run')} AS hash FROM (SELECT document_id, coalesce(ord, 0) // 1024 AS run, {_RESULT_HASH.format('ord, block_id')} AS h FROM own GROUP BY ALL) GROUP BY document_id),
    scored AS (SELECT document_id, min(case_id) AS case_id, min(source_file) AS source_file, coalesce(max(page), 0) AS pages, count(*) AS n_blocks, round(sum(score * greatest(1, coalesce(length(text), 0))) / sum(greatest(1, coalesce(length(text), 0))), 9) AS c FROM ({_SCORED}) GROUP BY document_id)
    SELECT case_id, document_id, source_file, pages, n_blocks, round(c, 2) AS confidence, CASE WHEN c >= 0.85 THEN 'ACCEPTED' WHEN c >= 0.70 THEN 'FLAGGED_FOR_REVIEW' ELSE 'REJECTED' END AS status, hash FROM scored JOIN hashed USING (document_id)""")
_add("renumbered_blocks", extraction.renumbered, "content_blocks", sql=f"SELECT document_id, ord, block_id, 'b' || row_number() OVER (PARTITION BY document_id ORDER BY ord, block_id) AS new_id FROM ({_CONTENT})")
_add("block_hashes", extraction.block_hashes, "content_blocks", sql=f"SELECT document_id, block_id, 'sha256:' || sha256(text) AS hash FROM ({_CONTENT})")

# --- parsing ----------------------------------------------------------------

_BARE = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
_NUMBER = " OR ".join(f"regexp_matches({_BARE}, '{p}')" for p in (r"(?i)^\s*page\s+\d+\s*(?:of|/)\s*\d+\s*$", r"^\s*[-—]+\s*\d+\s*[-—]+\s*$", r"^\s*\d+\s*$", r"(?i)^\s*[\[(]?\s*page\s*\d+\s*[\])]?\s*$", r"^\s*\d+\s*\|\s*.+$|^.+\s*\|\s*\d+\s*$"))
_add("page_furniture", parsing.page_furniture, "parsed_blocks", sql=rf"""
    WITH own AS (SELECT *, {_BARE} AS bare FROM ({_PARSED})), placed AS (
        SELECT document_id, block_id, page, coalesce(({_NUMBER}) AND bare <> '', false) AS number,
               CASE WHEN length(bare) <= 100 AND bare <> '' THEN lower(regexp_replace(bare, '\s+', ' ', 'g')) END AS key,
               row_number() OVER (PARTITION BY document_id, page ORDER BY ord, block_id) AS rank, count(*) OVER (PARTITION BY document_id, page) AS of
        FROM own
    ), pages AS (SELECT document_id, key, count(DISTINCT page) AS pages FROM placed WHERE key IS NOT NULL GROUP BY ALL)
    SELECT p.document_id, p.block_id, NOT number AND coalesce(pages, 0) >= 2 AND NOT (rank = of AND rank > 1) AS is_header,
           number OR (coalesce(pages, 0) >= 2 AND rank = of AND rank > 1) AS is_footer
    FROM placed p LEFT JOIN pages g ON p.document_id = g.document_id AND p.key = g.key""")
_add("sections", parsing.sections, "content_blocks", sql=rf"""
    WITH own AS (SELECT document_id, block_id, ord, {_BARE} AS bare FROM ({_CONTENT})),
    labelled AS (SELECT *, upper(regexp_replace(regexp_replace(regexp_replace(bare, '^[.:;\-–—]+', ''), '[.:;\-–—]+$', ''), '\s+', ' ', 'g')) AS label FROM own),
    named AS (SELECT document_id, block_id, ord, CASE WHEN bare = '' OR length(bare) > 50 THEN NULL
        WHEN label IN ({", ".join(f"'{k}'" for k in T.SECTION_KEYWORDS)}) THEN label
        WHEN regexp_matches(bare, '^(?:\d+\.|\(?[IVXLC]+[.)])\s*([A-Z][A-Z\s]+)$') THEN upper(regexp_extract(bare, '^(?:\d+\.|\(?[IVXLC]+[.)])\s*([A-Z][A-Z\s]+)$', 1))
        WHEN length(bare) <= 30 AND regexp_matches(bare, '^[A-Z][A-Z\s\-–—:.]+$') THEN label END AS name FROM labelled)
    SELECT document_id, block_id, last_value(name IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM named""")
_LABELS = [p.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''") for p in T.SPEAKER_PATTERNS]
_add("speakers", parsing.speakers, "content_blocks", sql=f"SELECT document_id, block_id, CASE " + " ".join(rf"WHEN regexp_matches(bare, '{p}') THEN upper(trim(regexp_replace(regexp_extract(bare, '{p}', 1), '\s+', ' ', 'g')))" for p in _LABELS) + " END AS speaker, CASE " + " ".join(rf"WHEN regexp_matches(bare, '{p}') THEN regexp_replace(regexp_replace(bare, '{p}', ''), '\s+$', '')" for p in _LABELS) + f" ELSE text END AS rest FROM (SELECT *, {_BARE} AS bare FROM ({_CONTENT}))")
_add("timestamp_spans", parsing.timestamp_spans, "content_blocks")
_add("parsed", lambda b: _flat(parsing.parse_blocks(b), "raw_timestamps"), "content_blocks")
_add("speaker_roles", lambda b: once(b.select("document_id", "chunk_id", "speaker"), "document_id", "chunk_id").select("document_id", "chunk_id", T.role_of(F.col("speaker")).alias("role"), T.expand_rank(F.col("speaker")).alias("label")), "chunks", sql=f"""
    SELECT document_id, chunk_id, CASE WHEN up LIKE '%WITNESS%' THEN 'WITNESS' WHEN up LIKE '%SUSPECT%' THEN 'SUSPECT' WHEN up LIKE '%VICTIM%' THEN 'VICTIM' WHEN up LIKE '%OFFICER%' OR up LIKE '%DET%' THEN 'OFFICER' END AS role,
           CASE """ + " ".join(f"WHEN label LIKE '{a}%' THEN '{b}' || label[{len(a) + 1}:]" for a, b in T.RANKS) + f""" ELSE label END AS label
    FROM (SELECT document_id, chunk_id, upper(speaker) AS up, upper(trim(regexp_replace(speaker, '[\\s\\p{{Z}}]+', ' ', 'g'))) AS label FROM ({_CHUNKS}))""")

# --- cleaning ---------------------------------------------------------------

_add("whitespace", lambda d: d.select("doc_id", F.sha2(T.normalize_whitespace(F.col("text")), 256).alias("hash")), "documents", sql=r"""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '')) AS hash
    FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents)""")
_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _clean_sql(text: str) -> str:
    """Encoding, blanks and noise of a text, one replacement after the other."""
    steps = [
        (r"[\p{Co}\x{fffd}]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", "''"), (r"\r\n?", "chr(10)"), (r"[ \t]+", "' '"), (r"[ \t]*\n[ \t]*", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"),
        (f"^{_BLANK}+", "''"), (f"{_BLANK}+$", "''"),
        # Marks that stand alone: a sign on either side of every blank and at both ends shows them.
        (f"({_BLANK})", r"chr(1) || '\1' || chr(1)"), (r"^|$", "chr(1)"), (r"\x01[|~¬¦]+\x01", "chr(1) || chr(1)"), (r"\x01", "''"),
        (r"\.{5,}", "'...'"), (r"…{5,}", "'………'"), (r"-{5,}", "'---'"), (r"_{5,}", "'___'"), (r"={5,}", "'==='"),
    ]
    out = f"nfc_normalize({text})"
    for pattern, new in steps:
        out = f"chr(1) || {out} || chr(1)" if pattern == r"^|$" else f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    return out


_add("cleaned_text", cleaning.clean_blocks, "content_blocks", sql=f"SELECT document_id, block_id, {_clean_sql('text')} AS clean_text FROM ({_CONTENT})")
_add("cleaned_documents", lambda d: (ship_package(d.sparkSession), d.select("doc_id", T.clean_text(F.col("text")).alias("text")))[1], "documents", sql=f"SELECT doc_id, {_clean_sql('text')} AS text FROM documents")
_add("timestamp_readings", cleaning.readings, "cleaned_blocks")
_CLOCK = r"(?i)^(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([ap]m)?$"
_add("time_classes", cleaning.time_classes, "cleaned_blocks", sql=rf"""
    WITH own AS (SELECT document_id, block_id, pos - 1 AS pos, trim(raw) AS r FROM (SELECT document_id, block_id, unnest(raw_timestamps) AS raw, generate_subscripts(raw_timestamps, 1) AS pos FROM ({_CLEANED})) WHERE raw IS NOT NULL),
    parts AS (SELECT *, try_cast(regexp_extract(r, '{_CLOCK}', 1) AS INT) AS h, try_cast(regexp_extract(r, '{_CLOCK}', 2) AS INT) AS m, coalesce(try_cast(regexp_extract(r, '{_CLOCK}', 3) AS INT), 0) AS s,
                     upper(regexp_extract(r, '{_CLOCK}', 4)) AS half, regexp_extract(r, '(?i)^(\d{{4}})\s*(?:hours?|hrs?)$', 1) AS mil FROM own),
    hours AS (SELECT *, CASE WHEN half = 'PM' AND h <> 12 THEN h + 12 WHEN half = 'AM' AND h = 12 THEN 0 ELSE h END AS hour FROM parts),
    kinds AS (SELECT *, CASE WHEN regexp_matches(r, '(?i)^(?:yesterday|today|tonight|tomorrow)$|^(?:last|this|next)\s+|^the\s+(?:night|morning|afternoon|evening)\s+of$|^(?:around|approximately|about|approx\.?)\s+') THEN 'vague'
        WHEN regexp_matches(r, '{_CLOCK}') OR mil <> '' OR regexp_matches(r, '(?i)^\d{{1,2}}\s+o.clock(?:\s*[ap]m)?$') THEN 'time'
        WHEN regexp_matches(r, '^\d{{4}}-\d{{2}}-\d{{2}}') OR regexp_matches(r, '(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}') THEN 'one_way' ELSE 'other' END AS kind FROM hours)
    SELECT document_id, block_id, pos::INT AS pos, kind, CASE WHEN kind <> 'time' THEN NULL WHEN mil <> '' AND mil[1:2]::INT <= 23 AND mil[3:4]::INT <= 59 THEN mil[1:2]::INT * 3600 + mil[3:4]::INT * 60
        WHEN hour <= 23 AND m <= 59 AND s <= 59 THEN hour * 3600 + m * 60 + s END AS seconds FROM kinds""")

# --- chunks -----------------------------------------------------------------

_add("boundary_groups", chunking.boundary_groups, "cleaned_blocks", sql=rf"""
    SELECT document_id, page, speaker, row_number() OVER (PARTITION BY document_id ORDER BY first_ord, page, speaker NULLS FIRST) AS grp, n_blocks, n_tokens::BIGINT AS n_tokens, confidence
    FROM (SELECT document_id, page, speaker, min(ord) AS first_ord, count(*) AS n_blocks, sum(len(regexp_extract_all(coalesce(clean_text, ''), '\S+'))) AS n_tokens, coalesce(min(greatest(0.0, least(1.0, confidence))), 1.0) AS confidence
          FROM ({_CLEANED}) GROUP BY ALL)""")
_CHUNKED = rf"""
    WITH RECURSIVE own AS (
        SELECT case_id, document_id, page, speaker, block_id, ord, clean_text AS t, coalesce(greatest(0.0, least(1.0, confidence)), 1.0) AS c,
               len(regexp_extract_all(clean_text, '[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+')) + regexp_matches(clean_text, '{_BLANK}$')::INT AS n,
               row_number() OVER (PARTITION BY case_id, document_id, page, speaker ORDER BY ord, block_id) AS rn, min(ord) OVER (PARTITION BY case_id, document_id, page, speaker) AS first_ord
        FROM ({_CLEANED}) WHERE length(clean_text) > 0
    ), walk AS (
        SELECT *, 1 AS from_part, CASE WHEN n > 200 THEN (n + 199) // 200 ELSE 1 END AS to_part, CASE WHEN n <= 200 THEN n END AS size FROM own WHERE rn = 1
        UNION ALL SELECT o.*, CASE WHEN o.n <= 200 AND size + o.n <= 200 THEN to_part ELSE to_part + 1 END, CASE WHEN o.n > 200 THEN to_part + (o.n + 199) // 200 WHEN size + o.n <= 200 THEN to_part ELSE to_part + 1 END,
               CASE WHEN o.n > 200 THEN NULL WHEN size + o.n <= 200 THEN size + o.n ELSE o.n END
        FROM walk w JOIN own o ON o.rn = w.rn + 1 AND o.case_id = w.case_id AND o.document_id = w.document_id AND o.page IS NOT DISTINCT FROM w.page AND o.speaker IS NOT DISTINCT FROM w.speaker
    ), piece AS (SELECT *, unnest(range(from_part, to_part + 1)) AS part FROM walk),
    cut AS (SELECT *, CASE WHEN n > 200 THEN regexp_replace(regexp_replace(array_to_string(regexp_extract_all(t, '{_BLANK}*[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|{_BLANK}+$')[(part - from_part) * 200 + 1 : (part - from_part + 1) * 200], ''), '^{_BLANK}+', ''), '{_BLANK}+$', '') ELSE t END AS said FROM piece),
    made AS (SELECT case_id, document_id, page, speaker, first_ord, part, string_agg(said, ' ' ORDER BY rn) AS text, string_agg(block_id, ',' ORDER BY rn) AS source_block_ids, min(c) AS chunk_confidence FROM cut GROUP BY ALL)
    SELECT format('C-{{:04d}}', row_number() OVER (PARTITION BY document_id ORDER BY first_ord, page, speaker NULLS FIRST, part)) AS chunk_id, case_id, document_id, concat_ws(',', page, page) AS page_range, speaker, text, source_block_ids,
           (len(regexp_extract_all(text, '[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+')) + regexp_matches(text, '{_BLANK}$')::INT)::INT AS token_count, chunk_confidence FROM made"""
_add("chunked", lambda b: _flat(chunking.chunk_blocks(b, most=200), "page_range", "source_block_ids"), "cleaned_blocks", sql=_CHUNKED)
_add("boundary_check", chunking.boundary_check, "chunks", "cleaned_blocks", sql=f"""
    SELECT c.document_id, c.chunk_id, count(DISTINCT b.page) <= 1 AS one_page, count(DISTINCT coalesce(b.speaker, chr(1))) <= 1 AS one_speaker
    FROM (SELECT document_id, chunk_id, unnest(source_block_ids) AS block_id FROM ({_CHUNKS})) c JOIN ({_CLEANED}) b ON c.document_id = b.document_id AND c.block_id = b.block_id GROUP BY ALL""")

# --- entities and graph -----------------------------------------------------

_add("rule_entities", entities.extract, "chunks")
_add("merged_entities", lambda c, n: entities.merge(entities.extract(c), entities.listed_entities(n).select("case_id", "document_id", "chunk_id", "entity_type", "text", "start_char", "end_char", "confidence", F.lit("model").alias("source"), "role")).drop("entity_id"), "chunks", "ner_results")
_add("graph_nodes", lambda n: graph.nodes(entities.listed_entities(n)), "ner_results", sql=f"""
    SELECT node_id, any_value(node_type) AS node_type, any_value(case_id) AS case_id, arg_min(text, (document_id, chunk_id, pos)) AS name, arg_min(document_id, (document_id, chunk_id, pos)) AS document_id,
           arg_min(chunk_id, (document_id, chunk_id, pos)) AS chunk_id, arg_min(confidence, (document_id, chunk_id, pos)) AS confidence, max(confidence) AS best, count(*) AS n
    FROM ({_NODES}) GROUP BY node_id""")
_add("document_nodes", graph.document_nodes, "chunks", sql=f"SELECT 'Document:' || lower(document_id) || ':' || case_id AS node_id, case_id, document_id, arg_min(chunk_id, (ord, chunk_id)) AS chunk_id FROM ({_CHUNKS}) GROUP BY ALL")
_add("graph_upsert", graph.upsert, "graph_nodes", sql="""
    SELECT node_id, case_id, any_value(node_type) AS node_type, arg_min(properties['name'], (provenance.document_id, provenance.source_chunk_id, provenance.confidence)) AS name, max(provenance.confidence) AS confidence,
           count(DISTINCT provenance.document_id) AS n_documents FROM graph_nodes GROUP BY ALL""")


def _edge_sql(kind: str, cue: str, left: str, right: str, first: bool = False) -> str:
    source = f"SELECT case_id, document_id, chunk_id, {'arg_min(node_id, pos)' if first else 'node_id'} AS from_node FROM ({_NODES}) WHERE entity_type IN ({left}) {'GROUP BY ALL' if first else ''}"
    return f"""
        SELECT s.case_id, s.document_id, s.chunk_id, '{kind}' AS edge_type, s.from_node, t.node_id AS to_node
        FROM ({source}) s JOIN (SELECT DISTINCT document_id, chunk_id, case_id FROM ({_CHUNKS}) WHERE regexp_matches(lower(text), '{cue}')) c USING (case_id, document_id, chunk_id)
        JOIN (SELECT * FROM ({_NODES}) WHERE entity_type IN ({right})) t USING (case_id, document_id, chunk_id)"""


_LISTED = {"PEOPLE": "'PERSON', 'WITNESS', 'SUSPECT'", "THINGS": "'EVIDENCE', 'WEAPON', 'PHONE'", "PLACES": "'LOCATION', 'ADDRESS'"}
# A word with the letters of any language, and one or two of them.
_W = r"[\p{L}\p{M}\p{N}_]+"
_W2 = rf"({_W}(?:\s+{_W})?)"


def _spoken_sql(kind: str, verbs: str) -> str:
    pattern = rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}_]){_W2}\s+(?:{verbs})\s+{_W2}"
    fits = lambda side: f"contains(low, {side}) OR contains({side}, low)"
    return f"""
        SELECT case_id, document_id, chunk_id, '{kind}' AS edge_type, from_node, to_node FROM (
            SELECT case_id, document_id, chunk_id, hit, arg_max(node_id, pos) FILTER ({fits('a')}) AS from_node, arg_max(node_id, pos) FILTER ({fits('b')}) AS to_node, count(*) AS n
            FROM (SELECT case_id, document_id, chunk_id, hit, trim(regexp_extract(m, '{pattern}', 1)) AS a, trim(regexp_extract(m, '{pattern}', 2)) AS b
                  FROM (SELECT case_id, document_id, chunk_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS hit FROM (SELECT *, regexp_extract_all(lower(text), '{pattern}') AS ms FROM ({_CHUNKS}))))
            JOIN (SELECT case_id, document_id, chunk_id, node_id, pos, lower(text) AS low FROM ({_NODES}) WHERE entity_type IN ({_LISTED["PEOPLE"]})) USING (case_id, document_id, chunk_id) GROUP BY ALL
        ) WHERE n >= 2 AND from_node <> to_node"""


_EDGES = {
    "edges_witnessed": _edge_sql("WITNESSED", r"\b(?:saw|witnessed|observed|noticed|watched)\b", _LISTED["PEOPLE"], "'TIME'"),
    "edges_found_in": _edge_sql("FOUND_IN", r"\b(?:found|located|discovered)\s+(?:at|in|near)\b", _LISTED["THINGS"], _LISTED["PLACES"]),
    "edges_owns": _edge_sql("OWNS", rf"\b(?:his|her|their)\s+{_W}|{_W}''s\s+{_W}|\b(?:owned\s+by|belongs?\s+to)\s+{_W}", _LISTED["PEOPLE"], _LISTED["THINGS"], first=True),
    "edges_argued": _spoken_sql("ARGUED_WITH", r"(?:argued|fought|quarreled|had\s+an?\s+argument)\s+with"),
    "edges_accompanied": _spoken_sql("ACCOMPANIED_BY", r"with|accompanied\s+by|together\s+with"),
}
_EVERY_EDGE = f"""
    SELECT case_id, edge_type, from_node, to_node, min((document_id, chunk_id))[1] AS document_id, min((document_id, chunk_id))[2] AS chunk_id, count(*) AS n
    FROM ({" UNION ALL ".join(_EDGES.values())}) GROUP BY case_id, edge_type, from_node, to_node"""
_NODE_IDS = f"SELECT node_id, any_value(case_id) AS case_id FROM ({_NODES}) GROUP BY node_id"
for _name, _of_kind in {"edges_witnessed": graph.witnessed, "edges_found_in": graph.found_in, "edges_owns": graph.owns, "edges_argued": graph.argued_with, "edges_accompanied": graph.accompanied_by}.items():
    _add(_name, lambda c, n, of=_of_kind: of(c, entities.listed_entities(n)), "chunks", "ner_results", sql=_EDGES[_name])
_add("graph_edges", lambda c, n: graph.edges(c, entities.listed_entities(n)), "chunks", "ner_results", sql=_EVERY_EDGE)
_add("graph_stats", lambda c, n: graph.stats(graph.nodes(entities.listed_entities(n)), graph.edges(c, entities.listed_entities(n))), "chunks", "ner_results", sql=f"""
    WITH edge AS ({_EVERY_EDGE}), node AS ({_NODE_IDS})
    SELECT case_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT case_id, count(*) AS n_nodes FROM node GROUP BY ALL)
    LEFT JOIN (SELECT case_id, count(*) AS n_edges FROM edge WHERE from_node IN (SELECT node_id FROM node) AND to_node IN (SELECT node_id FROM node) GROUP BY ALL) USING (case_id)""")
_CUE_SQL = {
    "WITNESSED": r"\b(?:saw|witnessed|observed|noticed|watched)\b", "FOUND_IN": r"\b(?:found\s+(?:at|in|near)|located\s+(?:at|in)|discovered\s+(?:at|in))\b",
    "OWNS": r"\b(?:his|her|their|my)\s+\w+|\b(?:owned\s+by|belongs?\s+to|possession\s+of)\b", "ACCOMPANIED_BY": r"\b(?:with|accompanied\s+by|together\s+with|alongside)\b",
    "ARGUED_WITH": r"\b(?:argued\s+with|fought\s+with|dispute\s+with|quarreled\s+with)\b|\b(?:altercation\s+with|confrontation\s+with|argument\s+with)\b",
}
_add("edge_cues", lambda c: once(c.select("document_id", "chunk_id", "text"), "document_id", "chunk_id").select("document_id", "chunk_id", F.array_join(graph.edge_cues(F.col("text")), ",").alias("cues")), "chunks",
     sql="SELECT document_id, chunk_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in _CUE_SQL.items()) + f") AS cues FROM ({_CHUNKS})")
_add("suspect_neighbours", lambda c, n: graph.neighbours(graph.edges(c, entities.listed_entities(n)), graph.nodes(entities.listed_entities(n).where("entity_type = 'SUSPECT'"))), "chunks", "ner_results", sql=f"""
    WITH edge AS ({_EVERY_EDGE}), wanted AS (SELECT DISTINCT node_id FROM ({_NODES}) WHERE entity_type = 'SUSPECT')
    SELECT * FROM edge WHERE from_node IN (SELECT node_id FROM wanted) OR to_node IN (SELECT node_id FROM wanted)""")
_add("entity_types", lambda n: entities.listed_entities(n).groupBy("case_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("confidence").cast("decimal(18,9)")).cast("double") / F.count("confidence"), 6).alias("confidence")), "ner_results", sql=f"SELECT case_id, entity_type, count(*) AS n, round(sum(confidence::DECIMAL(18, 9))::DOUBLE / count(confidence), 6) AS confidence FROM ({_ENTITIES}) GROUP BY ALL")

# --- timelines --------------------------------------------------------------

_events = timeline.events_from_blocks
_add("timeline_events", _events, "cleaned_blocks", sql=f"SELECT case_id, document_id, block_id, pos::INT AS pos, event_id, ts, speaker, confidence, original FROM ({_NUMBERED})")
_READINGS = f"""
    SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY bpos, tpos) - 1 AS pos, t.original AS original, t.iso AS iso, t.confidence AS tc
    FROM (SELECT document_id, chunk_id, unnest(source_block_ids) AS block_id, generate_subscripts(source_block_ids, 1) AS bpos FROM ({_CHUNKS}))
    JOIN (SELECT document_id, block_id, unnest(normalized_timestamps) AS t, generate_subscripts(normalized_timestamps, 1) AS tpos FROM ({_CLEANED})) USING (document_id, block_id)"""
_CHUNK_EVENTS = f"""
    SELECT case_id, document_id, chunk_id, pos::INT AS pos, format('EVT_{{}}_{{:04d}}', translate(case_id, '- ', '__'), row_number() OVER (PARTITION BY case_id ORDER BY document_id, ord, chunk_id, pos)) AS event_id,
           iso AS ts, speaker, least(coalesce(chunk_confidence, 1.0), coalesce(tc, 1.0)) AS confidence, original, text AS description
    FROM ({_CHUNKS}) JOIN ({_READINGS}) USING (document_id, chunk_id) WHERE coalesce(iso, '') <> ''"""
_chunk_events = lambda c, b: timeline.events_from_chunks(c, timeline.chunk_readings(c, b))
_add("chunk_events", _chunk_events, "chunks", "cleaned_blocks", sql=_CHUNK_EVENTS)
_add("timeline_sorted", lambda b: timeline.sorted_events(_events(b)).select("case_id", "event_id", "ts", "position"), "cleaned_blocks", sql=f"SELECT case_id, event_id, ts, row_number() OVER (PARTITION BY case_id ORDER BY moment NULLS FIRST, event_id) AS position FROM ({_NUMBERED})")
_add("timeline_gaps", lambda b: timeline.gaps(_events(b)), "cleaned_blocks", sql=_GAPS)
_add("gap_summary", lambda b: timeline.gap_summary(timeline.gaps(_events(b))), "cleaned_blocks", sql=f"SELECT case_id, count(*) AS total, count(*) FILTER (severity = 'MODERATE') AS moderate, count(*) FILTER (severity = 'SIGNIFICANT') AS significant, sum(minutes)::BIGINT AS minutes FROM ({_GAPS}) GROUP BY case_id")
_add("largest_gap", lambda b: timeline.largest_gap(timeline.gaps(_events(b))), "cleaned_blocks", sql=f"SELECT DISTINCT ON (case_id) case_id, before_id, after_id, start, \"end\", minutes, severity FROM ({_GAPS}) ORDER BY case_id, minutes DESC, start, before_id")
_add("timeline_conflicts", lambda b: _flat(timeline.conflicts(_events(b)), "event_ids", "blocks"), "cleaned_blocks", sql=_conflict_sql("speaker", "with different speakers"))
_add("document_conflicts", lambda b: _flat(timeline.conflicts(_events(b), "document_id"), "event_ids", "blocks"), "cleaned_blocks", sql=_conflict_sql("document_id", "from different documents"))
_HOURLY = f"SELECT * REPLACE (ts[1:13] || ':00:00' AS ts) FROM ({_NUMBERED})"
_hourly = lambda b: timeline.conflicts(timeline.by_hour(_events(b)))
_add("hourly_conflicts", lambda b: _flat(_hourly(b), "event_ids", "blocks"), "cleaned_blocks", sql=_conflict_sql("speaker", "with different speakers", _HOURLY))
_add("conflict_summary", lambda b: timeline.conflict_summary(_hourly(b)), "cleaned_blocks", sql=f"SELECT case_id, count(*) AS total, count(DISTINCT ts) AS unique_timestamps, sum(len(string_split(event_ids, ',')))::BIGINT AS total_events FROM ({_conflict_sql('speaker', 'x', _HOURLY)}) GROUP BY case_id")
_add("blocks_in_conflict", lambda b: timeline.blocks_in_conflict(_hourly(b)), "cleaned_blocks", sql=f"SELECT DISTINCT case_id, unnest(string_split(blocks, ',')) AS block FROM ({_conflict_sql('speaker', 'x', _HOURLY)})")
_add("event_confidence", lambda b: timeline.confidence_summary(_events(b)), "cleaned_blocks", sql=f"SELECT case_id, round(avg(confidence), 6) AS mean, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium, count(*) FILTER (confidence < 0.7) AS low, count(*) FILTER (confidence < 0.7) AS below FROM ({_EVENTS}) GROUP BY case_id")
_add("time_range", lambda b: timeline.time_range(_events(b)), "cleaned_blocks", sql=f"SELECT case_id, arg_min(ts, (moment, ts)) AS first, arg_max(ts, (moment, ts)) AS last FROM ({_NUMBERED}) WHERE moment IS NOT NULL GROUP BY case_id")
_add("chronology", lambda b: timeline.chronology(_events(b)), "cleaned_blocks", sql=f"SELECT document_id, bool_and(ok) AS ordered, count(*) AS n FROM (SELECT document_id, coalesce(lag(moment) OVER (PARTITION BY document_id ORDER BY event_id) <= moment, true) AS ok FROM ({_NUMBERED}) WHERE moment IS NOT NULL) GROUP BY document_id")


def _activity(events: DataFrame) -> DataFrame:
    """Gaps of each user over the event stream's whole table."""
    own = events.select(F.col("user_id").cast("string").alias("case_id"), F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lit(1.0).alias("confidence"))
    return timeline.gaps(own).select(F.col("case_id").cast("long").alias("user_id"), "start", "end", "minutes", "severity")


_add("user_gaps", _activity, "events", sql="""
    SELECT user_id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS start, strftime(next, '%Y-%m-%d %H:%M:%S') AS "end", date_sub('minute', moment, next) AS minutes, CASE WHEN date_sub('minute', moment, next) >= 120 THEN 'SIGNIFICANT' ELSE 'MODERATE' END AS severity
    FROM (SELECT user_id, moment, lead(moment) OVER (PARTITION BY user_id ORDER BY moment, event_id::VARCHAR) AS next FROM (SELECT user_id, event_id, date_trunc('second', ts::TIMESTAMP) AS moment FROM events)) WHERE date_sub('minute', moment, next) >= 60""")

# --- contradictions ---------------------------------------------------------

_add("contradiction_summary", contradictions.summary, "contradictions", sql=f"SELECT case_id, type, severity, count(*) AS n FROM ({_CONTRA}) GROUP BY ALL")
_add("severities", contradictions.severities, "contradictions", sql=f"""
    SELECT contradiction_id, case_id, severity AS stored, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(1, least(4, CASE type WHEN 'TIME_CONFLICT' THEN 2 WHEN 'LOCATION_CONFLICT' THEN 3 WHEN 'STATEMENT_VS_EVIDENCE' THEN 4 WHEN 'DENIAL_VS_ASSERTION' THEN 3 ELSE 2 END
        + (CASE WHEN confidence >= 0.9 THEN 1 ELSE 0 END) - (CASE WHEN confidence < 0.6 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(len(shared_entities), 0) >= 2 THEN 1 ELSE 0 END)))] AS computed,
        coalesce(severity = 'CRITICAL', false) AS critical FROM ({_CONTRA})""")


def _says(side: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({side}.text, '')), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_SCORE = f"(CASE WHEN {_says('chunk_a', T.DENIAL_WORDS)} <> {_says('chunk_b', T.DENIAL_WORDS)} THEN 0.3 ELSE 0 END) + (CASE WHEN ({_says('chunk_a', ('home',))} AND {_says('chunk_b', ('scene',))}) OR ({_says('chunk_a', ('scene',))} AND {_says('chunk_b', ('home',))}) THEN 0.4 ELSE 0 END)"
_add("opposed_texts", contradictions.opposed_texts, "contradictions", sql=f"SELECT contradiction_id, case_id, CASE WHEN s > 0.5 THEN 'contradiction' WHEN s > 0.2 THEN 'neutral' ELSE 'entailment' END AS label, CASE WHEN s > 0.5 THEN least(s, 0.95)::DOUBLE WHEN s > 0.2 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM (SELECT *, {_SCORE} AS s FROM ({_CONTRA}))")
_QUOTED = lambda p: p.replace("'", "''")
_WORD_ANY = lambda words: "(" + " OR ".join(f"contains(lower(text), '{_QUOTED(w)}')" for w in words) + ")"
_MATCH_ANY = lambda patterns: "(" + " OR ".join(f"regexp_matches(lower(text), '{_QUOTED(p)}')" for p in patterns) + ")"
_SET = lambda lists, item: f"list_sort(list_distinct(list_transform(list_concat({', '.join(lists)}), lambda x: {item})))"
_PLACE_SQL = [f"regexp_extract_all(lower(text), '{p}')" for p in (T.PLACES[0], T.PLACES[1], rf"\b(?:near|at|inside|outside)\s+{_W}")]
_TIME_SQL = [f"regexp_extract_all(text, '(?i){p}', 1)" for p in T.TIMES]
_CLAIMS = rf"""
    SELECT document_id || '/' || chunk_id AS key, coalesce(chunk_confidence, 1.0) AS confidence, {_MATCH_ANY(T.DENIALS)} AS denies, {_MATCH_ANY(T.ASSERTIONS)} AS asserts, {_WORD_ANY(T.EVIDENCE_WORDS)} AS physical,
           {_WORD_ANY(T.DENIAL_WORDS)} AS negates, contains(lower(text), 'home') AS home, contains(lower(text), 'scene') AS scene, {_SET(_PLACE_SQL[:2] + _PLACE_SQL[2:], "trim(x)")} AS places,
           {_SET(_TIME_SQL, "lower(regexp_replace(x, '[\\s\\p{Z}]+', '', 'g'))")} AS times, string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), ' ') AS words
    FROM ({_CHUNKS}) WHERE text IS NOT NULL"""
_MENTIONS = rf"""
    SELECT DISTINCT case_id, document_id || '/' || chunk_id AS key, entity, regexp_replace(string_split(entity, ' ')[1], '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g') AS head
    FROM (SELECT case_id, document_id, chunk_id, lower(regexp_replace(regexp_replace(regexp_replace(text, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', ''), '[\s\p{{Z}}]+', ' ', 'g')) AS entity FROM ({_ENTITIES}) WHERE entity_type IN ({_LISTED["PEOPLE"]})) WHERE entity <> ''"""
_NAMED = f"SELECT m.case_id, m.entity, c.*, denies::INT + 2 * asserts::INT + 4 * physical::INT + 8 * negates::INT + 16 * home::INT + 32 * scene::INT AS class FROM claims c JOIN mentioned m USING (key) WHERE confidence >= 0.5 AND list_contains(words, head)"
_WITH_NAMED = f"WITH claims AS MATERIALIZED ({_CLAIMS}), mentioned AS MATERIALIZED ({_MENTIONS}), named AS MATERIALIZED ({_NAMED})"
_VALUED = "SELECT case_id, entity, key, confidence, 'LOCATION_CONFLICT' AS type, places AS vals FROM named WHERE len(places) > 0 UNION ALL SELECT case_id, entity, key, confidence, 'TIME_CONFLICT', times FROM named WHERE len(times) > 0"
_add("claim_members", lambda n, c: contradictions.membership(entities.listed_entities(n), c), "ner_results", "chunks", sql=f"{_WITH_NAMED} SELECT case_id, entity, key, class, confidence FROM named")
_add("claim_pairs", lambda n, c: contradictions.class_pairs(entities.listed_entities(n), c), "ner_results", "chunks", sql=f"""
    {_WITH_NAMED}, grp AS (SELECT case_id, entity, class, min(key) AS key, count(*) AS n FROM named GROUP BY ALL),
    met AS (SELECT a.case_id, a.entity, a.class AS class_a, b.class AS class_b, a.key AS key_a, b.key AS key_b, a.n AS n_a, b.n AS n_b FROM grp a JOIN grp b ON a.case_id = b.case_id AND a.entity = b.entity),
    sets AS (SELECT case_id, entity, type, vals, min(key) AS key, count(*) AS n FROM ({_VALUED}) GROUP BY ALL)
    SELECT case_id, entity, 'DENIAL_VS_ASSERTION' AS type, class_a, class_b, key_a, key_b, n_a, n_b FROM met WHERE class_a & 1 > 0 AND class_b & 2 > 0 AND (class_a <> class_b OR n_a > 1)
    UNION ALL SELECT case_id, entity, 'STATEMENT_VS_EVIDENCE', class_a, class_b, key_a, key_b, n_a, n_b FROM met WHERE class_a & 4 > 0 AND class_b & 4 = 0 AND class_b & 1 > 0
    UNION ALL SELECT a.case_id, a.entity, a.type, NULL, NULL, a.key, b.key, a.n, b.n FROM sets a JOIN sets b ON a.case_id = b.case_id AND a.entity = b.entity AND a.type = b.type AND a.key < b.key AND NOT list_has_any(a.vals, b.vals)""")
_add("claim_value_members", lambda n, c: contradictions.value_membership(entities.listed_entities(n), c), "ner_results", "chunks", sql=f"{_WITH_NAMED} SELECT case_id, entity, type, min(key) OVER (PARTITION BY case_id, entity, type, vals) AS class_key, key, confidence FROM ({_VALUED})")


def _severity_sql(kind: str, confidence: str, shared: str, same: str) -> str:
    one = lambda c: f"(CASE WHEN {c} THEN 1 ELSE 0 END)"
    base = f"CASE {kind} WHEN 'TIME_CONFLICT' THEN 2 WHEN 'LOCATION_CONFLICT' THEN 3 WHEN 'STATEMENT_VS_EVIDENCE' THEN 4 WHEN 'DENIAL_VS_ASSERTION' THEN 3 ELSE 2 END"
    return f"['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(1, least(4, {base} + {one(f'{confidence} >= 0.9')} - {one(f'{confidence} < 0.6')} + {one(f'len({shared}) >= 2')} + {one(f'{same} AND {kind} = {chr(39)}LOCATION_CONFLICT{chr(39)}')}))]"


def _detect_sql(claims: str, pairs: str, times: str = "SELECT NULL::VARCHAR AS key, NULL::VARCHAR AS ts WHERE false") -> str:
    """The four rules for candidate pairs ``case_id, key_a, key_b, shared`` (sorted)."""
    score = "(CASE WHEN a.negates <> b.negates THEN 0.3 ELSE 0 END + CASE WHEN (a.home AND b.scene) OR (a.scene AND b.home) THEN 0.4 ELSE 0 END)"
    about = r"list_filter(shared, lambda e: list_contains(a.words, regexp_replace(string_split(e, ' ')[1], '[^\p{L}\p{M}\p{N}_]+', '', 'g')) AND list_contains(b.words, regexp_replace(string_split(e, ' ')[1], '[^\p{L}\p{M}\p{N}_]+', '', 'g')))[1]"
    return f"""
        WITH claims AS MATERIALIZED ({claims}), dated AS (SELECT key, max(ts) AS ts FROM ({times}) GROUP BY key), met AS (
            SELECT p.case_id, key_a, key_b, shared, {about} AS about, coalesce(ta.ts = tb.ts, false) AS same, {score} AS s, least(a.confidence, b.confidence) AS low, a.places AS pa, b.places AS pb, a.times AS qa, b.times AS qb,
                   a.denies AND b.asserts AS ab, b.denies AND a.asserts AS ba, (a.physical <> b.physical) AND (CASE WHEN a.physical THEN b.denies ELSE a.denies END) AS evidence
            FROM ({pairs}) p JOIN claims a ON a.key = key_a JOIN claims b ON b.key = key_b LEFT JOIN dated ta ON ta.key = key_a LEFT JOIN dated tb ON tb.key = key_b
        ), found AS (
            SELECT *, 'DENIAL_VS_ASSERTION' AS type, (CASE WHEN ab THEN 'Chunk A denies while Chunk B asserts about ' ELSE 'Chunk B denies while Chunk A asserts about ' END) || about || '.' AS explanation FROM met WHERE ab OR ba
            UNION ALL SELECT *, 'LOCATION_CONFLICT', about || ' claimed ' || pa[1] || ' vs ' || pb[1] || '.' FROM met WHERE len(pa) > 0 AND len(pb) > 0 AND NOT list_has_any(pa, pb)
            UNION ALL SELECT *, 'TIME_CONFLICT', about || ' has conflicting times: ' || qa[1] || ' vs ' || qb[1] || '.' FROM met WHERE len(qa) > 0 AND len(qb) > 0 AND NOT list_has_any(qa, qb)
            UNION ALL SELECT *, 'STATEMENT_VS_EVIDENCE', 'Statement denies evidence regarding ' || about || '.' FROM met WHERE evidence
        ), sure AS (SELECT *, CASE WHEN s > 0.5 THEN least(low, s) ELSE low END::DOUBLE AS confidence FROM found WHERE about IS NOT NULL)
        SELECT case_id, key_a, key_b, type, array_to_string(shared, ',') AS shared, explanation, round(confidence, 6) AS confidence, {_severity_sql('type', 'confidence', 'shared', 'same')} AS severity,
               CASE WHEN s > 0.5 THEN 'contradiction' WHEN s > 0.2 THEN 'neutral' ELSE 'entailment' END AS label FROM sure WHERE confidence >= 0.5"""


_STORED = f"SELECT contradiction_id || '/a' AS document_id, '' AS chunk_id, chunk_a.text AS text, confidence AS chunk_confidence, contradiction_id, case_id FROM ({_CONTRA}) WHERE contradiction_id IS NOT NULL UNION ALL SELECT contradiction_id || '/b', '', chunk_b.text, confidence, contradiction_id, case_id FROM ({_CONTRA}) WHERE contradiction_id IS NOT NULL"
_SHARED = r"list_sort(list_filter(list_transform(coalesce(shared_entities, []), lambda e: lower(regexp_replace(regexp_replace(regexp_replace(e, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', ''), '[\s\p{Z}]+', ' ', 'g'))), lambda e: e <> ''))"
_JUDGED = _detect_sql(_CLAIMS.replace(f"FROM ({_CHUNKS})", f"FROM ({_STORED})").replace("document_id || '/' || chunk_id", "document_id"), f"SELECT case_id, contradiction_id || '/a' AS key_a, contradiction_id || '/b' AS key_b, {_SHARED} AS shared FROM ({_CONTRA}) WHERE contradiction_id IS NOT NULL")
_add("judged_pairs", lambda c: _flat(contradictions.numbered(contradictions.judged(c)), "shared"), "contradictions", sql=f"SELECT *, format('CONT_{{}}_{{:04d}}', translate(case_id, '- ', '__'), row_number() OVER (PARTITION BY case_id ORDER BY key_a, key_b, type) - 1) AS contradiction_id FROM ({_JUDGED})")
_times = lambda c, b: timeline.last_readings(c, b).select(F.concat_ws("/", "document_id", "chunk_id").alias("key"), "ts")
_PAIRED = f"SELECT a.case_id, a.key AS key_a, b.key AS key_b, list_sort(list(a.entity)) AS shared FROM ({_MENTIONS}) a JOIN ({_MENTIONS}) b ON a.case_id = b.case_id AND a.entity = b.entity AND a.key < b.key GROUP BY ALL"
_add("claims_found", lambda n, c, b: _flat(contradictions.search(entities.listed_entities(n), c, times=_times(c, b)), "shared"), "ner_results", "chunks", "cleaned_blocks",
     sql=_detect_sql(_CLAIMS, _PAIRED, f"SELECT document_id || '/' || chunk_id AS key, ts FROM ({_CHUNK_EVENTS})"))
_HEAD = r"regexp_split_to_array(lower(speaker), '[\s\p{Z}]+')[1]"
_SPOKEN = f"SELECT case_id, document_id || '/' || chunk_id AS key, lower(coalesce(text, '')) AS low, nullif(speaker, '') AS speaker FROM ({_CHUNKS})"
_add("speaker_members", contradictions.speaker_members, "chunks", sql=f"SELECT case_id, speaker AS label, key FROM ({_SPOKEN}) WHERE speaker IS NOT NULL")
_add("speaker_mentions", contradictions.speaker_mentions, "chunks", sql=f"""
    WITH own AS MATERIALIZED ({_SPOKEN}) SELECT a.case_id, b.speaker AS label, a.key, count(*) AS n FROM own a JOIN own b ON a.case_id = b.case_id AND a.key <> b.key AND b.speaker IS NOT NULL
    WHERE contains(a.low, lower(b.speaker)) OR (a.speaker IS NOT NULL AND contains(a.low, {_HEAD.replace('speaker', 'b.speaker')})) GROUP BY ALL""")
_CUES = [("denies", T.DENIALS), ("asserts", T.ASSERTIONS)]
_add("claim_cues", lambda c: contradictions.claims(c).select("document_id", "chunk_id", "denies", "asserts", "physical"), "chunks", sql="SELECT document_id, chunk_id, "
     + ", ".join("(" + " OR ".join(f"regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + f") AS {name}" for name, patterns in _CUES)
     + ", (" + " OR ".join(f"contains(lower(text), '{w}')" for w in T.EVIDENCE_WORDS) + f") AS physical FROM ({_CHUNKS}) WHERE text IS NOT NULL")
_add("contradictions_of_suspects", lambda c, n: contradictions.of_chunks(c, entities.listed_entities(n).where("entity_type = 'SUSPECT'")).select("case_id", "contradiction_id", "type", "severity"), "contradictions", "ner_results", sql=f"""
    SELECT case_id, contradiction_id, type, severity FROM ({_CONTRA}) c WHERE EXISTS (SELECT 1 FROM ({_ENTITIES}) e WHERE e.entity_type = 'SUSPECT' AND ((e.document_id = c.chunk_a.document_id AND e.chunk_id = c.chunk_a.chunk_id) OR (e.document_id = c.chunk_b.document_id AND e.chunk_id = c.chunk_b.chunk_id)))""")

# --- vectors and answers ----------------------------------------------------

_ASKED = "SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0"
_NEAREST = f"""
    SELECT * FROM (
        SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, v.vec_id) AS rank, q.label AS query_label, v.label AS label
        FROM ({_ASKED}) q CROSS JOIN embeddings v) WHERE rank <= 5"""
_knn = lambda e: vectors.exact(vectors.every_fiftieth(e), e)
_add("nearest", lambda e: _knn(e).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank"), "embeddings", sql=f"SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM ({_NEAREST})")
_add("nearest_scored", lambda e: vectors.scored(_knn(e), 0.001).select("query_id", "vec_id", F.round("score", 6).alias("score")), "embeddings", sql=f"SELECT query_id, vec_id, round(1 / (1 + distance), 6) AS score FROM ({_NEAREST}) WHERE 1 / (1 + distance) >= 0.001")
_add("nearest_in_case", lambda e: vectors.within_case(_knn(e), e).select("query_id", "vec_id", "rank", "label"), "embeddings", sql=f"SELECT query_id, vec_id, rank, label FROM ({_NEAREST}) WHERE label = query_label")
_add("indexed_nearest", lambda e: vectors.CellIndex(e).search(vectors.every_fiftieth(e)).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank"), "embeddings")
_add("index_recall", lambda e: vectors.recall(vectors.CellIndex(e).search(vectors.every_fiftieth(e)), _knn(e)), "embeddings")


def _cited(contra: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """An answer for every contradiction: its two chunks are the sources, the timeline of its case the background."""
    own = contra.dropDuplicates(["case_id", "contradiction_id"]).where("contradiction_id is not null")
    query = F.concat_ws("/", "case_id", "contradiction_id")
    side = lambda s, r: own.select(query.alias("query_id"), F.lit(r).alias("rank"), F.concat_ws("/", f"chunk_{s}.document_id", f"chunk_{s}.chunk_id").alias("chunk"), F.col(f"chunk_{s}.speaker").alias("speaker"), F.col(f"chunk_{s}.text").alias("text"), f"chunk_{s}.document_id", "case_id")
    ranked = side("a", 1).unionByName(side("b", 2))
    events = timeline.events_from_blocks(blocks)
    near = ranked.select("query_id", "case_id", "document_id").distinct().join(events.select("document_id", "ts", "original"), "document_id")
    gaps = answers.gaps_inside(timeline.gaps(events), near.select("query_id", "case_id", "ts"))
    facts = own.select(query.alias("query_id"), F.col("chunk_a.speaker").alias("subject"), F.lower(F.translate("type", "_", " ")).alias("predicate"), F.col("chunk_b.speaker").alias("object")).where("subject is not null and object is not null")
    told = own.select(query.alias("query_id"), "severity", "explanation", "type")
    return answers.answer(ranked, facts, near.select("query_id", "ts", F.col("original").alias("description")), told, gaps)




def _retrieved(contra: DataFrame, chunks: DataFrame, ner: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every contradiction's explanation as a question about its case."""
    asked = contra.dropDuplicates(["case_id", "contradiction_id"]).select(F.xxhash64("case_id", "contradiction_id").alias("query_id"), "case_id", F.col("explanation").alias("question"))
    return pipeline.answer_questions(asked, chunks, entities.listed_entities(ner), blocks, contra)


_add("retrieved_answers", lambda c, k, n, b: _flat(_retrieved(c, k, n, b), "limitations"), "contradictions", "chunks", "ner_results", "cleaned_blocks")
_add("bpe_token_counts", chunking.bpe_counts, "chunks")
_add("bpe_chunked", lambda b: _flat(chunking.chunk_blocks(b, most=200, tokenizer=chunking.Bpe()), "page_range", "source_block_ids"), "cleaned_blocks")
_add("cited_answers", lambda c, k, b: _flat(_cited(c, k, b), "limitations"), "contradictions", "chunks", "cleaned_blocks")
_add("limitations", lambda c: c.dropDuplicates(["case_id", "contradiction_id"]).select("case_id", "contradiction_id", answers.contradiction_limitation(F.col("severity"), F.col("explanation"), F.col("type")).alias("limitation")), "contradictions", sql=f"""
    SELECT case_id, contradiction_id, CASE WHEN coalesce(explanation, '') <> '' THEN 'Evidence contradiction (' || coalesce(severity, '') || '): ' || explanation ELSE 'Evidence contradiction detected: ' || coalesce(type, 'CONFLICT') END AS limitation FROM ({_CONTRA})""")
_add("asked_names", lambda e: e.select("item_id", F.array_join(answers.asked_entities(F.col("text")), ",").alias("names")), "eval_items", sql=r"""
    SELECT item_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[?.,!"'']+', ''), '[?.,!"'']+$', '')),
        lambda w: w <> '' AND w NOT IN ('Who', 'What', 'When', 'Where', 'Why', 'How', 'Did', 'Does', 'Was', 'Were', 'Is', 'Are', 'The', 'A', 'An', 'To', 'From', 'With') AND regexp_matches(w, '^\p{Lu}')), ',') AS names FROM eval_items""")
_add("answer_confidence", lambda c: c.dropDuplicates(["case_id", "contradiction_id"]).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("severity") == "CRITICAL", F.lit(False))).alias("critical")).select("case_id", "n", "critical", scores.answer_confidence(F.col("n"), F.col("critical"), F.lit(False)).alias("confidence")), "contradictions", sql=f"""
    SELECT case_id, n, critical, round(least(0.9, 0.5 + n * 0.1)::DOUBLE * (CASE WHEN critical THEN 0.7::DOUBLE ELSE 1::DOUBLE END), 2) AS confidence FROM (SELECT case_id, count(*) AS n, bool_or(coalesce(severity = 'CRITICAL', false)) AS critical FROM ({_CONTRA}) GROUP BY case_id)""")


# --- single operators -------------------------------------------------------

_add("page_number_blocks", lambda b: once(b.select("document_id", "block_id", "text"), "document_id", "block_id").where(T.is_page_number(F.col("text"))).select("document_id", "block_id"), "content_blocks", sql=f"SELECT document_id, block_id FROM ({_CONTENT}) WHERE ({_NUMBER}) AND {_BARE} <> ''")
_add("capital_lines", lambda b: once(b.select("document_id", "block_id", "text"), "document_id", "block_id").where(T.is_all_caps(F.col("text"))).select("document_id", "block_id"), "content_blocks", sql=rf"""
    SELECT document_id, block_id FROM ({_CONTENT}) WHERE length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) >= 0.9 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))""")
_add("recognised_confidence", lambda b: once(b.select("document_id", "block_id", "source_file", "confidence"), "document_id", "block_id").select("document_id", "block_id", F.round(scores.block_confidence(F.col("confidence"), F.lower("source_file").startswith("scan")), 9).alias("confidence")), "content_blocks", sql=f"""
    SELECT document_id, block_id, round(greatest(0.0, least(1.0, CASE WHEN lower(source_file) LIKE 'scan%' THEN greatest(0.30, coalesce(confidence, 0.70) - 0.05) ELSE coalesce(confidence, 0.90) END)), 9) AS confidence FROM ({_CONTENT})""")
_add("token_counts", lambda c: once(c.select("document_id", "chunk_id", "text", "token_count"), "document_id", "chunk_id").select("document_id", "chunk_id", chunking.token_count(F.col("text")).cast("int").alias("tokens"), F.col("token_count").alias("stored")), "chunks", sql=rf"SELECT document_id, chunk_id, len(regexp_extract_all(coalesce(text, ''), '\S+'))::INT AS tokens, token_count AS stored FROM ({_CHUNKS})")
_add("node_ranks", lambda g: graph.duplicates(g).select("node_id", "case_id", F.col("provenance.document_id").alias("document_id"), F.col("provenance.source_chunk_id").alias("chunk_id"), "rank"), "graph_nodes", sql="""
    SELECT node_id, case_id, provenance.document_id AS document_id, provenance.source_chunk_id AS chunk_id, row_number() OVER (PARTITION BY node_id, case_id ORDER BY provenance.confidence DESC, provenance.document_id, provenance.source_chunk_id) AS rank FROM graph_nodes""")
_add("node_hashes", lambda n: graph.nodes(entities.listed_entities(n)).select("node_id", scores.node_hash(F.col("node_type"), F.col("name"), F.col("case_id")).alias("hash")), "ner_results", sql=f"SELECT DISTINCT node_id, sha256(node_id)[1:16] AS hash FROM ({_NODES})")


def _named(ner: DataFrame) -> DataFrame:
    """People whose name holds one of three names in question."""
    asked = ner.sparkSession.createDataFrame([("Garden",), ("Zoë",), ("Halden",)], "name STRING")
    return graph.people_named(graph.nodes(entities.listed_entities(ner)), asked)


_add("people_named", _named, "ner_results", sql=f"""
    SELECT DISTINCT node_id, case_id, asked FROM (SELECT node_id, case_id, arg_min(text, (document_id, chunk_id, pos)) AS name FROM ({_NODES}) WHERE node_type = 'Person' GROUP BY ALL) CROSS JOIN (SELECT unnest(['garden', 'zoë', 'halden']) AS asked)
    WHERE contains(lower(name), asked) OR contains(asked, lower(name))""")
_add("low_events", lambda b: timeline.low_events(_events(b)).select("case_id", "event_id", "confidence"), "cleaned_blocks", sql=f"SELECT case_id, event_id, confidence FROM ({_NUMBERED}) WHERE confidence < 0.7")
_add("events_of_suspects", lambda b, n: timeline.relevant(_events(b), entities.listed_entities(n).where("entity_type = 'SUSPECT'"), "document_id").select("case_id", "document_id", "event_id", "ts"), "cleaned_blocks", "ner_results", sql=f"SELECT case_id, document_id, event_id, ts FROM ({_NUMBERED}) WHERE document_id IN (SELECT document_id FROM ({_ENTITIES}) WHERE entity_type = 'SUSPECT')")
_add("conflict_limitations", lambda b: timeline.conflicts_among(_hourly(b), timeline.low_events(_events(b))).select("case_id", answers.conflict_limitation(F.col("ts")).alias("limitation")), "cleaned_blocks", sql=f"""
    SELECT DISTINCT case_id, 'Conflicting information at ' || ts AS limitation FROM ({_HOURLY}) e JOIN (SELECT case_id, ts FROM ({_conflict_sql('speaker', 'x', _HOURLY)})) c USING (case_id, ts) WHERE e.confidence < 0.7""")
_add("gap_limitations", lambda b: timeline.gaps(_events(b)).select("case_id", answers.gap_limitation(F.col("start"), F.col("end"), F.col("minutes"), F.col("severity")).alias("limitation")), "cleaned_blocks", sql=f"SELECT case_id, 'Timeline contains a ' || minutes || '-minute gap between ' || start || ' and ' || \"end\" || ' (' || severity || ')' AS limitation FROM ({_GAPS})")
_add("log_filter", lambda e: logs.select(_as_log(e), action="click", since="2024-01-10", until="2024-01-20").select("timestamp", "user_id", "action"), "events", sql="SELECT strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS timestamp, user_id::VARCHAR AS user_id, event_type AS action FROM events WHERE event_type = 'click' AND ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
_add("log_latest", lambda e: logs.latest(_as_log(e), 100).select("timestamp", "user_id", "action"), "events", sql="SELECT strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS timestamp, user_id::VARCHAR AS user_id, event_type AS action FROM events ORDER BY timestamp DESC, user_id, action LIMIT 100")


def _as_log(events: DataFrame) -> DataFrame:
    return events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"))


_add("case_summary", lambda c, k, b, n, o: pipeline.case_summary(c, k, b, n, o), "chunks", "content_blocks", "cleaned_blocks", "ner_results", "contradictions", sql=f"""
    SELECT case_id, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_entities, 0) AS n_entities, coalesce(n_events, 0) AS n_events, coalesce(n_contradictions, 0) AS n_contradictions
    FROM (SELECT case_id, count(*) AS n_blocks FROM ({_CONTENT}) GROUP BY ALL) FULL JOIN (SELECT case_id, count(*) AS n_chunks FROM ({_CHUNKS}) GROUP BY ALL) USING (case_id)
    FULL JOIN (SELECT case_id, count(*) AS n_entities FROM ({_ENTITIES}) GROUP BY ALL) USING (case_id) FULL JOIN (SELECT case_id, count(*) AS n_events FROM ({_EVENTS}) GROUP BY ALL) USING (case_id)
    FULL JOIN (SELECT case_id, count(*) AS n_contradictions FROM ({_CONTRA}) GROUP BY ALL) USING (case_id)""")
_add("analysed_chunks", lambda c: pipeline.analyse(c)["chunks"].withColumns({k: F.array_join(k, ",") for k in ("page_range", "source_block_ids")}), "content_blocks")
_add("analysed_graph", lambda c: pipeline.analyse(c)["edges"], "content_blocks")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
