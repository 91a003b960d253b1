"""Core operators on small cases, against brute force, and on empty or null rows."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierflow.functions import scores
from dossierflow.functions import text as T
from dossierflow.operators import answers, chunking, cleaning, contradictions, entities, extraction, graph, parsing, timeline, vectors
from dossierflow.plans import pipeline
from dossierflow.sources import files, logs, store
from dossierflow.streaming import timelines


def column(spark, values, function, kind="STRING"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}").select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


# --- text -------------------------------------------------------------------


def test_blanks_and_noise(spark):
    assert column(spark, ["  a \t b ", None, ""], T.squash) == ["a b", None, ""]
    assert column(spark, ["a \r\n\r\n\n\n  b\t\tc  "], T.normalize_whitespace) == ["a\n\nb c"]
    assert column(spark, ["a ||~ b | c|d\n¬", "......end-----x"], T.remove_noise) == ["a  b  c|d\n", "...end---x"]
    assert column(spark, ["é\x00�\ttab", None], T.fix_encoding) == ["é\ttab", None]


@pytest.mark.parametrize(("line", "yes"), [("Page 1 of 5", True), ("— 3 —", True), ("12", True), ("[Page 7]", True), ("4 | Report", True), ("Page one", False), ("", False), (None, False)])
def test_page_numbers(spark, line, yes):
    assert column(spark, [line], T.is_page_number) == [yes]


@pytest.mark.parametrize(("line", "name"), [("Summary:", "SUMMARY"), ("II. BACKGROUND", "BACKGROUND"), ("Section: interview", "INTERVIEW"), ("FINDINGS OF LAW ----", "FINDINGS OF LAW"), ("SCENE LOG", "SCENE LOG"), ("He ran.", None), ("", None), (None, None), ("X" * 60, None)])
def test_sections(spark, line, name):
    assert column(spark, [line], T.section_name) == [name]


@pytest.mark.parametrize(("text", "speaker", "rest"), [("Det. Smith: hello", "DET. SMITH", "hello"), ("Q. where", "Q", "where"), ("THE WITNESS : yes", "THE WITNESS", "yes"), ("JOHN DOE: no", "JOHN DOE", "no"), ("no label here", None, "no label here"), (None, None, None)])
def test_speakers(spark, text, speaker, rest):
    assert [tuple(x) for x in column(spark, [text], T.detect_speaker)] == [(speaker, rest)]


def test_furniture_of_large_inputs_is_the_same(table):
    windowed, joined = (sorted(map(tuple, parsing.page_furniture(table("parsed_blocks"), window_bytes=n).collect()), key=repr) for n in (1 << 200, 0))
    assert windowed == joined and any(r[2] for r in windowed)


def test_mentions_prefer_the_longer():
    assert [x for _, _, x in parsing.mentions("On March 15, 2024 at 8:15 PM, and 0815 hours yesterday, or 15.03.2024.")] == ["March 15, 2024 at 8:15 PM", "0815 hours", "yesterday", "15.03.2024"]
    assert parsing.mentions(None) == [] and parsing.mentions("no time") == []


def test_timestamp_cascade(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["8:15 PM", "0815 hours", "yesterday", "2024-03-15", "", "25:61", "around 8 PM", "garbage"])], "i INT, x STRING")
    rows = df.select("i", cleaning.normalized(F.col("x"), F.to_date(F.lit("2024-05-06"))).alias("t")).orderBy("i").select("t.iso", "t.confidence").collect()
    assert [tuple(r) for r in rows] == [("2024-05-06T20:15:00", 0.7), ("2024-05-06T08:15:00", 0.85), (None, 0.1), ("2024-03-15T00:00:00", 0.9), (None, 0.0), (None, 0.0), (None, 0.1), (None, 0.0)]


# --- extraction, chunks -----------------------------------------------------


def test_confidences(spark):
    got = column(spark, [None, 0.2, 1.4], lambda c: scores.block_confidence(c, F.lit(True)), "DOUBLE")
    assert got == pytest.approx([0.65, 0.30, 1.0])
    words = spark.createDataFrame([("D", 1, i, w, p) for i, (w, p) in enumerate([("a", 90.0), ("b", 70.0), (" ", -1.0), ("c", -1.0), ("d", 50.0)])], "document_id STRING, page INT, i INT, word STRING, percent DOUBLE")
    assert sorted((r["text"], r["confidence"]) for r in extraction.word_paragraphs(words).collect()) == [("a b", 0.8), ("d", 0.5)]


def test_recognised_pages_replace_native_ones(spark):
    schema = "document_id STRING, page INT, ord INT, text STRING"
    native = spark.createDataFrame([("D", 1, 0, "x"), ("D", 2, 1, "old"), ("D", 3, 2, "z")], schema)
    seen = spark.createDataFrame([("D", 2, 0, "new1"), ("D", 2, 1, "new2")], schema)
    assert [(r["text"], r["new_id"]) for r in extraction.replace_pages(native, seen).orderBy("page", "ord").collect()] == [("x", "b1"), ("new1", "b2"), ("new2", "b3"), ("z", "b4")]


def brute_chunks(blocks, most):
    """Greedy packing of (block_id, text) within one group."""
    out, ids, texts, size = [], [], [], 0
    for b, t in blocks:
        n = len(t.split())
        if n > most:
            if ids:
                out.append((ids, " ".join(texts)))
            w = t.split()
            out += [([b], " ".join(w[i : i + most])) for i in range(0, n, most)]
            ids, texts, size = [], [], 0
            continue
        if size + n > most and ids:
            out.append((ids, " ".join(texts)))
            ids, texts, size = [], [], 0
        ids, texts, size = [*ids, b], [*texts, t], size + n
    return out + ([(ids, " ".join(texts))] if ids else [])


def test_chunks_equal_greedy_packing(spark, table):
    blocks = table("cleaned_blocks")
    got = {}
    for r in chunking.chunk_blocks(blocks, most=40).collect():
        assert r["token_count"] <= 40
        got.setdefault((r["document_id"], r["page_range"][0], r["speaker"]), []).append((int(r["chunk_id"][2:]), list(r["source_block_ids"]), r["text"]))
    want = {}
    for r in blocks.drop("ingested_at").dropDuplicates(["document_id", "block_id"]).orderBy("document_id", "ord").collect():
        if r["clean_text"]:
            want.setdefault((r["document_id"], r["page"], r["speaker"]), []).append((r["block_id"], r["clean_text"]))
    assert {k: [x[1] for x in sorted(v)] for k, v in got.items()} == {k: [c[0] for c in brute_chunks(v, 40)] for k, v in want.items()}
    assert {k: [x[2].split() for x in sorted(v)] for k, v in got.items()} == {k: [c[1].split() for c in brute_chunks(v, 40)] for k, v in want.items()}


# --- entities, graph --------------------------------------------------------


def test_rule_entities():
    text = "Call 555-123-4567 about the stun gun and a Gun near 420 Harrow Lane; his bath towel, DNA."
    assert [(k, t) for k, t, *_ in entities.find_entities(text)] == [("PHONE", "555-123-4567"), ("WEAPON", "stun gun"), ("WEAPON", "gun"), ("WEAPON", "Gun"), ("ADDRESS", "420 Harrow Lane"), ("EVIDENCE", "DNA")]
    assert all(text[a:b].strip() == t for _, t, a, b, _ in entities.find_entities(text)) and entities.find_entities(None) == []


def test_model_entities_give_way_to_rules(spark):
    schema = "document_id STRING, chunk_id STRING, text STRING, start_char INT, end_char INT"
    rules = spark.createDataFrame([("D", "C", "gun", 10, 13)], schema)
    model = spark.createDataFrame([("D", "C", "a gun", 8, 13), ("D", "C", "Bob", 0, 3), ("D", "C", "after", 13, 18), ("E", "C", "gun", 10, 13)], schema)
    assert sorted(r["text"] for r in entities.merge(rules, model).collect()) == ["Bob", "after", "gun", "gun"]


def listed(spark, *rows):
    return spark.createDataFrame([("K", "D", "C", i, kind, text, 0.9) for i, (kind, text) in enumerate(rows)], "case_id STRING, document_id STRING, chunk_id STRING, pos INT, entity_type STRING, text STRING, confidence DOUBLE")


def test_spoken_edges(make, spark):
    chunks = make("chunks", {"case_id": "K", "document_id": "D", "chunk_id": "C", "text": "Bob Hall argued with Ann Lee, together with nobody. Her knife was found in Oak Yard."})
    e = listed(spark, ("PERSON", "Bob Hall"), ("WITNESS", "Ann Lee"), ("WEAPON", "knife"), ("LOCATION", "Oak Yard"), ("TIME", "8 PM"), ("OTHER", "x"))
    got = {(r["edge_type"], r["from_node"].split(":")[1], r["to_node"].split(":")[1]) for r in graph.edges(chunks, e).collect()}
    assert got == {("ARGUED_WITH", "bob hall", "ann lee"), ("FOUND_IN", "knife", "oak yard"), ("OWNS", "bob hall", "knife")}
    joint = make("chunks", {"case_id": "K", "document_id": "D", "chunk_id": "C", "text": "Then Ann Lee accompanied by Bob Hall left."})
    assert [(r["from_node"], r["to_node"]) for r in graph.accompanied_by(joint, e).collect()] == [("Person:ann lee:K", "Person:bob hall:K")]
    nodes = graph.nodes(e)
    assert nodes.count() == 5
    assert graph.people_named(nodes, spark.createDataFrame([("Lee",), ("",)], "name STRING")).count() == 1
    kept = graph.live_edges(graph.edges(chunks, e), nodes.where("node_type <> 'Person'"))
    assert {r["edge_type"] for r in kept.collect()} == {"FOUND_IN"}
    assert graph.neighbours(graph.edges(chunks, e), nodes.where("name = 'Oak Yard'")).count() == 1
    assert graph.without_case(nodes, "K").count() == 0


def test_edge_cues(spark):
    assert column(spark, ["She saw them together with Bob", "nothing", None], graph.edge_cues) == [["WITNESSED", "ACCOMPANIED_BY"], [], []]


# --- timelines --------------------------------------------------------------


def event_rows(spark, *rows):
    return spark.createDataFrame([("K", d, "b", f"E{i}", ts, s, c) for i, (d, ts, s, c) in enumerate(rows)], "case_id STRING, document_id STRING, block_id STRING, event_id STRING, ts STRING, speaker STRING, confidence DOUBLE")


def test_gaps_and_conflicts(spark):
    e = event_rows(spark, ("D", "2024-01-01T10:00:00", "A", 0.9), ("D", "2024-01-01T10:00:00", "B", 0.6), ("E", "2024-01-01T11:30:00", None, 0.8), ("E", "2024-01-01T13:30:59", "", 1.0), ("E", "bad", "A", 1.0), ("E", "2024-01-02", "A", 0.5))
    g = timeline.gaps(e).orderBy("start").collect()
    assert [(r["minutes"], r["severity"], r["confidence"]) for r in g] == [(90, "MODERATE", 0.6), (120, "SIGNIFICANT", 0.8), (629, "SIGNIFICANT", 0.5)]
    assert timeline.largest_gap(timeline.gaps(e)).first()["minutes"] == 629
    c = timeline.conflicts(e).collect()
    assert [(r["ts"], r["reason"], r["event_ids"], r["confidence"]) for r in c] == [("2024-01-01T10:00:00", "Multiple events at same time with different speakers: A, B", ["E0", "E1"], 0.6)]
    assert timeline.conflicts(e, "document_id").count() == 0
    assert timeline.time_range(e).first()[1:] == ("2024-01-01T10:00:00", "2024-01-02")
    assert timeline.sorted_events(e).orderBy("position").first()["ts"] == "bad"
    assert {r["document_id"]: r["ordered"] for r in timeline.chronology(e).collect()} == {"D": True, "E": True}


# --- contradictions ---------------------------------------------------------


def test_rules_on_pairs(make, spark):
    def claim(i, text, confidence=0.9):
        return {"case_id": "K", "document_id": "D", "chunk_id": i, "text": text, "chunk_confidence": confidence}

    chunks = make("chunks", claim("a", "Bob was not there, never near Elm."), claim("b", "Bob said he was at home at 8 PM."), claim("c", "The camera shows Bob outside Oak at 9 PM."), claim("d", None))
    pairs = spark.createDataFrame([("K", f"D/{x}", f"D/{y}", ["bob hall"]) for x, y in itertools.combinations("abcd", 2)], "case_id STRING, key_a STRING, key_b STRING, shared ARRAY<STRING>")
    got = {(r["key_a"][-1] + r["key_b"][-1], r["type"]): r["severity"] for r in contradictions.detect(pairs, chunks).collect()}
    assert got == {("ab", "DENIAL_VS_ASSERTION"): "CRITICAL", ("ab", "LOCATION_CONFLICT"): "CRITICAL", ("ac", "LOCATION_CONFLICT"): "CRITICAL", ("ac", "STATEMENT_VS_EVIDENCE"): "CRITICAL", ("bc", "LOCATION_CONFLICT"): "CRITICAL", ("bc", "TIME_CONFLICT"): "HIGH"}


def test_class_pairs_stand_for_all_pairs(table):
    e, chunks = entities.listed_entities(table("ner_results")), table("chunks")
    members = [tuple(r) for r in contradictions.membership(e, chunks).select("case_id", "entity", "key", "class").collect()]
    told = {(r["case_id"], r["entity"], r["type"], r["class_a"], r["class_b"]) for r in contradictions.class_pairs(e, chunks).collect()}
    cues = {r["key"]: r for r in contradictions.claims(chunks).collect()}
    by = {}
    for case, entity, key, kind in members:
        by.setdefault((case, entity), []).append((key, kind))
    for (case, entity), group in by.items():
        for (k1, c1), (k2, c2) in itertools.permutations(group, 2):
            a, b = cues[k1], cues[k2]
            assert ((case, entity, "DENIAL_VS_ASSERTION", c1, c2) in told) == (a["denies"] and b["asserts"])
            assert ((case, entity, "STATEMENT_VS_EVIDENCE", c1, c2) in told) == (a["physical"] and not b["physical"] and b["denies"])


def test_places_and_times_are_searched_over_all_chunks(table):
    e, chunks = entities.listed_entities(table("ner_results")), table("chunks")
    members = {}
    for r in contradictions.value_membership(e, chunks).collect():
        members.setdefault((r["case_id"], r["entity"], r["type"]), []).append((r["key"], r["class_key"]))
    told = {(r["case_id"], r["entity"], r["type"], r["key_a"], r["key_b"]) for r in contradictions.class_pairs(e, chunks).collect() if r["class_a"] is None}
    assert {t[2] for t in told} == {"LOCATION_CONFLICT", "TIME_CONFLICT"}
    sets = {r["key"]: {"LOCATION_CONFLICT": set(r["places"]), "TIME_CONFLICT": set(r["times"])} for r in contradictions.claims(chunks).collect()}
    apart = set()
    for (case, entity, kind), group in members.items():
        for (k1, c1), (k2, c2) in itertools.combinations(group, 2):
            found = (case, entity, kind, *sorted((c1, c2))) in told
            assert found == sets[k1][kind].isdisjoint(sets[k2][kind])
            if found:
                apart.add((kind, *sorted((k1, k2))))
    rows = contradictions.search(e, chunks).where("type in ('LOCATION_CONFLICT', 'TIME_CONFLICT')").collect()
    assert {(r["type"], r["key_a"], r["key_b"]) for r in rows} == apart and all(r["severity"] and r["confidence"] >= 0.5 for r in rows)


def _shuffled(spark):
    """Rows that all stages so far have written for others."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_search_sends_no_pair_to_another_task(make, spark):
    n = 150
    chunks = make("chunks", *[{"case_id": "K", "document_id": "D", "chunk_id": f"{i:03}", "text": f"Bob was near Elm{i}.", "chunk_confidence": 0.9} for i in range(n)])
    named = make("ner_results", *[{"case_id": "K", "document_id": "D", "chunk_id": f"{i:03}", "entities": [{"text": "Bob", "entity_type": "PERSON"}]} for i in range(n)])
    before = _shuffled(spark)
    assert len(contradictions.search(entities.listed_entities(named), chunks).collect()) == n * (n - 1) // 2
    assert _shuffled(spark) - before < 20 * n


def test_search_in_blocks_is_detect_of_all_pairs(make, spark):
    said = ("Bob denied it near Elm.", "Bob Hall and Ann said he was at home at 8 PM.", "Ann: the camera shows Bob at the scene, 9 PM.", "Ann did not see O'Neil, never near Elm.", "Nobody was there.", "Ann was outside Oak at 8 PM with Bob.", None)
    who = (("Bob", "Bob Hall", "Ann"), ("Bob", " bob  hall", "Cid"), ("Ann", "Bob", "O'Neil"), ("Ann", "O'Neil", "-"), ())
    rows = [{"case_id": "K" if i % 5 else "L", "document_id": f"D{i % 2}", "chunk_id": f"{i:02}", "text": said[i % 7], "chunk_confidence": (0.95, 0.7, None, 0.55, 0.4, 0.5000004)[i % 6]} for i in range(60)]
    chunks = make("chunks", *rows, rows[3])
    named = make("ner_results", *[r | {"entities": [{"text": t, "entity_type": "PERSON"} for t in who[i * 3 % 5]]} for i, r in enumerate(rows)], {"document_id": "D9", "chunk_id": "00", "entities": [{"text": "Bob", "entity_type": "PERSON"}]})
    e = entities.listed_entities(named)
    of = {}
    for r in contradictions.mentions(e).collect():
        of.setdefault((r["case_id"], r["key"]), set()).add(r["entity"])
    met = [(c, k, m, sorted(of[c, k] & of[d, m])) for (c, k), (d, m) in itertools.permutations(of, 2) if c and c == d and k < m and of[c, k] & of[d, m]]
    pairs = spark.createDataFrame(met, "case_id STRING, key_a STRING, key_b STRING, shared ARRAY<STRING>")
    times = spark.createDataFrame([(f"D{i % 2}/{i:02}", f"2024-01-0{i % 3 + 1}") for i in range(0, 60, 2)], "key STRING, ts STRING")
    want = sorted(map(repr, contradictions.detect(pairs, chunks, times).collect()))
    assert len(want) > 100 and len({w.split("type=")[1].split(",")[0] for w in want}) == 4
    for block in (1, 5, 2048):
        assert sorted(map(repr, contradictions.search(e, chunks, times=times, block=block, task_pairs=50).collect())) == want


def test_no_pair_is_found_below_the_least_confidence(make):
    texts = {"a": ("Bob was near Elm.", 0.9), "b": ("Bob was outside Oak.", 0.9), "c": ("Bob was inside Fir.", 0.3)}
    chunks = make("chunks", *[{"case_id": "K", "document_id": "D", "chunk_id": i, "text": t, "chunk_confidence": c} for i, (t, c) in texts.items()])
    named = make("ner_results", *[{"case_id": "K", "document_id": "D", "chunk_id": i, "entities": [{"text": "Bob", "entity_type": "PERSON"}]} for i in texts])
    e = entities.listed_entities(named)
    assert [(r["type"], r["key_a"], r["key_b"]) for r in contradictions.class_pairs(e, chunks).collect()] == [("LOCATION_CONFLICT", "D/a", "D/b")]
    assert [(r["type"], r["severity"]) for r in contradictions.search(e, chunks).collect()] == [("LOCATION_CONFLICT", "CRITICAL")]


# --- vectors, answers -------------------------------------------------------


def test_search_equals_brute_force_in_any_passes(table):
    e = table("embeddings")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    want = {q: [i for _, i in sorted((((v - rows[q]) ** 2).sum(), i) for i, v in rows.items())[:5]] for q in rows if q % 50 == 0}
    for size in (vectors.PASS_BYTES, 600):
        got = {}
        for r in vectors.exact(vectors.every_fiftieth(e), e, pass_bytes=size).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == want


def test_index_recall(table):
    e = table("embeddings")
    r = vectors.recall(vectors.CellIndex(e).search(vectors.every_fiftieth(e)), vectors.exact(vectors.every_fiftieth(e), e)).first()
    assert r["recall"] >= 0.9


def test_vectors_without_rows_or_values(make, spark):
    none = make("embeddings")
    assert vectors.exact(none, none).count() == 0 and vectors.CellIndex(none).search(none).count() == 0
    assert vectors.usable(make("embeddings", {"vec_id": 1}, {"embedding": [1.0]}, {"vec_id": 2, "embedding": [None, 1.0]})).count() == 0


def test_context_is_cut_before_a_source(spark):
    text = "RETRIEVED EVIDENCE:\n\n[Source 1: a]\n" + "x" * 30 + "\n[Source 2: b]\n" + "y" * 100
    got = column(spark, [text, "short", None], lambda c: answers.truncated(c, 20, 4))
    assert got == ["RETRIEVED EVIDENCE:\n\n[Source 1: a]\n" + "x" * 30 + answers.CUT_NOTE, "short", None]


def test_answer_points_to_sources(spark):
    ranked = spark.createDataFrame([("q", 1, "c1", "Bob", "I saw it."), ("q", 2, "c2", None, None)], "query_id STRING, rank INT, chunk STRING, speaker STRING, text STRING")
    facts = spark.createDataFrame([("q", "Bob", "KNOWS", "Ann")], "query_id STRING, subject STRING, predicate STRING, object STRING")
    events = spark.createDataFrame([("q", "2024", "x")], "query_id STRING, ts STRING, description STRING")
    told = spark.createDataFrame([("q", "HIGH", "A denies.", "T")], "query_id STRING, severity STRING, explanation STRING, type STRING")
    gaps = spark.createDataFrame([("q", "gap")], "query_id STRING, limitation STRING")
    r = answers.answer(ranked, facts, events, told, gaps).first()
    assert r["context"].count("[Source ") == 2 and "- Bob KNOWS Ann" in r["context"] and r["limitations"] == ["gap", "Evidence contradiction (HIGH): A denies."]
    assert r["answer"].endswith("Note: gap; Evidence contradiction (HIGH): A denies.") and r["confidence"] == pytest.approx(0.44)


def test_asked_names(spark):
    assert column(spark, ["Where did Bob Hall meet \"Ann\"?", "", None], answers.asked_entities) == [["Bob", "Hall", "Ann"], [], None]


def test_critical_contradictions_halve_the_confidence(spark):
    ranked = spark.createDataFrame([(q, r, f"D/C{r}", None, "text") for q in (1, 2) for r in (1, 2)], "query_id BIGINT, rank INT, chunk STRING, speaker STRING, text STRING")
    nothing = spark.createDataFrame([], "query_id BIGINT, subject STRING, predicate STRING, object STRING, ts STRING, description STRING, limitation STRING")
    told = spark.createDataFrame([(1, "CRITICAL", "x", "y"), (2, "LOW", "x", "y")], "query_id BIGINT, severity STRING, explanation STRING, type STRING")
    got = {r["query_id"]: r["confidence"] for r in answers.answer(ranked, nothing, nothing, told, nothing).collect()}
    assert got[1] == round(got[2] / 2, 4) and got[2] == round(0.7 * 0.7, 2)


def test_answers_come_from_chunks_of_the_case(spark, make):
    texts = [("K", "C1", "Ann Hall saw the knife."), ("K", "C2", "Nobody was at home."), ("L", "C3", "Ann Hall saw the knife twice.")]
    chunks = make("chunks", *[{"case_id": c, "document_id": f"D{c}", "chunk_id": i, "text": t, "ord": 1, "chunk_confidence": 0.9, "source_block_ids": ["b1"]} for c, i, t in texts])
    rows = spark.createDataFrame([("K", "DK", "C1", 0, "PERSON", "Ann Hall", 0.9), ("K", "DK", "C1", 1, "WEAPON", "knife", 0.9)], "case_id STRING, document_id STRING, chunk_id STRING, pos INT, entity_type STRING, text STRING, confidence DOUBLE")
    asked = spark.createDataFrame([(1, "K", "What knife did Hall see?"), (2, "M", "knife"), (3, "K", None)], "query_id BIGINT, case_id STRING, question STRING")
    got = pipeline.answer_questions(asked, chunks, rows, make("cleaned_blocks"), make("contradictions"), k=2).collect()
    assert [r["query_id"] for r in got] == [1] and "DK/C1" in got[0]["context"] and "DL" not in got[0]["context"]


def test_byte_tokens_equal_the_library(spark, make):
    from tokenizers import Tokenizer

    library, bpe = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json"), chunking.Bpe()
    texts = ["He ran 12 miles.", "東京 👩‍🔬 é", "", None, "  two  spaces  \n\n"]
    got = chunking.bpe_counts(make("chunks", *[{"document_id": "D", "chunk_id": str(i), "text": t} for i, t in enumerate(texts)])).collect()
    assert {r["chunk_id"]: r["tokens"] for r in got} == {str(i): len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert all(bpe.join(bpe(t)) == t for t in texts if t) and bpe.split(None, 5) == [] and bpe.split("a b", 5) == ["a b"]
    assert bpe.split("one two three four five", 2) == ["one two", " three four", " five"]


def test_encoders_and_index_files(spark, table, tmp_path):
    rows = spark.createDataFrame([(1, "blue car"), (2, "car blue"), (3, None), (4, "")], "id INT, text STRING")
    got = {r["id"]: r["embedding"] for r in vectors.embed(rows).collect()}
    assert got[1] == got[2] and len(got[1]) == 384 and got[3] is None and got[4] is None
    made = {r["id"]: r["embedding"] for r in vectors.embed(rows, lambda ts: np.array([[len(t)] for t in ts])).collect()}
    assert made == {1: [8.0], 2: [8.0], 3: None, 4: None}
    index = vectors.CellIndex(table("embeddings"))
    index.save(str(tmp_path / "index"))
    again = vectors.CellIndex.load(spark, str(tmp_path / "index"))
    asked = vectors.every_fiftieth(table("embeddings"))
    assert again.count() == index.count() and sorted(map(repr, again.search(asked).collect())) == sorted(map(repr, index.search(asked).collect()))


def test_results_of_documents(make, spark):
    blocks = make("content_blocks", *[{"case_id": "K", "document_id": d, "block_id": f"b{i}", "ord": i, "text": "x" * 10, "page": i + 1, "confidence": c} for d, c in (("A", 0.9), ("B", 0.75), ("C", 0.4)) for i in range(3)])
    failed = spark.createDataFrame([("K", "X", "x.pdf"), ("K", "A", "a.pdf")], "case_id STRING, document_id STRING, source_file STRING")
    rows = {r["document_id"]: r for r in extraction.results(blocks, failed).collect()}
    assert {d: (r["status"], r["pages"], r["confidence"]) for d, r in rows.items()} == {"A": ("ACCEPTED", 3, 0.9), "B": ("FLAGGED_FOR_REVIEW", 3, 0.75), "C": ("REJECTED", 3, 0.4), "X": ("REJECTED", 0, 0.0)}
    assert rows["A"]["hash"] == rows["B"]["hash"] and rows["X"]["hash"] is None


def test_events_of_chunks(make, spark):
    chunks = make("chunks", *[{"case_id": "K-1", "document_id": "D", "chunk_id": f"C{i}", "ord": i, "text": f"t{i}", "chunk_confidence": 0.8} for i in (1, 2)])
    readings = spark.createDataFrame([("D", "C2", 0, "noon", "2024-01-01T12:00:00", 0.9), ("D", "C1", 0, "then", None, 0.9), ("D", "C1", 1, "ten", "2024-01-01T10:00:00", None)], "document_id STRING, chunk_id STRING, pos INT, original STRING, iso STRING, confidence DOUBLE")
    got = sorted((r["event_id"], r["chunk_id"], r["confidence"], r["description"]) for r in timeline.events_from_chunks(chunks, readings).collect())
    assert got == [("EVT_K_1_0001", "C1", 0.8, "t1"), ("EVT_K_1_0002", "C2", 0.8, "t2")]


def test_pairs_by_speaker_equal_brute_force(make):
    people = ["Ann Hall", "Bo Kerr", "ann lee", None, ""]
    texts = ["Then Ann Hall left.", "bo said nothing", "I saw ANN LEE.", None, "Nobody."]
    rows = [{"case_id": c, "document_id": "D" + c, "chunk_id": f"C{i}{j}", "speaker": s, "text": t} for c in "KL" for i, s in enumerate(people) for j, t in enumerate(texts)]
    want = set()
    for x, y in itertools.permutations(rows, 2):
        s, low = y["speaker"], (x["text"] or "").lower()
        if x["case_id"] == y["case_id"] and s and (s.lower() in low or x["speaker"] and s.lower().split()[0] in low):
            want.add((x["case_id"], *sorted((f"{x['document_id']}/{x['chunk_id']}", f"{y['document_id']}/{y['chunk_id']}")), s))
    chunks = make("chunks", *rows, rows[0])
    pairs = contradictions.speaker_pairs(contradictions.speaker_mentions(chunks), contradictions.speaker_members(chunks))
    assert {(r["case_id"], r["key_a"], r["key_b"], s) for r in pairs.collect() for s in r["shared"]} == want


def test_place_mentions_keep_their_digits(make):
    row = contradictions.claims(make("chunks", {"case_id": "K", "document_id": "D", "chunk_id": "C", "text": "He was at 130, then near 101."})).first()
    assert row["places"] == ["at 130", "near 101"]


def test_severities_and_default_confidences(spark):
    pairs = spark.createDataFrame([("LOW", "HIGH"), ("CRITICAL", "HIGH"), ("HIGH", "HIGH"), (None, "LOW")], "a STRING, b STRING")
    assert [tuple(r) for r in pairs.select(scores.compare_severity(F.col("a"), F.col("b")), scores.is_high(F.col("a"))).collect()] == [(-1, False), (1, True), (0, True), (None, False)]
    assert column(spark, ["PHONE", "PERSON", "OTHER", None], scores.default_confidence) == [0.9, 0.85, 0.8, 0.8]


def test_stored_edges_keep_their_properties(spark):
    shape = "case_id STRING, edge_type STRING, from_node STRING, to_node STRING, document_id STRING, chunk_id STRING, n BIGINT"
    stored = spark.createDataFrame([("K", "OWNS", "a", "b", "D1", "C1", 3)], shape)
    more = spark.createDataFrame([("K", "OWNS", "a", "b", "D0", "C0", 1), ("K", "OWNS", "b", "a", "D2", "C1", 1), ("K", "OWNS", "b", "a", "D1", "C1", 1), ("K", "OWNS", "a", "x", "D1", "C1", 1), ("L", "OWNS", "a", "b", "D1", "C1", 1)], shape)
    nodes = spark.createDataFrame([("K", "a"), ("K", "b"), ("L", "a")], "case_id STRING, node_id STRING")
    assert {tuple(r)[2:6] for r in graph.upsert_edges(stored, more, nodes).collect()} == {("a", "b", "D1", "C1"), ("b", "a", "D1", "C1")}


# --- sources, streams -------------------------------------------------------


def test_files_with_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.\n\nTwo.\fThree.")
    (tmp_path / "b.txt").write_text("One.\n\nTwo.\fThree.")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.txt").write_text("")
    rows = files.read_documents(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-5:], r["ord"], r["text"], r["page"]) for r in rows if not r["error"]) == [(p, i, t, n) for p in ("a.txt", "b.txt") for i, t, n in [(0, "One.", 1), (1, "Two.", 1), (2, "Three.", 2)]]
    assert [r["error"].split(":")[0] for r in rows if r["error"]] == ["KeyError"] and len({r["document_id"] for r in rows}) == 2
    hashes = files.file_hashes(spark, str(tmp_path)).collect()
    expected = spark.createDataFrame([(r["path"], r["hash"]) for r in hashes] + [("gone", "x")], "path STRING, hash STRING")
    (tmp_path / "a.txt").write_text("changed")
    assert {r["path"][-5:] for r in files.changed_files(spark, str(tmp_path), expected).collect()} == {"a.txt", "gone"}


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{i}T00:00:00", f"u{i % 2}", None, "READ", "K", None, "ok", None) for i in range(1, 6)], logs.ACCESS_LOG)
    logs.append(rows, str(tmp_path / "log"))
    made = logs.entries(spark.createDataFrame([("u", "r", "READ", None, None, None)], "user_id STRING, role STRING, action STRING, case_id STRING, ip_address STRING, details STRING"))
    logs.append_daily(rows.unionByName(made), str(tmp_path / "daily"))
    assert len(list((tmp_path / "daily").glob("day=*"))) == 6 and logs.read(spark, str(tmp_path / "daily")).where("status = 'SUCCESS'").count() == 1
    (tmp_path / "log" / "case_id=K" / "torn.json").write_text("{broken\n")
    log = logs.read(spark, str(tmp_path / "log"))
    assert log.count() == 5 and logs.select(log, user_id="u1", since="2024-01-02", until="2024-01-04", action=None).count() == 1
    assert [r["timestamp"][:10] for r in logs.latest(log, 2).collect()] == ["2024-01-05", "2024-01-04"]


def test_stores(spark, tmp_path):
    new = spark.createDataFrame([("D", f"C{i}", [float(i)]) for i in range(9)], "document_id STRING, chunk_id STRING, embedding ARRAY<FLOAT>")
    first = store.add_vectors(None, new)
    path = str(tmp_path / "v")
    store.write_once(first, path)
    both = store.add_vectors(store.read(spark, path), new)
    assert sorted(r["vector_id"] for r in both.collect()) == list(range(18)) and store.vector(both, 3).first()["chunk_id"] == "C3"
    with pytest.raises(Exception, match="(?i)exists"):
        store.write_once(first, path)
    one = store.add_vectors(None, new.limit(1))
    assert sorted(r["vector_id"] for r in store.add_vectors(one, new.limit(1)).collect()) == [0, 1]
    assert store.vectors_of(both, new.where("chunk_id = 'C4'")).count() == 2
    nodes = spark.createDataFrame([("a", "K"), ("b", "L")], "node_id STRING, case_id STRING")
    store.append(nodes, str(tmp_path / "n"), by="case_id")
    store.replace_cases(nodes.where("case_id = 'K'").withColumn("node_id", F.lit("z")), str(tmp_path / "n"))
    assert {r["node_id"] for r in store.read(spark, str(tmp_path / "n")).collect()} == {"z", "b"}


def test_streams_equal_batches(spark, table, tmp_path):
    events = table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    cut = events.selectExpr("percentile(unix_micros(ts), 0.5)").first()[0]
    early, late = events.where(F.unix_micros("ts") <= cut), events.where(F.unix_micros("ts") > cut)
    early.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = timelines.gaps(stream(), late="1 hour").writeStream.format("memory").queryName("gaps").outputMode("append").start()
    query.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    # One event long after all others lets the watermark pass them; one from between the batches still counts.
    end = events.orderBy(F.desc("ts")).limit(1)
    end.withColumns({"ts": F.col("ts") + F.expr("interval 30 days"), "user_id": F.lit(-1).cast("long")}).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    got = {(r["user_id"], r["start"], r["end"]) for r in spark.table("gaps").collect()}
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("user_id").orderBy("ts")
    want = events.select("user_id", F.lag("ts").over(w).alias("start"), F.col("ts").alias("end")).where("end - start >= interval 60 minutes")
    assert got == {tuple(r) for r in want.collect()}
    counted = timelines.activity(stream(), late="0 seconds").writeStream.format("memory").queryName("active").outputMode("complete").start()
    counted.processAllAvailable()
    counted.stop()
    assert spark.table("active").agg(F.sum("n")).first()[0] == events.count() + 1
    assert timelines.conflicts(events).count() >= 0


# --- all operators on nothing and on nulls -----------------------------------

EDGES = {
    "types": (extraction.block_types, ["content_blocks"], 1), "pages": (extraction.page_confidence, ["content_blocks"], 0), "documents": (extraction.document_confidence, ["content_blocks"], 1),
    "hashes": (extraction.block_hashes, ["content_blocks"], 1), "furniture": (parsing.page_furniture, ["parsed_blocks"], 1), "sections": (parsing.sections, ["parsed_blocks"], 1),
    "parsed": (parsing.parse_blocks, ["content_blocks"], 0), "spans": (parsing.timestamp_spans, ["content_blocks"], 0), "cleaned": (cleaning.clean_blocks, ["content_blocks"], 1),
    "readings": (cleaning.readings, ["cleaned_blocks"], 0), "groups": (chunking.boundary_groups, ["cleaned_blocks"], 1), "chunks": (chunking.chunk_blocks, ["cleaned_blocks"], 0),
    "rules": (entities.extract, ["chunks"], 0), "listed": (entities.listed_entities, ["ner_results"], 0), "upsert": (graph.upsert, ["graph_nodes"], 1), "events": (timeline.events_from_blocks, ["cleaned_blocks"], 0),
    "results": (extraction.results, ["content_blocks"], 0), "speaker members": (contradictions.speaker_members, ["chunks"], 0), "speaker mentions": (contradictions.speaker_mentions, ["chunks"], 0), "tokens": (chunking.bpe_counts, ["chunks"], 1),
    "judged": (contradictions.judged, ["contradictions"], 0), "severities": (contradictions.severities, ["contradictions"], 1),
}


@pytest.mark.parametrize("name", EDGES)
def test_empty_and_null_rows(make, clash, name):
    operator, tables, of_nulls = EDGES[name]
    assert operator(*[make(t) for t in tables]).count() == 0
    assert operator(*[clash(make(t, {}, {})) for t in tables]).count() == of_nulls


def test_the_rest_stands_without_the_optional_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "dossierflow"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path
