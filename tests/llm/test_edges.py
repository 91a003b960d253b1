"""Nulls, empty texts and tables, repeated rows and clashing columns, for every operator."""

import pytest

from dossierflow.llm import cooccurrence, leakage, names, packing, pii, scans, subjects, tokenize, turns

CASES = {
    "pairs": (cooccurrence.frequent_pairs, ["ner_results", "contradictions"]),
    "turns": (turns.speaker_turns, ["parsed_blocks", "speaker_roster"]),
    "names": (names.same_nodes, ["ner_results", "graph_nodes", "contradictions"]),
    "scans": (scans.scan_findings, ["content_blocks", "parsed_blocks"]),
    "paragraphs": (scans.paragraphs, ["content_blocks", "parsed_blocks"]),
    "personal": (pii.personal_items, ["content_blocks", "chunks", "speaker_roster"]),
    "redacted": (pii.redacted, ["content_blocks", "chunks", "speaker_roster"]),
    "packing": (packing.pack, ["cleaned_blocks"]),
    "encoding": (tokenize.encode_corpus, ["documents"]),
    "leaks": (leakage.leaks, ["documents", "eval_items"]),
    "subjects": (subjects.document_subjects, ["documents", "subject_labels", "subject_areas"]),
}
#: Rows that come out of a row of nulls.
OF_NULLS = {"encoding": 1, "redacted": 2}


@pytest.mark.parametrize("name", CASES)
def test_empty_tables(make, name):
    operator, tables = CASES[name]
    assert operator(*[make(t) for t in tables]).count() == 0


@pytest.mark.parametrize("name", CASES)
def test_rows_of_nulls(make, name):
    operator, tables = CASES[name]
    assert operator(*[make(t, {}, {}) for t in tables]).count() == (OF_NULLS.get(name, 0) if name != "encoding" else 2)


@pytest.mark.parametrize("name", CASES)
def test_clashing_columns_and_repeated_rows_change_nothing(table, clash, name):
    operator, tables = CASES[name]
    plain = operator(*[table(t) for t in tables])
    keep = {"documents"}  # its ids are unique
    twice = operator(*[clash(table(t) if t in keep else table(t).unionByName(table(t))) for t in tables])
    assert twice.columns == plain.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    if name == "subjects":  # repeated labels are one label
        assert rows(twice) == rows(plain)
    elif name in ("scans", "paragraphs"):  # counts of words double, and with them none of the ratios
        assert abs(twice.count() - plain.count()) <= 0.02 * plain.count() + 2
    else:
        assert rows(twice) == rows(plain)
