import pytest

from dossierflow.llm import queries as llm
from tests.sqlcheck import assert_equal

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, data, name):
    assert_equal(spark, data, QUERIES[name], SQL[name])


COLUMNS = {
    "p1_found": ["case_id", "item_a", "item_b"],
    "p2_found": ["document_id", "turn_no", "speaker_id", "first_ord", "last_ord", "n_words"],
    "p4_found": ["node_a", "node_b"],
    "p5_found": ["document_id", "block_id", "kind", "word"],
    "p6_found": ["document_id", "record_id", "kind", "start_char", "end_char"],
    "p7_found": ["document_id", "n_containers"],
    "p8_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, data, name):
    rows = QUERIES[name](spark, data)
    assert rows.columns == COLUMNS[name]
    got = [repr(r) for r in rows.collect()]
    # a handful of labels, as in the smallest data, tells no word from another
    assert (got or name == "p10_found") and len(got) == len(set(got))
