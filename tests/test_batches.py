import pyarrow as pa

from dossierflow.batches import bounded


def test_rows_stay_and_batches_shrink():
    rows = ["x" * n for n in (5, 100_000, 3, 2_000_000, 1)] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["i", "t"])
    parts = list(bounded(iter([batch, batch.slice(0, 0)]), 300_000))
    assert [x for p in parts for x in p.column(1).to_pylist()] == rows
    assert all(p.num_rows <= 1 or p.nbytes <= 600_000 for p in parts)
