"""Arrow batches of a size that Python objects made from them still fit in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a batch whose texts are turned into Python objects at once.
MOST_BYTES = 8 << 20


def bounded(batches: Iterator[pa.RecordBatch], most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes (a single larger row is a batch of its own)."""
    for batch in batches:
        parts = min(batch.num_rows, -(-batch.nbytes // most))
        if parts <= 1:
            yield batch
            continue
        step = -(-batch.num_rows // parts)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from [part] if part.num_rows == 1 or part.nbytes <= 2 * most else bounded(iter([part]), most)
