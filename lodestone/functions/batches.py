"""Arrow batches of whole texts, cut so that a Python worker's memory doesn't depend on how many rows a batch has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE_BYTES = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` bytes, of one row at least."""
    for batch in batches:
        rows, total = batch.num_rows, batch.nbytes
        step = max(1, rows * most // total) if total > most else max(1, rows)
        yield from (batch.slice(at, min(step, rows - at)) for at in range(0, rows, step))
