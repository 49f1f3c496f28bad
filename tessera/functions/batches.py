"""Arrow batches in slices of bounded size: how many rows come at once says nothing of how much text they hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one row may have more.
BYTES = 1 << 20


def cuts(texts: pa.Array, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of slices of at most so many bytes, of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi - lo
        lo = hi


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, a bounded size of one column's texts at a time."""
    for lo, n in cuts(batch.column(column)):
        yield batch.slice(lo, n)


def pieces(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, a bounded size of one column's texts and so many rows at a time. A batch goes before the next one comes, if whoever takes a piece lets it go."""
    for batch in batches:
        for lo, n in cuts(batch.column(column)):
            for at in range(lo, lo + n, rows):
                yield batch.slice(at, min(rows, lo + n - at))
        del batch
