"""Arrow batches of bounded size, for rows that Python turns into other rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of rows handled at once; one larger row is handled by itself.
SLICE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``limit`` bytes, so that a worker holds the objects of one run alone."""
    for b in batches:
        rows = max(1, limit * b.num_rows // max(1, b.nbytes))
        yield from (b.slice(k, rows) for k in range(0, b.num_rows, rows))
