"""Arrow batches in slices: a batch may hold ten thousand rows, and what Python makes of them takes many times their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that Python works on at once, about.
BYTES = 1 << 20


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text, or entries of each list; nulls have none."""
    sizes = column.value_lengths() if pa.types.is_list(column.type) else pc.binary_length(column)
    return sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_lengths(lists: pa.Array) -> np.ndarray:
    """Bytes of the texts of each list together."""
    ends = np.append(0, np.cumsum(lengths(lists.flatten())))
    at = np.append(0, np.cumsum(lengths(lists)))
    return np.diff(ends[at])


def slices(b: pa.RecordBatch, sizes: np.ndarray, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """`b` in slices of rows whose sizes come to about `most` (BYTES, if it is not given): a slice goes beyond that by its last row only."""
    begin = np.cumsum(sizes) - sizes
    cuts = np.flatnonzero(np.diff(begin // (most or BYTES))) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
        yield b.slice(i, j - i)
