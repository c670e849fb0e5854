"""Words of Arrow text columns, by Arrow kernels, as dictionary indices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` holds about ``limit`` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def coded_words(text: pa.Array, separators: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, index, dictionary) of the words between ``separators`` after A-Z are lower-cased; null text has none."""
    lower = pc.ascii_lower(pc.fill_null(text, ""))
    lists = pc.split_pattern_regex(lower, pattern=separators)
    row, word = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(word), 0)  # a separator at either end leaves an empty piece
    coded = pc.dictionary_encode(word.filter(full))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return (row.filter(full).to_numpy(zero_copy_only=False).astype(np.int64),
            coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)
