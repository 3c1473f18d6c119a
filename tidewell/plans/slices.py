"""Bounded slices of Arrow batches, so that what a task's Python holds does not grow with its table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of lists, and characters of texts, that are worked on at once; a longer row is a slice of its own.
SLICE_ENTRIES = 1 << 18
SLICE_CHARS = 1 << 21


def list_sizes(lists: pa.Array) -> np.ndarray:
    """Entries of each list; null lists have none."""
    return np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype("int64")


def text_sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; null texts have none."""
    return np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype("int64")


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose rows' ``sizes`` add up to ``most`` at the most, and which have that many rows at the most."""
    ends = np.cumsum(sizes + 1)  # a row without entries counts too
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
