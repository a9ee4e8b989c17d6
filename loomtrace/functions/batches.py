"""Whole groups out of a sorted partition, as Arrow tables of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with all rows of a key in one partition, sorted by key and order, as whole_groups needs them.

    The exchange is by a hash of the key. One by the key itself is dropped where a join by the key stands below, and
    adaptive execution, which doesn't know that a task needs whole groups, may then read that join's exchange by its
    writers (local reads beside a broadcast) or in parts (skew), so that groups come in pieces.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where a new run of equal keys begins, 0 included; the table is sorted by keys."""
    n = table.num_rows
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        c = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, each with whole groups; at most one group more is held than that.

    The partition must be sorted by keys, and each group must be of a bounded size: callers send larger groups
    another way.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            count += b.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(group_starts(table, keys)[-1])
        if cut == 0:
            continue
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        count = table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def text_batches(batches: Iterator[pa.RecordBatch], column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``chars`` bytes of the column, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(column)
        sizes = np.cumsum(pa.compute.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + chars, side="right")))
            yield b.slice(start, end - start)
            start = end
