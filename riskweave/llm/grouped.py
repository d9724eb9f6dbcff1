"""Groups of rows inside a task, handed on in runs of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def together(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows with equal keys in one task and next to each other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *(order or []))


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each group of neighbours with equal keys, and the number of rows."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        codes = table[key].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), n)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``limit`` rows that end with a group, and the starts of their groups.

    A group is never cut, so a table holds more rows only if a single group does.
    """
    held: list[pa.RecordBatch] = []
    n, enough = 0, limit
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(table, keys)
        if len(starts) > 2:  # the last group may go on in the next batch
            yield table.slice(0, int(starts[-2])), starts[:-1]
            table = table.slice(int(starts[-2]))
        held, n = table.to_batches(), table.num_rows
        enough = max(limit, 2 * n)
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts_of(table, keys)


def with_ends(tables: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[tuple[pa.Table, np.ndarray, bool, bool]]:
    """The same, saying which table is a task's first and which its last."""
    held, first = None, True
    for item in tables:
        if held is not None:
            yield *held, first, False
            first = False
        held = item
    if held is not None:
        yield *held, first, True
