"""Comparing neighbours in a globally sorted table.

Rows are range-partitioned and sorted by a key and further order columns, so a key of
any frequency is spread over as many tasks as it needs. Each row is compared with the
rows just before it that have its key, also across the borders of tasks: a task hands
out its first and last rows, and those few are compared in a second, small pass. Where
the borders fall can add comparisons of rows around them, but takes none away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored

#: Compares rows: the table, and two arrays of row numbers (earlier, later). Returns found rows.
Compare = Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]


def pairs_back(keys: np.ndarray, reach: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (earlier, later) that share their key, at most ``near`` apart or ``reach`` among a key's first rows."""
    early, late = [], []
    first = np.ones(len(keys), bool)
    first[reach + 1 :] = keys[reach + 1 :] != keys[: -reach - 1]
    for step in range(1, min(reach, len(keys) - 1) + 1):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        if step > near:
            at = at[first[at + step]]
        early.append(at)
        late.append(at + step)
    if not early:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(early), np.concatenate(late)


def compare_neighbours(
    rows: DataFrame, order: list[str], reach: int, compare: Compare, found_schema: str, purpose: str, near: int | None = None,
) -> DataFrame:
    """What ``compare`` finds for pairs of rows up to ``reach`` apart with equal ``order[0]``.

    With ``near`` only the first ``reach + 1`` rows of a key are all compared with each
    other, later ones with the ``near`` rows before them. The result is stored.
    """
    near = reach if near is None else near
    names, kinds = rows.columns, dict(rows.dtypes)
    found_names = [part.split()[0] for part in found_schema.split(", ")]
    edge_schema = ", ".join(f"row_{n} {kinds[n]}" for n in names)
    schema = f"{found_schema}, {edge_schema}, edge_part int, edge_place long, edge_last boolean"
    key = order[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        carry: pa.Table | None = None
        target = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            table = fresh if carry is None else pa.concat_tables([carry, fresh]).combine_chunks()
            old = table.num_rows - fresh.num_rows
            early, late = pairs_back(table[key].to_numpy(), reach, near)
            new = late >= old
            found = compare(table, early[new], late[new])
            if target is None:
                target = output_schema(found.schema, fresh.schema)
            yield from padded(found, target)
            if seen < reach:
                yield from padded(edges(fresh.slice(0, reach - seen), part, seen, False), target)
            seen += fresh.num_rows
            carry = table.slice(max(0, table.num_rows - reach - 1))
        if carry is not None:
            carry = carry.slice(max(0, carry.num_rows - reach))
            last = edges(carry, part, seen - carry.num_rows, True)
            yield from padded(last, target)

    def edges(table: pa.Table, part: int, first: int, last: bool) -> pa.Table:
        n = table.num_rows
        table = table.rename_columns([f"row_{c}" for c in table.column_names])
        return (
            table.append_column("edge_part", pa.array([part] * n, pa.int32()))
            .append_column("edge_place", pa.array(np.arange(first, first + n), pa.int64()))
            .append_column("edge_last", pa.array([last] * n, pa.bool_()))
        )

    def output_schema(found: pa.Schema, fresh: pa.Schema) -> pa.Schema:
        fields = [pa.field(f.name, f.type) for f in found] + [pa.field(f"row_{f.name}", f.type) for f in fresh]
        return pa.schema([*fields, ("edge_part", pa.int32()), ("edge_place", pa.int64()), ("edge_last", pa.bool_())])

    def padded(table: pa.Table, target: pa.Schema) -> list[pa.RecordBatch]:
        if not table.num_rows:
            return []
        columns = [table[f.name] if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in target]
        return pa.Table.from_arrays(columns, schema=target).combine_chunks().to_batches()

    def at_borders(batch: pa.Table) -> pa.Table:
        """Pairs across borders among the edge rows of one key, at most 2 * reach for each task."""
        frame = batch.select(["edge_part", "edge_place", "edge_last"]).to_pandas()
        frame["row"] = np.arange(len(frame))
        frame = frame.sort_values(["edge_part", "edge_place", "edge_last"], kind="stable")
        # the rows of a key in a task that it fills from border to border: all lie between its first and last row
        per_part = frame.groupby("edge_part").edge_place.agg(["min", "max"])
        counts = per_part["max"] - per_part["min"] + 1
        before = counts.cumsum() - counts
        frame["rank"] = frame.edge_place - frame.edge_part.map(per_part["min"]) + frame.edge_part.map(before)
        frame = frame.drop_duplicates("rank")
        rank, part, row = (frame[c].to_numpy() for c in ("rank", "edge_part", "row"))
        early, late = pairs_back(np.zeros(len(frame)), reach, reach)
        close = (rank[late] - rank[early] <= reach) & (part[late] != part[early])
        table = batch.select([f"row_{n}" for n in names]).rename_columns(names)
        return compare(table, row[early[close]], row[late[close]])

    # range borders come from a sample of whole sort keys, so frequent keys are cut too
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    result = stored(ranged.mapInArrow(scan, schema), purpose)
    borders = result.filter("edge_part IS NOT NULL")
    shared = borders.groupBy(f"row_{key}").agg(F.min("edge_part").alias("_a"), F.max("edge_part").alias("_b")).filter("_a < _b")
    across = borders.drop(*found_names).join(shared.drop("_a", "_b"), f"row_{key}").groupBy(f"row_{key}").applyInArrow(at_borders, found_schema)
    return result.filter("edge_part IS NULL").select(*found_names).unionByName(across)
