"""Centroid clustering with a PCA-rotated filter.

Vectors become integers, and clustering is exact integer arithmetic from there on:

1. The second moments of all vectors, summed per task, give a rotation whose leading axes
   hold most of their energy. It only decides speed: any rotation gives the same results.
2. Each vector is stored with its leading rotated coordinates and the norm of the rest.
   For a centroid treated alike, the squared distance of the coordinates plus the squared
   difference of the norms is a lower bound of the squared distance.
3. The centroid with the least bound gives a distance; only centroids whose bound, less a
   margin for rounding, does not exceed it are verified, in integers.
4. Tasks return sums per cluster, one row of ``k * components`` numbers each, which are
   summed again in a fixed number of groups; what reaches the driver does not grow.

Defined results: null vectors, those with another number of components, and those with a
null or non-finite component are left out, as are those with a component of ``LARGEST`` or
more in magnitude, whose distances a long cannot hold. Vectors without id are clustered but
come last among the initial centroids; of vectors with one id the lesser components come
first. With fewer vectors than centroids each vector is one, an empty table gives no rows. A
total beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored

COMPONENTS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Leading rotated coordinates that are stored.
LEADING = 12
#: Vectors with larger components are left out: 64 squares of differences of 64 * LARGEST fit into a long.
LARGEST = float(1 << 21)
#: Groups in which the tasks' sums are added up before they reach the driver.
GROUPS = 32
#: Vectors handled at a time inside a task.
RUN_ROWS = 8_192

ENCODED_SCHEMA = "vec_id long, whole array<int>, leading array<double>, rest double"
SUMS_SCHEMA = "part int, sums binary"


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, whole): the vectors that take part, as integers."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fits = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < LARGEST, F.lit(False)))
    # NaN compares as larger than any number, so the one test covers it and the infinities
    return vectors.filter((F.size("embedding") == components) & fits).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("int")).alias("whole"))


def first_centroids(whole: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    seeded: Column = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select(seeded.alias("seeded"), "whole").orderBy(F.asc_nulls_last("seeded"), "whole").limit(k)
    return [list(r["whole"]) for r in rows.collect()]  # k rows


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def summed(partial: DataFrame, kind: type) -> np.ndarray | None:
    """The sum of the tasks' arrays, in ``GROUPS`` groups first; what reaches the driver has a fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind) for x in table["sums"].to_pylist())
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    dealt = partial.withColumn("part", F.pmod("part", F.lit(GROUPS)))
    found = dealt.groupBy("part").applyInArrow(add, "sums binary").collect()
    return sum(np.frombuffer(r["sums"], kind).astype(object if kind is np.int64 else kind) for r in found) if found else None


def rotation(whole: DataFrame, components: int = COMPONENTS, leading: int = LEADING) -> np.ndarray:
    """Axes with the most energy of all vectors, one per column."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components, components))
        for batch in batches:
            x = matrix(batch.column("whole"), np.float64, components)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    total = summed(whole.select("whole").mapInArrow(moments, SUMS_SCHEMA), np.float64)
    if total is None:
        return np.eye(components)[:, :leading]
    return np.linalg.eigh(total.reshape(components, components))[1][:, ::-1][:, :leading].copy()


def rotated(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the norm of what they leave out."""
    x = x.astype(np.float64)
    leading = x @ axes
    left = x - leading @ axes.T
    return leading, np.sqrt((left * left).sum(1))


def encoded(whole: DataFrame, axes: np.ndarray) -> DataFrame:
    components, kept = axes.shape

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leading, rest = rotated(matrix(batch.column("whole"), np.int64, components), axes)
            offsets = pa.array(np.arange(0, len(rest) * kept + 1, kept, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("whole"), pa.ListArray.from_arrays(offsets, pa.array(leading.ravel())), pa.array(rest)],
                names=["vec_id", "whole", "leading", "rest"])

    return whole.select("vec_id", "whole").mapInArrow(encode, ENCODED_SCHEMA)


def nearest(x: np.ndarray, leading: np.ndarray, rest: np.ndarray, centres: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance of each vector, and the distances that were verified."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    centre_leading, centre_rest = rotated(centres, axes)
    bounds = np.empty((len(x), len(centres)))
    for j in range(len(centres)):
        apart = leading - centre_leading[j]
        bounds[:, j] = (apart * apart).sum(1) + (rest - centre_rest[j]) ** 2
    # rounding of the coordinates is far below a billionth of the squares involved
    energy = (leading * leading).sum(1) + rest * rest
    margin = 1e-9 * (energy[:, None] + ((centres.astype(np.float64)) ** 2).sum(1)) + 1e-6

    def distance(rows: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = x[rows] - centres[j]
        return (apart * apart).sum(1)

    every = np.arange(len(x))
    cluster = bounds.argmin(1)
    best = distance(every, cluster)
    survivors = bounds - margin <= best[:, None]
    survivors[every, cluster] = False
    verified = len(x) + int(survivors.sum())
    for j in range(len(centres)):
        rows = np.flatnonzero(survivors[:, j])
        exact = distance(rows, np.full(len(rows), j))
        closer = (exact < best[rows]) | ((exact == best[rows]) & (j < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = exact[closer], j
    return cluster, best, verified


def assigned(batch: pa.RecordBatch, centres: np.ndarray, axes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, vectors, clusters, distances) of runs of a batch."""
    for a in range(0, batch.num_rows, RUN_ROWS):
        part = batch.slice(a, RUN_ROWS)
        x = matrix(part.column("whole"), np.int64, axes.shape[0])
        cluster, distance, _ = nearest(
            x, matrix(part.column("leading"), np.float64, axes.shape[1]), part.column("rest").to_numpy(zero_copy_only=False), centres, axes)
        yield a, a + part.num_rows, x, cluster, distance


def moved(vectors: DataFrame, centres: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; empty ones stay."""
    k, components = centres.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, components + 1), np.int64)
        for batch in batches:
            for _, _, x, cluster, _ in assigned(batch, centres, axes):
                for j in np.unique(cluster):
                    own = cluster == j
                    total[j, :components] += x[own].sum(0)
                    total[j, components] += int(own.sum())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    total = summed(vectors.select("whole", "leading", "rest").mapInArrow(sums, SUMS_SCHEMA), np.int64)
    if total is None:
        return centres
    total = total.reshape(k, components + 1)
    new = centres.copy()
    for j in range(k):
        n = int(total[j, components])
        if n:
            new[j] = [int(s) // n for s in total[j, :components]]
    return new


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, leading: int = LEADING) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of each vector that takes part."""
    whole = stored(whole_vectors(vectors, components), "cluster-whole")
    centres = np.array(first_centroids(whole, k), np.int64).reshape(-1, components)
    axes = rotation(whole, components, leading)
    ready = stored(encoded(whole, axes), "cluster-encoded")
    for _ in range(rounds if len(centres) else 0):
        centres = moved(ready, centres, axes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, cluster, distance in assigned(batch, centres, axes):
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id")[a:b], "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})

    rows = stored(ready.mapInArrow(assign, "vec_id long, cluster int, distance long"), "cluster-assigned")
    # one row per centroid
    of_cluster = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    per_cluster = {r["cluster"]: int(r["sum"]) for r in of_cluster.collect()}
    total = sum(per_cluster.values())
    table = [(j, fits(s), fits(total), centres[j].tolist()) for j, s in sorted(per_cluster.items())]
    totals = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def fits(total: int) -> int | None:
    return total if total < 1 << 63 else None


def digest(centroid: Column) -> Column:
    """Lower-case hex sha256 of a centroid's components, joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)

