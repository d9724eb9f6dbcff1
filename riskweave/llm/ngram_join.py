"""N-gram Jaccard join over count vectors in R-trees.

Every text becomes a set of distinct word shingles, and equal sets are one *node*. Shingles
are hashed into groups; a node's counts per group are its point. The sum of the smaller
counts of two points bounds the overlap of their sets from above, and so does the sum over
two boxes' upper corners for all pairs under them.

1. *Cells.* Sets of a link differ in at most H shingles, so among H + 1 groups at least one
   holds the same shingles in both. Nodes of similar size meet in the cell of such a group;
   a node takes part in its own size class and in the next ones in which a partner can be.
   A few groups more than H + 1 make up for groups that are empty in both; nodes with
   more empty groups than that also meet in the cells of their empty groups. No link is lost.
2. *Cells are read in one sorted pass*, spread by key, size and node, so that a cell of any
   size is spread too. Consecutive nodes of a cell form tiles, the lower level of its tree.
3. Each node is first confirmed against the neighbour it met in most cells. That joins
   families of copies, and cells that lie in one component are done.
4. In the others pairs are left. A link needs as many common groups as its sets' sizes and
   the class demand, so pairs are counted over small cells, and their points compared once.
   Inside larger cells an R-tree finds them: tiles have boxes over a few wide groups, and
   pairs of tiles whose boxes allow a link meet in a task. There the points of the
   cell's own groups are packed into a tree by median cuts, and both trees are descended together.
   Pairs of points that the bound leaves, each once for all cells, are verified on the full
   sets. Where two tiles have many such pairs the sets come to the tiles instead, and pairs
   are verified there, most similar first, unless their components have been joined by then.
5. Components come from star steps; a document's component is the least id in it.

Words, shingles and sets are compared by 64-bit hashes. In a cell whose nodes stay apart
(many variants of one text that differ too much) work grows with the square of its nodes,
spread over pairs of tiles; at most ``DENSE`` pairs per row leave a task unconfirmed.

Defined results: a null text, an empty one and one of white space only have no shingles and
are linked with nothing; a row without id takes part but gives no id to its component; repeated
rows are one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import runs, stored, texts_of
from riskweave.llm.components import components
from riskweave.llm.grouped import together, whole_groups
from riskweave.llm.near_dedup import confirmed, node_sets, sets_of
from riskweave.llm.shingles import FACTOR, mixed

SHINGLE_WORDS = 4
MIN_PERCENT = 85
#: Largest size of a class over its smallest.
CLASS_RATIO = 1.25
#: Low bits of a cell's key that hold its class.
CLASS_BITS = 8
#: Wide groups of the boxes of tiles.
WIDE = 32
#: Nodes of a tile, and the shingles that a tile may hold.
TILE_ROWS, TILE_SHINGLES = 512, 1 << 21
#: Points of a leaf in a task's tree.
LEAF_ROWS = 16
#: Nodes of a cell up to which its pairs are counted together with those of other cells.
SMALL = 16
#: Close pairs per row from which on two tiles are verified as a whole, where their sets meet.
DENSE = 8
#: Rows whose groups are handed on together, and sets seen that a task remembers.
RUN_ROWS, SEEN = 2_048, 1 << 20
RUN_BYTES = 1 << 20

PROFILE_SCHEMA = "doc_id long, text_order long, n_shingles long, node long, cells array<long>"
CELL_SCHEMA = "key long, node long, size int, previous long, tile long"


def differing(sizes, min_percent: int):
    """Most shingles in which linked sets differ whose sizes have this sum."""
    return sizes * (100 - min_percent) // (100 + min_percent)


class Classes:
    """Size classes, and the groups into which the shingles of a class are hashed."""

    def __init__(self, min_percent: int) -> None:
        self.min_percent = min_percent
        self.least = [1]

    def of(self, size: int) -> list[int]:
        """The classes in which a set of this size can have a partner at least as large."""
        while 100 * size >= self.min_percent * self.least[-1]:
            self.least.append(max(self.least[-1] + 1, int(self.least[-1] * CLASS_RATIO)))
        own = int(np.searchsorted(self.least, size, "right")) - 1
        last = int(np.searchsorted(np.array(self.least) * self.min_percent, 100 * size, "right")) - 1
        return list(range(own, last + 1))

    def differ(self, number: int) -> int:
        """Most shingles in which linked sets of a class differ."""
        while len(self.least) <= number + 1:
            self.of(self.least[-1])
        return differing(2 * (self.least[number + 1] - 1), self.min_percent)

    def groups(self, number: int) -> tuple[int, int]:
        """(groups, groups that may be empty in both sets of a pair); no groups if only equal sets link."""
        differ = self.differ(number)
        spare = 1 + differ // 32
        return (differ + 1 + spare, spare) if differ else (0, 0)


def grouped(shingles: np.ndarray, groups: int) -> np.ndarray:
    """The group of each shingle, ascending as the shingles are."""
    return ((shingles >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def cells_of(shingles: np.ndarray, classes: Classes) -> np.ndarray:
    """Keys of the cells in which a set takes part."""
    found = []
    for number in classes.of(len(shingles)) if len(shingles) else []:
        groups, spare = classes.groups(number)
        if not groups:
            continue
        group = grouped(shingles, groups)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        own = group[first]
        content = np.add.reduceat(shingles, first)
        if groups - len(own) > spare:
            empty = np.setdiff1d(np.arange(groups), own)
            own, content = np.concatenate((own, empty)), np.concatenate((content, np.zeros(len(empty), np.uint64)))
        place = (np.uint64(number) << np.uint64(32)) + own.astype(np.uint64)
        key = mixed(mixed(content) + place * np.uint64(FACTOR))
        found.append(key >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS) | np.uint64(number))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def class_of(key: int) -> int:
    return key & ((1 << CLASS_BITS) - 1)


def profiles(docs: DataFrame, width: int, min_percent: int) -> DataFrame:
    """Size, node and cells of each document; a task gives the cells of a set once."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(min_percent), set()
        for batch in batches:
            texts = texts_of(batch)
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                sets = sets_of(texts[a:b], width)
                nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
                cells = []
                for node, shingles in zip(nodes, sets, strict=True):
                    cells.append(np.zeros(0, np.uint64) if node in seen else cells_of(shingles, classes))
                    seen.add(node)
                if len(seen) > SEEN:
                    seen.clear()
                ends = np.cumsum([0, *(len(c) for c in cells)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[a:b].cast(pa.int64()), "text_order": batch.column("text_order")[a:b],
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    "cells": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells).view(np.int64))),
                })

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_order")).mapInArrow(profile, PROFILE_SCHEMA)


def tile_rows(key: int, classes: Classes) -> int:
    classes.groups(class_of(key))
    return max(LEAF_ROWS, min(TILE_ROWS, TILE_SHINGLES // classes.least[class_of(key) + 1]))


def met_in_cells(rows: DataFrame, min_percent: int) -> DataFrame:
    """Nodes of cells that hold several, with the node before and the tile.

    A task can't see whether the cells at its borders go on elsewhere, so it hands them on as well.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, classes = TaskContext.get().partitionId(), Classes(min_percent)
        waiting = np.zeros((3, 0), np.int64)  # the last row, whose successor isn't known yet
        before, place = None, -1  # the row before it, and its place in its cell

        def shared(rows: np.ndarray, after: int | None) -> pa.RecordBatch:
            nonlocal before, place
            key = rows[0]
            same = np.empty(len(key), bool)
            same[0] = before is not None and before[0] == key[0]
            same[1:] = key[1:] == key[:-1]
            # places in the cell: runs begin where the key changes, the first may go on
            at = np.arange(len(key))
            begun = np.maximum.accumulate(np.where(same, -1 - place if same[0] else 0, at))
            places = at - begun
            previous = np.concatenate(([before[1] if before is not None else 0], rows[1][:-1]))
            behind = np.append(same[1:], after is not None and key[-1] == after)
            kept = same | behind
            if before is None:
                kept[0] = True
            if after is None:
                kept[-1] = True
            before, place = rows[:, -1], int(places[-1])
            picked = np.flatnonzero(kept)
            tiles = [(part << 32) + int(places[i]) // tile_rows(int(key[i]), classes) for i in picked]
            return pa.RecordBatch.from_pydict({
                "key": pa.array(key[picked]), "node": pa.array(rows[1][picked]), "size": pa.array(rows[2][picked].astype(np.int32)),
                "previous": pa.array(previous[picked], mask=~same[picked]), "tile": pa.array(tiles, pa.int64()),
            })

        for batch in batches:
            fresh = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "node", "size")])
            rows = np.concatenate((waiting, fresh), 1)
            repeated = np.zeros(rows.shape[1], bool)
            repeated[1:] = (rows[:2, 1:] == rows[:2, :-1]).all(0)
            rows = rows[:, ~repeated]
            waiting = rows[:, -1:]
            if rows.shape[1] > 1:
                yield shared(rows[:, :-1], int(waiting[0, 0]))
        if waiting.shape[1]:
            yield shared(waiting, None)

    return rows.select("key", "node", "size").repartitionByRange("key", "size", "node").sortWithinPartitions("key", "size", "node").mapInArrow(scan, CELL_SCHEMA)


def unsettled(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, tile, node, size, root, held) of the cells that hold several components, and how many nodes."""
    rows = cells.select("key", "tile", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = rows.groupBy("key").agg(F.count("*").alias("held"), F.min("root").alias("least"), F.max("root").alias("most"))
    return rows.join(ends.filter("least != most").select("key", "held"), "key")


def class_column(key: str = "key") -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << CLASS_BITS) - 1).cast("long"))


def often_met(rows: DataFrame, min_percent: int) -> DataFrame:
    """(a, b, number): pairs of different components that share as many cells of a class as a link needs.

    Linked sets that differ in d shingles agree in all groups but d, of which some may be empty
    in both. Only small cells are counted; a pair that also meets in a larger one is found there.
    """
    classes = Classes(min_percent)
    classes.of(1 << 31)
    allowed = F.array(*(F.lit(classes.differ(c)) for c in range(len(classes.least) - 1)))
    x = rows.select("key", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("root").alias("root_a"))
    y = rows.select("key", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"))
    close = (100 * F.least("size_a", "size_b") >= min_percent * F.greatest("size_a", "size_b")) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
    met = x.join(y, "key").filter(close).withColumn("number", class_column())
    counted = met.groupBy("a", "b", "number").agg(F.count("*").alias("n"), F.first(F.col("size_a") + F.col("size_b")).alias("sizes"))
    own = F.floor(F.col("sizes") * (100 - min_percent) / (100 + min_percent))
    return counted.filter(F.col("n") > F.element_at(allowed, F.col("number").cast("int") + 1) - own).select("a", "b", "number")


def within_bound(pairs: DataFrame, points: DataFrame, min_percent: int) -> DataFrame:
    """(a, b): the pairs whose points allow a link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int32), np.frombuffer(y, np.int32)
                kept.append((100 + min_percent) * int(np.minimum(x, y).sum()) >= min_percent * int(x.sum() + y.sum()))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = points.select(F.col("node").alias("a"), "number", F.col("point").alias("left"))
    right = points.select(F.col("node").alias("b"), "number", F.col("point").alias("right"))
    return pairs.join(left, ["a", "number"]).join(right, ["b", "number"]).select("a", "b", "left", "right").mapInArrow(test, "a long, b long")


def points_of(sets: DataFrame, min_percent: int) -> DataFrame:
    """Counts per group of each class of a node, and per wide group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(min_percent)
        for batch in batches:
            found: dict[str, list] = {"node": [], "number": [], "point": [], "wide": []}
            for node, shingles in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                shingles = np.frombuffer(shingles, np.uint64)
                wide = np.bincount(grouped(shingles, WIDE), minlength=WIDE)
                for number in classes.of(len(shingles)):
                    groups, _ = classes.groups(number)
                    point = np.bincount(grouped(shingles, groups), minlength=groups) if groups else np.zeros(0)
                    for name, value in zip(found, (node, number, point.astype(np.int32).tobytes(), wide), strict=True):
                        found[name].append(value)
            yield pa.RecordBatch.from_pydict(found, schema=pa.schema([
                ("node", pa.int64()), ("number", pa.int64()), ("point", pa.binary()), ("wide", pa.list_(pa.int32()))]))

    return sets.mapInArrow(count, "node long, number long, point binary, wide array<int>")


def tile_pairs(rows: DataFrame, min_percent: int) -> DataFrame:
    """(key, a, b) of the tiles of a cell between whose boxes a link is possible."""
    corners = [F.max(F.col("wide")[i]).alias(f"w{i}") for i in range(WIDE)]
    tiles = rows.groupBy("key", "tile").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"), *corners)
    a, b = tiles.alias("a"), tiles.alias("b")
    overlap = sum((F.least(F.col(f"a.w{i}"), F.col(f"b.w{i}")) for i in range(WIDE)), F.lit(0))
    enough = (100 + min_percent) * overlap >= min_percent * (F.col("a.least") + F.col("b.least"))
    sizes = (100 * F.col("a.most") >= min_percent * F.col("b.least")) & (100 * F.col("b.most") >= min_percent * F.col("a.least"))
    one_root = (F.col("a.low") == F.col("b.high")) & (F.col("a.high") == F.col("b.low"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.tile") <= F.col("b.tile")))
    return met.filter(enough & sizes & ~one_root).select(F.col("a.key").alias("key"), F.col("a.tile").alias("a"), F.col("b.tile").alias("b"))


class Tree:
    """A packed R-tree over some of the points: boxes by their upper corner and the range of sizes."""

    def __init__(self, rows: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> None:
        self.rows = rows
        self.corner = points[rows].max(0)
        self.least, self.most = int(sizes[rows].min()), int(sizes[rows].max())
        self.parts: list[Tree] = []
        if len(rows) > LEAF_ROWS:
            spread = points[rows].var(0)
            order = rows[np.argsort(points[rows, int(spread.argmax())], kind="stable")]
            self.parts = [Tree(half, points, sizes) for half in np.array_split(order, 2)]


def allowed(x: Tree, y: Tree, p: int) -> bool:
    """Can points under both boxes be linked?"""
    if 100 * x.most < p * y.least or 100 * y.most < p * x.least:
        return False
    return (100 + p) * int(np.minimum(x.corner, y.corner).sum()) >= p * (x.least + y.least)


def close_points(left: np.ndarray, right: np.ndarray, points: np.ndarray, sizes: np.ndarray, roots: np.ndarray, p: int) -> list[tuple[float, int, int]]:
    """(bound of the similarity, row, row) of pairs that the summed minima allow, by descending both trees."""
    same = left is right
    x = Tree(left, points, sizes)
    todo, found = [(x, x if same else Tree(right, points, sizes))], []
    while todo:
        x, y = todo.pop()
        if not allowed(x, y, p):
            continue
        if x.parts or y.parts:
            xs, ys = x.parts or [x], y.parts or [y]
            todo += [(s, t) for i, s in enumerate(xs) for j, t in enumerate(ys) if x is not y or i <= j]
            continue
        for i in x.rows.tolist():
            others = y.rows[y.rows > i] if x is y else y.rows
            others = others[roots[others] != roots[i]]
            overlap = np.minimum(points[others], points[i]).sum(1, dtype=np.int64)
            total = sizes[others] + sizes[i]
            near = (100 + p) * overlap >= p * total
            found += zip((overlap / (total - overlap))[near].tolist(), [i] * int(near.sum()), others[near].tolist())
    return found


def linked(x: np.ndarray, y: np.ndarray, p: int) -> bool:
    """Are two sets, in ascending order, similar enough?"""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.count_nonzero(y[at] == x))
    return 100 * common >= p * (len(x) + len(y) - common)


def in_tile_pairs(rows: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of both tiles of each pair of tiles."""
    sides = pairs.select("key", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    return sides.join(rows, ["key", "tile"]).select("key", "a", "b", "tile", "node", "root", *columns)


def tiles_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two tiles of a group; the same array if they are one."""
    tile = table["tile"].to_numpy()
    left, right = (np.flatnonzero(tile == table[c][0].as_py()) for c in ("a", "b"))
    return (left, left) if table["a"][0] == table["b"][0] else (left, right)


def close_pairs(rows: DataFrame, pairs: DataFrame, min_percent: int) -> DataFrame:
    """Pairs of nodes in different components that the bound allows: (x, y), or (key, a, b) of two tiles with many."""
    schema = "x long, y long, key long, a long, b long"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key", "a", "b"], RUN_ROWS):
            found: list[tuple] = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                found += in_tiles(table.slice(s, e - s))
            yield pa.RecordBatch.from_pydict({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("x", "y", "key", "a", "b"))})

    def in_tiles(table: pa.Table) -> list[tuple]:
        left, right = tiles_of(table)
        if not len(left) or not len(right):
            return []
        node, root, size = (table[c].to_numpy() for c in ("node", "root", "size"))
        points = np.stack([np.frombuffer(x, np.int32) for x in table["point"].to_pylist()])
        close = close_points(left, right, points, size.astype(np.int64), root, min_percent)
        if len(close) > DENSE * table.num_rows:
            return [(None, None, *(table[c][0].as_py() for c in ("key", "a", "b")))]
        return [(*sorted((int(node[i]), int(node[j]))), None, None, None) for _, i, j in close]

    return together(in_tile_pairs(rows, pairs, ["size", "point"]), ["key", "a", "b"]).mapInArrow(join, schema)


def dense_links(rows: DataFrame, pairs: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """(a, b): confirmed links between the components of two tiles with many close pairs, enough to join what belongs together."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(min_percent)
        for table, starts in whole_groups(batches, ["key", "a", "b"], RUN_ROWS):
            links = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                links += in_tiles(table.slice(s, e - s), classes)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    def in_tiles(table: pa.Table, classes: Classes) -> list[tuple[int, int]]:
        groups, _ = classes.groups(class_of(table["key"][0].as_py()))
        node, root = (table[c].to_numpy() for c in ("node", "root"))
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        points = np.array([np.bincount(grouped(x, groups), minlength=groups) for x in sets], np.int32)
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        links = []
        for _, i, j in sorted(close_points(*tiles_of(table), points, sizes, root, min_percent), reverse=True):
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y and linked(sets[i], sets[j], min_percent):
                above[max(x, y)] = min(x, y)
                links.append((int(node[i]), int(node[j])))
        return links

    dealt = in_tile_pairs(rows, pairs, []).join(sets, "node")
    return together(dealt, ["key", "a", "b"]).mapInArrow(join, "a long, b long")


def ngram_components(docs: DataFrame, width: int = SHINGLE_WORDS, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, root, component_id) of each document under links of similar shingle sets."""
    rows = stored(profiles(docs, width, min_percent), "join-profiles")
    filled = rows.filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_order")).alias("first")
    nodes = stored(filled.groupBy("node").agg(first).select("node", "first.doc_id", "first.text_order"), "join-nodes")
    entries = filled.select("node", F.col("n_shingles").cast("int").alias("size"), F.explode("cells").alias("key"))
    cells = stored(met_in_cells(entries, min_percent), "join-cells")
    sets = stored(node_sets(docs, nodes.join(cells.select("node").distinct(), "node"), width), "join-sets")
    often = cells.filter("previous IS NOT NULL").groupBy("node", "previous").agg(F.count("*").alias("n"))
    best = often.groupBy("node").agg(F.max(F.struct("n", "previous")).alias("best"))
    tried = best.select(F.col("node").alias("a"), F.col("best.previous").alias("b"))
    roots = components(confirmed(tried, sets, min_percent), "join-stars")
    left = stored(unsettled(cells, roots), "join-unsettled")
    points = stored(points_of(sets.join(left.select("node").distinct(), "node"), min_percent), "join-points")
    few = within_bound(often_met(left.filter(F.col("held") <= SMALL), min_percent), points, min_percent)
    many = left.filter(F.col("held") > SMALL).withColumn("number", class_column()).join(points, ["node", "number"])
    many = stored(many.select("key", "tile", "node", "size", "root", "point", "wide"), "join-tiles")
    close = stored(close_pairs(many, tile_pairs(many, min_percent), min_percent), "join-close")
    pairs = few.unionByName(close.filter("x IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct()
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(confirmed(pairs, sets, min_percent).unionByName(known), "join-stars")
    dense = close.filter("key IS NOT NULL").select("key", "a", "b")
    if not dense.isEmpty():  # few corpora have such cells
        now = many.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(dense_links(now, dense, sets, min_percent).unionByName(known), "join-stars")
    rooted = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = rooted.join(least, "root").select("node", "root", "component_id")
    columns = ["doc_id", "n_shingles", "root", "component_id"]
    full = filled.select("doc_id", "n_shingles", "node").join(found, "node").select(*columns)
    empty = rows.filter("n_shingles = 0").withColumns({"root": F.lit(None).cast("long"), "component_id": F.col("doc_id")}).select(*columns)
    return full.unionByName(empty)
