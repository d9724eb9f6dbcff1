"""Line dedup by pairwise alignment.

Documents that share lines are aligned, and the blocks they have in common are deleted
from the later one (the one with the larger id).

1. Every line with a word is hashed. A line that occurs in several documents points each
   of them to the first one that has it; a *rare* line (in at most ``RARE`` documents)
   points to the nearest earlier one as well. So do the shortest runs of lines from each
   line on and up to it that hold ``MIN_BLOCK_WORDS`` words, to the run's first holder. So a
   line costs at most four pairs per document however many share it, and every part of a
   common block leads to an earlier document that has it.
2. A pair is aligned on the lines that either shares with any document: patience diff
   matches the lines that occur once in both parts, keeps their longest increasing
   subsequence, and repeats inside the gaps; matched lines grow over equal neighbours.
3. Runs of consecutive aligned lines that hold ``MIN_BLOCK_WORDS`` words are common
   blocks. One alignment has one order and leaves gaps without a line that occurs once, so
   what it left is aligned again at unique places of another kind: the shortest runs with
   enough words. The later document loses the lines of all blocks of a pair, in whatever
   order they stand; what several partners cover is joined.

Copies are no special case: a copy is aligned with the first of them and loses all lines.

Defined results: lines are compared as they stand, without line ends; lines of white
space only are never anchors and go only inside a block; null and empty texts have no
lines and stay as they are; rows without id are later than all others and have no
partner among themselves unless their text hashes differ; repeated rows (one id and
text) are one document; an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import free_name, hidden, stored, texts_of

#: Documents that a rare line occurs in at the most.
RARE = 50
#: Rows that a task holds as Python objects at a time; they take many times the memory of the Arrow batch.
SLICE_ROWS = 256
MIN_BLOCK_WORDS = 10

LINE_SCHEMA = "no_id boolean, doc_id long, text_order long, n_lines int, places array<int>, lines array<long>, words array<int>"
BLOCK_SCHEMA = "no_id boolean, doc_id long, text_order long, start int, until int, from_id long"
KEY = ["no_id", "doc_id", "text_order"]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of a few rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def line_table(docs: DataFrame) -> DataFrame:
    """Lines with a word of each document: place, hash and number of words."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, places, hashes, words = [], [], [], []
            for text in texts_of(batch):
                parts = text.split(b"\n")
                sizes = [len(p.split()) for p in parts]
                full = [i for i, n in enumerate(sizes) if n]
                counts.append(len(parts) if text else 0)
                places.append(full)
                hashes.append([xxhash.xxh3_64_intdigest(parts[i]) - (1 << 63) for i in full])
                words.append([sizes[i] for i in full])
            yield pa.RecordBatch.from_pydict({
                "no_id": batch.column("doc_id").is_null(), "doc_id": batch.column("doc_id").cast(pa.int64()).fill_null(0), "text_order": batch.column("text_order"),
                "n_lines": pa.array(counts, pa.int32()), "places": pa.array(places, pa.list_(pa.int32())),
                "lines": pa.array(hashes, pa.list_(pa.int64())), "words": pa.array(words, pa.list_(pa.int32())),
            })

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_order"))
    return keyed.mapInArrow(lines, LINE_SCHEMA)


def document() -> Column:
    return F.struct(*KEY)


def shared_lines(rows: DataFrame) -> DataFrame:
    """Occurrences of the lines that several documents have, with the line's count and first document."""
    zipped = F.arrays_zip(F.col("lines").alias("line"), F.col("places").alias("place"), F.col("words"))
    held = rows.select(document().alias("doc"), F.posexplode(zipped).alias("ordinal", "l")).select("doc", "ordinal", "l.line", "l.place", "l.words")
    lines = held.groupBy("line").agg(F.count("*").alias("occurrences"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    return held.join(lines.filter("first != last").drop("last"), "line")


def partners(shared: DataFrame, rare: int = RARE) -> DataFrame:
    """Pairs (doc, earlier document) that a shared line points to."""
    first = shared.filter("doc != first").select("doc", F.col("first").alias("earlier"))
    few = shared.filter(F.col("occurrences") <= rare).groupBy("line").agg(F.sort_array(F.collect_set("doc")).alias("docs"))
    nearest = few.select(F.explode(F.arrays_zip(F.expr("slice(docs, 2, size(docs))").alias("doc"), F.expr("slice(docs, 1, size(docs) - 1)").alias("earlier"))).alias("p"))
    return first.unionByName(nearest.select("p.doc", "p.earlier")).distinct()


def run_partners(sequences: DataFrame, at_least: int) -> DataFrame:
    """Pairs (doc, first document) that share a shortest run of several lines with enough words."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, hashes = [], []
            for row, lines in enumerate(batch.column("sequence").to_pylist()):
                for i, until in sorted(shortest_runs(lines, at_least)):
                    if until > i + 1:  # a single line has its own first holder
                        run = np.array([x["line"] for x in lines[i:until]], np.int64)
                        rows.append(row)
                        hashes.append(xxhash.xxh3_64_intdigest(run.tobytes()) - (1 << 63))
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc").take(pa.array(rows, pa.int64())), "run": pa.array(hashes, pa.int64())})

    kind = dict(sequences.dtypes)["doc"]
    held = sequences.mapInArrow(runs, f"doc {kind}, run long")
    several = held.groupBy("run").agg(F.min("doc").alias("earlier"), F.max("doc").alias("_last")).filter("earlier != _last").drop("_last")
    return held.join(several, "run").filter("doc != earlier").select("doc", "earlier").distinct()


def kept_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that increases on both sides (pairs are sorted by the first)."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(y)
            ends.append(i)
        else:
            tails[at], ends[at] = y, i
    found, i = [], ends[-1] if ends else -1
    while i >= 0:
        found.append(pairs[i])
        i = back[i]
    return found[::-1]


def shortest_runs(lines: list[dict], at_least: int) -> set[tuple[int, int]]:
    """From each line on, and up to each line, the shortest run of lines that follow each other and hold so many words.

    Each line of a run with enough words lies in one of these that is a part of it.
    """
    found = set()
    step = [i > 0 and lines[i]["ordinal"] == lines[i - 1]["ordinal"] + 1 for i in range(len(lines))]
    until = total = 0
    for i, line in enumerate(lines):
        if until <= i:
            until, total = i, 0
        while total < at_least and until < len(lines) and (until == i or step[until]):
            total += lines[until]["words"]
            until += 1
        if total >= at_least:
            found.add((i, until))
        total -= line["words"]
    start = total = 0
    for i, line in enumerate(lines):
        if not step[i]:
            start, total = i, 0
        total += line["words"]
        while total - lines[start]["words"] >= at_least:
            total -= lines[start]["words"]
            start += 1
        if total >= at_least:
            found.add((start, i + 1))
    return found


def patience(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, by unique common values and their neighbours."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        in_x, in_y = Counter(x[a:b]), Counter(y[c:d])
        where = {y[j]: j for j in range(c, d)}
        unique = [(i, where[x[i]]) for i in range(a, b) if in_x[x[i]] == 1 and in_y.get(x[i]) == 1]
        anchors = kept_increasing(unique)
        if not anchors:
            continue
        # the parts before, between and behind the anchors; each part but the first starts with one
        for (i, j), (k, m) in zip([(a, c), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i, k, j, m))
    return sorted(matched)


def common_blocks(own: list[dict], other: list[dict], at_least: int) -> list[tuple[int, int]]:
    """Line ranges of ``own`` that stand in ``other`` with no other line between, in either text, and hold enough words.

    First the blocks that patience aligns; one order of blocks leaves out those that stand in
    another, so what is left is aligned again, at the shortest runs with enough words.
    """
    x, y = [line["line"] for line in own], [line["line"] for line in other]
    covered = [False] * len(own)

    def follows(lines: list[dict], i: int) -> bool:
        return lines[i]["ordinal"] == lines[i - 1]["ordinal"] + 1

    def accept(i: int, until: int) -> None:
        if sum(line["words"] for line in own[i:until]) >= at_least:
            covered[i:until] = [True] * (until - i)

    start, last = 0, None
    matched = patience(x, y)
    for n, (i, j) in enumerate(matched):
        if last is not None and not ((i, j) == (last[0] + 1, last[1] + 1) and follows(own, i) and follows(other, j)):
            accept(matched[start][0], last[0] + 1)
            start = n
        last = (i, j)
    if last is not None:
        accept(matched[start][0], last[0] + 1)
    runs = [(i, until) for i, until in shortest_runs(own, at_least) if not all(covered[i:until])]
    if runs:
        known = {tuple(y[j:until]) for j, until in shortest_runs(other, at_least)}
        for i, until in runs:
            if tuple(x[i:until]) in known:
                covered[i:until] = [True] * (until - i)
    blocks: list[list[int]] = []
    for i, line in enumerate(own):
        if covered[i]:
            if blocks and i and covered[i - 1] and follows(own, i):
                blocks[-1][1] = line["place"] + 1
            else:
                blocks.append([line["place"], line["place"] + 1])
    return [(a, b) for a, b in blocks]


def aligned(pairs: DataFrame, sequences: DataFrame, at_least: int) -> DataFrame:
    """Common blocks of each pair, as line ranges of the later document."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: dict[str, list] = {name: [] for name in ("no_id", "doc_id", "text_order", "start", "until", "from_id")}
            for doc, earlier, own, other in zip(*(batch.column(c).to_pylist() for c in ("doc", "earlier", "own", "other")), strict=True):
                for start, until in common_blocks(own, other, at_least):
                    for name in KEY:
                        rows[name].append(doc[name])
                    rows["start"].append(start)
                    rows["until"].append(until)
                    rows["from_id"].append(None if earlier["no_id"] else earlier["doc_id"])
            kinds = {"no_id": pa.bool_(), "start": pa.int32(), "until": pa.int32()}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in rows.items()})

    own = sequences.select("doc", F.col("sequence").alias("own"))
    other = sequences.select(F.col("doc").alias("earlier"), F.col("sequence").alias("other"))
    return pairs.join(own, "doc").join(other, "earlier").select("doc", "earlier", "own", "other").mapInArrow(align, BLOCK_SCHEMA)


def line_cuts(docs: DataFrame, rare: int = RARE, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """Per document that has some: the ranges of lines that an earlier document has, and the first such document."""
    rows = stored(line_table(docs).dropDuplicates(KEY), "lines")
    shared = stored(shared_lines(rows), "shared-lines")
    # only lines that some other document has can be aligned
    sequences = shared.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ordinal", "place", "line", "words"))).alias("sequence"))
    sequences = stored(sequences, "line-sequences")
    pairs = partners(shared, rare).unionByName(run_partners(sequences, min_block_words)).distinct()
    blocks = aligned(pairs, sequences, min_block_words).distinct()
    cuts = blocks.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "until"))).alias("blocks"), F.min("from_id").alias("first_from"))
    return cuts.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text_order", "blocks", "first_from")


def line_dedup(docs: DataFrame, rare: int = RARE, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """The documents without the lines of their blocks, which stand beside (null: none).

    Adds n_lines, n_deleted, blocks and first_from; where a document has a column of
    such a name, its own goes on as blocks_2 and so on.
    """
    cuts = line_cuts(docs, rare, min_block_words).select(
        F.col("doc_id").alias("cut_id"), F.col("text_order").alias("cut_order"), "blocks", "first_from",
    )
    mine = hidden(docs, text=F.col("text"), id=F.col("doc_id").cast("long"), text_order=F.xxhash64("text"), lines=F.split("text", "\n"))
    joined = mine.join(cuts, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("text_order") == F.col("cut_order")), "left")
    numbered = F.transform("lines", lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    left = F.filter(numbered, lambda p: ~F.exists("blocks", lambda b: (b["start"] <= p["i"]) & (p["i"] < b["until"])))
    whole = F.col("blocks").isNull()
    kept = joined.withColumn("kept", F.when(whole, F.col("lines")).otherwise(F.transform(left, lambda p: p["line"])))
    added = {
        "n_lines": F.when(F.octet_length("text") > 0, F.size("lines")).otherwise(0).cast("long"),
        "n_deleted": F.when(whole, 0).otherwise(F.size("lines") - F.size("kept")).cast("long"),
        "blocks": F.col("blocks"), "first_from": F.col("first_from"),
    }
    new_text = F.when(whole, F.col("text")).otherwise(F.array_join("kept", "\n"))
    names = {c: free_name(c, [*added, *(x for x in docs.columns if x != c)]) for c in docs.columns}
    own = [new_text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(names[c]) for c in docs.columns]
    return kept.select(*own, *[term.alias(name) for name, term in added.items()])
