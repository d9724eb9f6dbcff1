"""Suffix-array dedup: a sparse suffix array over the whole corpus.

Suffixes are retained at content-selected positions only: a position is kept if its
word gram has the least hash in some window of ``WINDOW`` grams, so every passage of
``MIN_WORDS`` words keeps at least one, the same one in each of its copies. Grams are counted
first; suffixes whose gram stands in one place only go no further (a bitmap of the repeated
grams, of at most 16 MB, tells; what it lets through too much costs rows). The others are
rows: the gram's hash, and as far as a passage through it can reach, the words to its
right and to its left (two bytes of hash each).

The rows are sorted over the whole cluster by gram, right side and left side, which is
the order of the sparse suffix array, and each is compared with the rows just before
it. A match is extended right and left, and counts if it spans ``MIN_WORDS`` words. A
passage in a third of all documents costs rows, not pairs, and its rows are spread
over as many tasks as they fill.

A gram with more rows than are all compared may hide a match that lies on its left, so
there the windows of ``MIN_WORDS`` words whose least gram it is are counted, as far as
neighbours leave them open. The row before and the row behind in this order have the longest
common right side with a row; in the order of left sides, those around it have the
longest common left side. A window that reaches further on either side stands nowhere
else. One that an earlier row near by has as well is reported with that row, which counts
it, or hands it on in turn. What is left is hashed and counted; each window that occurs
twice is a match.

A word is reported if one of its matches covers it; a document's spans are their union
(word positions, end exclusive), each with the least id among the matched documents
where that is smaller: there the passage occurred first, as far as its matches show.

Defined results: words are compared as they stand; null, empty and shorter texts have
no spans; a passage that a document repeats counts; rows without id have spans of
their own, reported under a null id and the text's hash; repeated rows give one result
row per id and text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import runs, stored, texts_of, words_of
from riskweave.llm.grouped import whole_groups, with_ends
from riskweave.llm.neighbours import pairs_back
from riskweave.llm.shingles import FACTOR, gram_hashes, mixed, word_hashes

MIN_WORDS = 50
GRAM = 11
#: Grams of which one is kept: GRAM + WINDOW - 1 = MIN_WORDS.
WINDOW = MIN_WORDS - GRAM + 1
#: Words that a match through a gram can have on either side and still need it.
SIDE = MIN_WORDS - GRAM
#: Rows before a row that it is compared with.
REACH = 4
RUN_BYTES = 1 << 20

SUFFIX_SCHEMA = "gram long, right binary, left binary, doc_id long, text_order long, place int, open long"
#: A match (start, until, other_id), or a row of a common gram (gram, sides, place, open windows).
COMPARED_SCHEMA = ("doc_id long, text_order long, start int, until int, other_id long, gram long, right binary, left binary,"
                   " place int, open long")
#: Rows of which a task compares neighbours at a time.
RUN_ROWS = 16_384
#: The bitmap of repeated grams: bits of a row, bits per gram while it can still grow, most rows (16 MB).
CELL_BITS, BITS_PER_GRAM, MOST_CELLS = 32_768, 16, 4_096
MATCH_SCHEMA = "doc_id long, text_order long, start int, until int, other_id long"
WINDOW_SCHEMA = "window long, doc_id long, text_order long, start int"


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Places (ascending) of the least value, the first of equals, in each window; one window if there are fewer values."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    width = min(width, n)
    least, span = values, 1
    while 2 * span <= width:  # least of spans of 1, 2, 4, ... values
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    count = n - width + 1
    least = np.minimum(least[:count], least[width - span : width - span + count])
    # a value is kept if it is the least of some window that holds it, and the first such there
    windows = np.lib.stride_tricks.sliding_window_view(values, width)
    changes = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    kept = []
    for a, b in zip(changes.tolist(), [*changes[1:].tolist(), count], strict=True):
        place = a + int(np.argmax(windows[a] == least[a]))
        kept.append(place)
        while place < b - 1:  # an equal value further on serves the windows behind the first
            a = place + 1
            place = a + int(np.argmax(windows[a] == least[a]))
            kept.append(place)
    return np.unique(np.array(kept, np.int64))


def own_windows(values: np.ndarray, width: int, places: np.ndarray) -> np.ndarray:
    """For each kept place a bit for each number of words before it with which a window has it as its least, first of equals."""
    width = min(width, len(values))
    windows = np.lib.stride_tricks.sliding_window_view(values, width)
    first = np.arange(len(windows)) + np.array([int(x) for part in np.array_split(windows, max(1, len(windows) // 8192)) for x in part.argmin(1)], np.int64)
    bits = np.zeros(len(values), np.uint64)
    np.bitwise_or.at(bits, first, np.uint64(1) << (first - np.arange(len(windows))).astype(np.uint64))
    return bits[places]


def sides(codes: np.ndarray, places: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Codes of the words after and (backwards) before the gram at each place; 0 past the text's ends."""
    padded = np.concatenate((np.zeros(SIDE, np.uint16), codes, np.zeros(SIDE, np.uint16)))
    right = padded[places[:, None] + (SIDE + GRAM) + np.arange(SIDE)]
    left = padded[places[:, None] + SIDE - 1 - np.arange(SIDE)]
    # big-endian, so that the order of the bytes is the order of the codes
    return [r.tobytes() for r in right.astype(">u2")], [x.tobytes() for x in left.astype(">u2")]


def retained(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, word hashes, gram hashes, kept places) of each text that is long enough."""
    words = [words_of(t) for t in texts]
    hashes = word_hashes([w for part in words for w in part])
    end = 0
    for i, part in enumerate(words):
        end += len(part)
        if len(part) >= MIN_WORDS:
            own = hashes[end - len(part) : end]
            grams = gram_hashes(own, GRAM)
            yield i, own, grams, least_in_windows(grams, WINDOW)


def repeated_grams(docs: DataFrame) -> Broadcast:
    """A bitmap with a bit set for each retained gram that occurs twice or more; its size is bounded."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                found = [g[places].view(np.int64) for _, _, g, places in retained(texts[a:b])]
                if found:
                    yield pa.RecordBatch.from_pydict({"gram": np.concatenate(found)})

    counted = docs.select("text").mapInArrow(grams, "gram long").groupBy("gram").agg(F.count("*").alias("n"))
    again = stored(counted.filter("n > 1").select("gram"), "passage-grams")
    n, cells = again.count(), 1
    while cells < MOST_CELLS and cells * CELL_BITS < BITS_PER_GRAM * n:
        cells *= 2
    place = F.pmod("gram", F.lit(cells * CELL_BITS))
    bits = again.groupBy(F.floor(place / CELL_BITS).alias("cell")).agg(F.bitmap_construct_agg(place % CELL_BITS).alias("bits"))
    bitmap = np.zeros((cells, CELL_BITS // 8), np.uint8)
    for row in bits.collect():  # at most MOST_CELLS rows
        bitmap[row["cell"]] = np.frombuffer(row["bits"], np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bitmap.ravel())


def in_bitmap(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = (grams & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def suffixes(docs: DataFrame, again: Broadcast) -> DataFrame:
    """The retained suffixes whose gram occurs again, with a bit for each window that is theirs."""

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            keys, orders = batch.column("doc_id").to_pylist(), batch.column("text_order").to_pylist()
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                rows = {name: [] for name in ("gram", "right", "left", "doc_id", "text_order", "place", "open")}
                for i, own, grams, places in retained(texts[a:b]):
                    wanted = in_bitmap(again.value, grams[places])
                    if not wanted.any():
                        continue
                    bits = own_windows(grams, WINDOW, places)[wanted]
                    places = places[wanted]
                    codes = ((own >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)  # 0 is no word
                    right, left = sides(codes, places)
                    rows["gram"].append(grams[places].view(np.int64))
                    rows["right"] += right
                    rows["left"] += left
                    rows["doc_id"] += [keys[a + i]] * len(places)
                    rows["text_order"] += [orders[a + i]] * len(places)
                    rows["place"].append(places.astype(np.int32))
                    rows["open"].append(bits.view(np.int64))
                if rows["gram"]:
                    yield pa.RecordBatch.from_pydict({
                        "gram": np.concatenate(rows["gram"]), "right": pa.array(rows["right"], pa.binary()), "left": pa.array(rows["left"], pa.binary()),
                        "doc_id": pa.array(rows["doc_id"], pa.int64()), "text_order": pa.array(rows["text_order"], pa.int64()), "place": np.concatenate(rows["place"]),
                        "open": np.concatenate(rows["open"]),
                    })

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_order")).mapInArrow(retain, SUFFIX_SCHEMA)


def code_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SIDE)


def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading words that rows of codes have in common."""
    differ = (x != y) | (x == 0)
    return np.where(differ.any(1), differ.argmax(1), SIDE)


def at_least(words: np.ndarray) -> np.ndarray:
    """Bits of the windows with so many words or more before the gram."""
    return ~((np.uint64(1) << words.astype(np.uint64)) - np.uint64(1))


def matches(table: pa.Table, own: np.ndarray, other: np.ndarray, before: np.ndarray, after: np.ndarray) -> dict[str, pa.Array]:
    """One match for each suffix of some pairs: the union of its matches and the least id."""
    place, ids = table["place"].to_numpy(), table["doc_id"]
    found = pa.table({
        "suffix": own, "start": (place[own] - before).astype(np.int32), "until": (place[own] + GRAM + after).astype(np.int32), "other_id": ids.take(pa.array(other)),
    })
    best = found.group_by("suffix").aggregate([("start", "min"), ("until", "max"), ("other_id", "min")])
    at = pa.array(best["suffix"].to_numpy())
    return {
        "doc_id": ids.take(at).combine_chunks(), "text_order": table["text_order"].take(at).combine_chunks(), "start": best["start_min"].combine_chunks(),
        "until": best["until_max"].combine_chunks(), "other_id": best["other_id_min"].combine_chunks(),
    }


def borders(starts: np.ndarray, first: bool, last: bool) -> np.ndarray:
    """Rows of grams that may go on in another task."""
    edge = np.zeros(int(starts[-1]), bool)
    if first:
        edge[: starts[1]] = True
    if last:
        edge[starts[-2] :] = True
    return edge


def compared(rows: DataFrame, reach: int) -> DataFrame:
    """Matches of neighbours by right side, and the rows of common grams with the windows that are still open."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_order", pa.int64()), ("start", pa.int32()), ("until", pa.int32()), ("other_id", pa.int64()),
                        ("gram", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("place", pa.int32()), ("open", pa.int64())])

    def batch_of(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, first, last in with_ends(whole_groups(batches, ["gram"], RUN_ROWS)):
            n = table.num_rows
            gram = table["gram"].to_numpy()
            covered, longest = np.zeros(n, np.uint64), np.zeros(n, np.int64)
            for a in range(0, n, RUN_ROWS):
                low, high = max(0, a - reach), min(n, a + RUN_ROWS)
                early, late = (x + low for x in pairs_back(gram[low:high], reach, reach))
                new = late >= a
                early, late = early[new], late[new]
                part = table.slice(low, high - low)
                right, left = code_rows(part["right"]), code_rows(part["left"])
                after, before = shared(right[early - low], right[late - low]), shared(left[early - low], left[late - low])
                next_to = late - early == 1
                for side in (early[next_to], late[next_to]):
                    np.maximum.at(longest, side, after[next_to])
                long = after + before + GRAM >= MIN_WORDS
                early, late, after, before = early[long], late[long], after[long], before[long]
                if len(late):
                    np.bitwise_or.at(covered, late, at_least(SIDE - after) & ~at_least(before + 1))
                    found = matches(table, np.concatenate((early, late)), np.concatenate((late, early)), np.tile(before, 2), np.tile(after, 2))
                    yield batch_of(found, len(found["start"]))
            edge = borders(starts, first, last)
            longest[edge] = SIDE
            sizes = np.diff(starts)
            common = np.flatnonzero(edge | np.repeat(sizes > reach + 1, sizes))
            if len(common):
                free = table["open"].to_numpy().view(np.uint64)[common] & ~covered[common] & at_least(SIDE - longest[common])
                picked = table.take(pa.array(common)).combine_chunks()
                needed = pa.array(free != 0)
                columns = {c: picked[c].combine_chunks() for c in ("doc_id", "text_order", "gram", "left", "place")}
                columns |= {"open": pa.array(free.view(np.int64)), "right": pc.if_else(needed, picked["right"].combine_chunks(), pa.scalar(None, pa.binary()))}
                yield batch_of(columns, len(common))

    order = ["gram", "right", "left", "doc_id", "text_order", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, COMPARED_SCHEMA)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the first 0, 1, ... SIDE codes of each row."""
    out = np.zeros((len(codes), SIDE + 1), np.uint64)
    for k in range(SIDE):
        out[:, k + 1] = out[:, k] * np.uint64(FACTOR) + codes[:, k].astype(np.uint64)
    return mixed(out)


def open_windows(rows: DataFrame) -> DataFrame:
    """Hash and place of each open window that reaches no further left than a neighbour by left side does."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.arange(SIDE + 1)
        for table, starts, first, last in with_ends(whole_groups(batches, ["gram"], RUN_ROWS)):
            longest = np.zeros(table.num_rows, np.int64)
            for a in range(0, table.num_rows, RUN_ROWS):
                low = max(0, a - 1)
                part = table.slice(low, a + RUN_ROWS - low)
                left, gram = code_rows(part["left"]), part["gram"].to_numpy()
                same = np.where(gram[1:] == gram[:-1], shared(left[1:], left[:-1]), 0)
                np.maximum.at(longest, low + np.arange(1, len(gram)), same)
                np.maximum.at(longest, low + np.arange(len(gram) - 1), same)
            longest[borders(starts, first, last)] = SIDE
            free = table["open"].to_numpy().view(np.uint64) & ~at_least(longest + 1)
            wanted = np.flatnonzero(free)
            for a in range(0, len(wanted), 2048):
                batch, bits = table.take(pa.array(wanted[a : a + 2048])).combine_chunks(), free[wanted[a : a + 2048]]
                right, left = code_rows(batch["right"]), code_rows(batch["left"])
                gram = batch["gram"].to_numpy().view(np.uint64)[:, None] + before.astype(np.uint64)
                hashes = mixed((prefix_hashes(left) * np.uint64(FACTOR) + prefix_hashes(right)[:, SIDE - before]) * np.uint64(FACTOR) + gram)
                n_left, n_right = (left != 0).sum(1)[:, None], (right != 0).sum(1)[:, None]
                is_open = (bits[:, None] >> before.astype(np.uint64)) & np.uint64(1) == 1
                row, words = np.nonzero((before <= n_left) & (SIDE - before <= n_right) & is_open)
                place = batch["place"].to_numpy()[row] - words
                yield pa.RecordBatch.from_pydict({
                    "window": hashes[row, words].view(np.int64), "doc_id": batch["doc_id"].combine_chunks().take(pa.array(row)),
                    "text_order": batch["text_order"].combine_chunks().take(pa.array(row)), "start": place.astype(np.int32),
                })

    order = ["gram", "left", "doc_id", "text_order", "place"]
    rows = rows.select("gram", "left", "right", "doc_id", "text_order", "place", "open")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, WINDOW_SCHEMA)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """Matches of the open windows of common grams."""
    held = stored(open_windows(rows), "passage-windows")
    twice = held.groupBy("window").agg(F.count("*").alias("n"), F.min("doc_id").alias("other_id")).filter("n > 1").drop("n")
    until = (F.col("start") + MIN_WORDS).alias("until")
    return held.join(twice, "window").select("doc_id", "text_order", "start", until, "other_id")


def repeated_passages(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per document and span of repeated words: start, end, and the least document that shares some of it."""
    rows = stored(suffixes(docs, repeated_grams(docs)), "passage-suffixes")
    found = stored(compared(rows, reach), "passage-compared")
    matches = found.filter("start IS NOT NULL").select("doc_id", "text_order", "start", "until", "other_id")
    matches = matches.unionByName(repeated_windows(found.filter("start IS NULL")))
    # a document's matches are at most as many as its words
    before = Window.partitionBy("doc_id", "text_order").orderBy("start", "until").rowsBetween(Window.unboundedPreceding, -1)
    until_here = Window.partitionBy("doc_id", "text_order").orderBy("start", "until").rowsBetween(Window.unboundedPreceding, 0)
    matches = matches.distinct().withColumn("apart", F.col("start") > F.coalesce(F.max("until").over(before), F.lit(-1)))
    spans = matches.withColumn("span", F.sum(F.col("apart").cast("int")).over(until_here)).groupBy("doc_id", "text_order", "span").agg(
        F.min("start").alias("start"), F.max("until").alias("until"), F.min("other_id").alias("other_id"),
    )
    earlier = F.when(F.col("other_id") < F.col("doc_id"), F.col("other_id"))
    return spans.select("doc_id", "text_order", "start", "until", earlier.alias("earlier_id"))
