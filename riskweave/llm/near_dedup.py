"""MinHash near-dedup with odd sketches.

1. Every text becomes a set of distinct word shingles; texts with equal sets are one
   *node*, so copies of any number cost one row from there on.
2. A node has ``BANDS * BAND_ROWS`` MinHash samples. Bands of them are the keys under
   which similar nodes meet: a pair at similarity 0.75 misses all of them with
   probability (1 - 0.75^4)^28 = 2e-5.
3. The samples are also folded into an odd sketch, a bitmap of parities. The ones in the
   XOR of two sketches estimate the number of differing samples, and so the similarity,
   with a standard error of about 0.06; pairs more than five errors below 0.75 are dropped.
4. Rows are sorted by band key over the whole cluster and compared with rows before
   them: all pairs of up to ``REACH + 1`` rows, and the ``NEAR`` rows before each further
   one, so a band that thousands share costs rows, not pairs.
5. Links are confirmed on the full shingle sets: first each node's best candidate, then
   all candidates whose ends are still in different components. Candidates inside a
   component can't change it.
6. Larger bands that still hold several components are compared whole, in blocks of
   ``BLOCK_ROWS`` rows a side, but for pairs inside a component. A pair goes on unless
   parity bitmaps of the full sets differ in more places than sets at 0.75 can, which
   loses no link. Again each node's best candidate is confirmed first, then what is left.
7. Components come from star steps; a document's component is the least id in it.

Only the texts of candidates and of nodes in such bands are read a second time, and only
numbers are shuffled otherwise.

Defined results: a null text, an empty one and one of white space only have no shingles
and are linked with nothing; a row without id takes part, gives no id to its component
and is kept only if no row of the component has an id; repeated rows form one node;
an empty table gives no rows. ``near_duplicates`` ignores other columns; ``without_near_duplicates``
returns the rows as they are, whatever their columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import hidden, runs, stored, texts_of
from riskweave.llm.components import components
from riskweave.llm.neighbours import compare_neighbours
from riskweave.llm.shingles import FACTOR, mixed, shingle_set, word_hashes

SHINGLE_WORDS = 5
MIN_PERCENT = 75
BANDS, BAND_ROWS = 28, 4
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 256
#: Ones in the XOR of two sketches at similarity 0.75 - 5 * 0.06, from the expected parity count.
MAX_ODD_BITS = int(SKETCH_BITS / 2 * (1 - np.exp(-2 * (2 * SAMPLES * 0.55) / SKETCH_BITS)))
#: A band key's first REACH + 1 rows are all compared with each other, later ones with the NEAR rows before them.
REACH, NEAR = 12, 4
#: Rows on either side of a block in which a larger band is compared.
BLOCK_ROWS = 512
#: Bits of a set's parity bitmap for each shingle, at least.
BITS_PER_SHINGLE = 4
RUN_BYTES = 1 << 20

SKETCH_WORDS = [f"sketch{i}" for i in range(SKETCH_BITS // 64)]
PROFILE_SCHEMA = "doc_id long, text_order long, n_shingles long, node long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH_WORDS)


def sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    words = [t.lower().split() for t in texts]  # bytes.lower() changes A-Z only
    hashes = word_hashes([w for part in words for w in part])
    ends = np.cumsum([len(w) for w in words])
    return [shingle_set(hashes[e - len(w) : e], width) for w, e in zip(words, ends, strict=True)]


def samples_of(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row per sample and a column per (non-empty) set."""
    low = np.concatenate(sets).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    seeds = mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(FACTOR)).astype(np.uint32)
    samples = np.empty((SAMPLES, len(sets)), np.uint32)
    work = np.empty_like(low)
    for i in range(SAMPLES):
        np.bitwise_xor(low, seeds[2 * i], out=work)
        np.multiply(work, seeds[2 * i + 1] | np.uint32(1), out=work)
        samples[i] = np.minimum.reduceat(work, starts)
    return samples


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key per band (column) and set (row)."""
    total = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], samples.shape[1], 1)
    for row in range(BAND_ROWS):
        total = total * np.uint64(FACTOR) + samples[row::BAND_ROWS].astype(np.uint64)
    return mixed(total).T.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words."""
    bits = np.zeros((samples.shape[1], SKETCH_BITS), np.uint8)
    every = np.arange(samples.shape[1])
    for i, values in enumerate(samples):
        place = mixed(values.astype(np.uint64) * np.uint64(SAMPLES) + np.uint64(i)) % np.uint64(SKETCH_BITS)
        bits[every, place.astype(np.int64)] ^= 1
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)


def profiles(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """Set size, node, band keys and odd sketch of each document."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                sets = sets_of(texts[a:b], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands = np.zeros((b - a, BANDS), np.int64)
                sketches = np.zeros((b - a, len(SKETCH_WORDS)), np.int64)
                if full:
                    samples = samples_of([sets[i] for i in full])
                    bands[full], sketches[full] = band_keys(samples), odd_sketches(samples)
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                offsets = np.arange(0, (b - a) * BANDS + 1, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[a:b].cast(pa.int64()), "text_order": batch.column("text_order")[a:b],
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(nodes),
                    "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel())),
                } | {name: pa.array(sketches[:, i].copy()) for i, name in enumerate(SKETCH_WORDS)})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_order")).mapInArrow(profile, PROFILE_SCHEMA)


def near(table: pa.Table, early: np.ndarray, late: np.ndarray) -> pa.Table:
    """Pairs of different nodes whose sketches differ in few bits."""
    odd = np.zeros(len(early), np.int64)
    for name in SKETCH_WORDS:
        bits = table[name].to_numpy().view(np.uint64)
        odd += np.bitwise_count(bits[early] ^ bits[late])
    nodes = table["node"].to_numpy()
    a, b = nodes[early], nodes[late]
    close = (odd <= MAX_ODD_BITS) & (a != b)
    a, b, odd = a[close], b[close], odd[close]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "odd_bits": odd})


def candidates(nodes: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs of nodes that meet under a band key and have similar sketches."""
    rows = nodes.select("node", *SKETCH_WORDS, F.posexplode("bands").alias("band", "key"), "bands")
    rows = rows.withColumn("next_key", F.element_at("bands", (F.col("band") + 1) % BANDS + 1))
    found = compare_neighbours(
        rows.select("key", "next_key", "node", *SKETCH_WORDS), ["key", "next_key", "node"], reach, near,
        "a long, b long, odd_bits long", "near-pairs", min(NEAR, reach),
    )
    return found.groupBy("a", "b").agg(F.min("odd_bits").alias("odd_bits"))


def node_sets(docs: DataFrame, wanted: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """Shingle sets of the wanted nodes, each from the text of one document."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                yield pa.RecordBatch.from_pydict({
                    "node": batch.column("node")[a:b],
                    "shingles": pa.array([s.tobytes() for s in sets_of(texts[a:b], width)], pa.binary()),
                })

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_order"))
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_order"] == wanted["text_order"])
    return texts.join(wanted, same).select("node", "text").mapInArrow(sets, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * common >= min_percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(confirm, "a long, b long")


def best_per_node(pairs: DataFrame) -> DataFrame:
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "odd_bits"))
    best = ends.groupBy("a").agg(F.min(F.struct("odd_bits", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    root_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    root_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    joined = pairs.join(root_a, "a", "left").join(root_b, "b", "left")
    return joined.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles per place, in a power of two of 64-bit words; the halves' XOR is the bitmap of half the size."""
    words = 1 << max(0, (BITS_PER_SHINGLE * len(shingles) - 1) // 64).bit_length()
    places, counts = np.unique(shingles & np.uint64(64 * words - 1), return_counts=True)
    bits = np.zeros(64 * words, np.uint8)
    bits[places.astype(np.int64)] = counts & 1
    return np.packbits(bits).view(np.uint64)


def bitmaps(sets: DataFrame) -> DataFrame:
    """Size and parity bitmap of each set."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "node": batch.column("node"), "size": pa.array([len(x) for x in shingles], pa.int64()),
                "bits": pa.array([parity_bitmap(x).tobytes() for x in shingles], pa.binary()),
            })

    return sets.mapInArrow(bits, "node long, size long, bits binary")


def crowded(rows: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """Rows (key, node) of the bands that hold more nodes than ``most`` and several components, with both."""
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = rows.groupBy("key").agg(F.count("*").alias("held"), F.min("root").alias("_a"), F.max("root").alias("_b"))
    return rows.join(keys.filter((F.col("held") > most) & (F.col("_a") != F.col("_b"))).drop("_a", "_b"), "key")


def met_in_blocks(rows: DataFrame, marks: DataFrame, min_percent: int, best_only: bool) -> DataFrame:
    """Pairs of a band's nodes in different components whose bitmaps allow a link; with ``best_only`` each node's best per block."""

    def meet(table: pa.Table) -> pa.Table:
        node, root, size, part = (table[c].to_numpy() for c in ("node", "root", "size", "part"))
        across = table["i"][0].as_py() != table["j"][0].as_py()
        bits = [np.frombuffer(x, np.uint64) for x in table["bits"].to_pylist()]
        widths = np.array([len(x) for x in bits])
        found = [[np.zeros(0, np.int64)] * 3]
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            low = np.stack([bits[i] for i in own])
            for wide in np.unique(widths[widths >= width]):
                other = np.flatnonzero(widths == wide)
                high = np.bitwise_xor.reduce(np.stack([bits[i] for i in other]).reshape(len(other), wide // width, width), axis=1)
                for at, i in enumerate(own.tolist()):
                    open_ = (root[other] != root[i]) & ((wide > width) | (other > i))
                    open_ &= 100 * np.minimum(size[other], size[i]) >= min_percent * np.maximum(size[other], size[i])
                    if across:
                        open_ &= part[other] != part[i]
                    js = other[open_]
                    differ = np.bitwise_count(high[open_] ^ low[at]).sum(1, dtype=np.int64)
                    # sets of similarity p differ in at most (1 - p) / (1 + p) of their sizes' sum
                    close = (100 + min_percent) * differ <= (100 - min_percent) * (size[js] + size[i])
                    found.append([np.full(int(close.sum()), i), js[close], differ[close]])
        a, b, odd = (np.concatenate(x) for x in zip(*found, strict=True))
        if best_only and len(a):
            share = odd / (size[a] + size[b])
            ends, pair = np.concatenate((a, b)), np.tile(np.arange(len(a)), 2)
            order = np.lexsort((pair, np.tile(share, 2), ends))
            best = np.unique(pair[order[np.unique(ends[order], return_index=True)[1]]])
            a, b = a[best], b[best]
        return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    parts = F.ceil(F.col("held") / BLOCK_ROWS).cast("int")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key", "node"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")}).join(marks, "node")
    dealt = dealt.select("key", "i", "j", "part", "node", "root", "size", "bits")
    return dealt.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, min_percent: int = MIN_PERCENT, reach: int = REACH) -> DataFrame:
    """Component of each document under links of near-equal shingle sets."""
    rows = stored(profiles(docs, width), "near-profiles")
    filled = rows.filter("n_shingles > 0")
    nodes = filled.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_no_id"), "doc_id", "text_order")).alias("_first"), F.first("bands").alias("bands"),
        *(F.first(s).alias(s) for s in SKETCH_WORDS),
    )
    nodes = stored(nodes.select("node", "_first.doc_id", "_first.text_order", "bands", *SKETCH_WORDS), "near-nodes")
    pairs = stored(candidates(nodes, reach), "near-candidates")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(node_sets(docs, nodes.select("node", "doc_id", "text_order").join(ends, "node"), width), "near-sets")
    tried = stored(best_per_node(pairs), "near-best")
    first = components(confirmed(tried, sets, min_percent), "near-stars")
    rest = apart(pairs.join(tried, ["a", "b"], "left_anti"), first)
    links = confirmed(rest, sets, min_percent).unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(links, "near-stars")
    wide = stored(crowded(nodes.select("node", F.explode("bands").alias("key")), roots, reach + 1), "near-crowded")
    # few corpora have such bands
    if not wide.isEmpty():
        ends = wide.select("node").distinct()
        sets = stored(node_sets(docs, nodes.select("node", "doc_id", "text_order").join(ends, "node"), width), "near-sets")
        marks = stored(bitmaps(sets), "near-bitmaps")
        for best_only in (True, False):
            met = stored(met_in_blocks(crowded(wide.select("node", "key"), roots, reach + 1), marks, min_percent, best_only), "near-met")
            joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = components(confirmed(met, sets, min_percent).unionByName(joined), "near-stars")
    rooted = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = rooted.join(least, "root").select("node", "root", "component_id")
    columns = ["doc_id", "text_order", "n_shingles", "root", "component_id"]
    full = filled.select("doc_id", "text_order", "n_shingles", "node").join(found, "node").select(*columns)
    empty = rows.filter("n_shingles = 0").withColumn("root", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id")).select(*columns)
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """One document of each component, and all documents without words.

    The one that stays has the component's least id; of rows that share that id and
    the component, the one with the least text hash; of equal rows, any.
    """
    found = near_duplicates(docs, **options).withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    first = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("no_id", "id", "text_order")).alias("first"))
    keep = first.select("first.*", F.lit(False).alias("empty"))
    no_words = found.filter("root IS NULL").select("no_id", "id", "text_order", F.lit(True).alias("empty")).distinct()
    key = ["no_id", "id", "text_order"]
    keyed = hidden(docs, no_id=F.col("doc_id").isNull(), id=F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), text_order=F.xxhash64("text"))
    # repeated rows of a document without words all stay
    joined = keyed.join(keep.unionByName(no_words), key).withColumn("copy", F.when(F.col("empty"), F.monotonically_increasing_id()))
    return joined.dropDuplicates([*key, "copy"]).select("row.*")
