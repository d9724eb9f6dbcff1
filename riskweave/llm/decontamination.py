"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into overlapping passages of ``2 * HALF`` words
and weighed by TF-IDF over the benchmark's words; other words only count towards a
passage's length. A passage goes on if it holds ``MIN_SHARE_PERCENT`` of the TF-IDF energy
of some item passage; words in more than ``FREQUENT_PERCENT`` of all passages tell
nothing and have no part in this, unless an item has few others.

What is left, together with the items' passages, is the matrix of a randomised SVD:
tasks multiply their rows with a thin random matrix and sum the products per term; the
driver only orthonormalises matrices of (terms of a block of items) x (rank), a size
fixed by ``BLOCK_BYTES``. Item rows weigh as much as all document rows, and the rank
exceeds their number, so that no item falls out of the latent space. Passages near an
item in that space are checked word by word: the longest common subsequence with the
item must hold ``LEAK_PERCENT`` of the item's words, or ``PARAPHRASE_PERCENT`` of them and
the item's answer (its last ``ANSWER_WORDS`` words) in one piece.

Retrieval alone would miss items whose words are spread thin or frequent. A match has at
least as many words in common as it has in order, so every pair of a passage and an item
with enough words in common is checked in the same way, near or not (``possible_pairs``).

The benchmark is handled in blocks of bounded size, each against all documents.

Defined results: words are compared without ASCII case and punctuation; items of under
``MIN_ITEM_WORDS`` words, null ones included, identify no document; a null or empty text
has no passages and no leaks; items of equal id or text are reported each; rows with
null ids are reported with a null id; repeated rows give one result row; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import hidden, runs, stored, texts_of

HALF = 24
#: Part of an item passage's energy that a passage must hold to be looked at.
MIN_SHARE_PERCENT = 25
FREQUENT_PERCENT = 2
#: Rarest words of an item that are looked for in any case.
RAREST = 4
MIN_COSINE = 0.3
MIN_ITEM_WORDS = 8
LEAK_PERCENT, PARAPHRASE_PERCENT = 80, 55
ANSWER_WORDS = 5
#: Directions of the latent space besides one for each passage of an item.
SPARE_RANK = 32
#: Bytes of benchmark text that are searched for at a time.
BLOCK_BYTES = 128 * 1024
RUN_BYTES = 1 << 20
TERM_BLOCK = 256
SEED = 20_240_101

PUNCTUATION = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
BLANKED = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))

PASSAGE_SCHEMA = ("doc_id long, text_order long, start long, terms array<int>, counts array<int>, length double, region binary,"
                  " likely boolean, items array<int>")
LEAK_SCHEMA = "doc_id long, text_order long, item_id long, start long, lcs_words long, item_words long, cosine double, has_answer boolean"


def plain_words(text: bytes) -> list[bytes]:
    return text.lower().translate(BLANKED).split()


class Block:
    """Some benchmark items: their words as term numbers, and the passages of each."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.terms: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        for item_id, text in items:
            words = plain_words(text.encode())
            if len(words) >= MIN_ITEM_WORDS:
                self.ids.append(item_id)
                self.words.append(np.array([self.terms.setdefault(w, len(self.terms)) for w in words], np.int32))
        self.longest = max(map(len, self.words), default=0)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """Term numbers; -1 for words of no item."""
        get = self.terms.get
        return np.array([get(w, -1) for w in words], np.int32)

    def passages(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF rows (unit length) of the items' passages, and the item of each."""
        rows, owner = [], []
        for i, words in enumerate(self.words):
            for start in range(0, max(1, len(words) - HALF), HALF):
                row = np.bincount(words[start : start + 2 * HALF], minlength=len(self.terms)) * idf
                rows.append(row / max(np.linalg.norm(row), 1e-12))
                owner.append(i)
        return np.array(rows), np.array(owner)


def cut(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of these sizes: first passage of each, and the one or two passages of each word (-1: none)."""
    halves = -(-sizes // HALF)
    counts = np.where(sizes > 0, np.maximum(halves - 1, 1), 0)
    first = np.cumsum(counts) - counts
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    half = (np.arange(int(sizes.sum())) - starts[text]) // HALF
    here = np.where(half < counts[text], first[text] + half, -1)
    before = np.where(half > 0, first[text] + half - 1, -1)
    return np.append(first, counts.sum()), here, before


def term_counts(terms: np.ndarray, here: np.ndarray, before: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of the benchmark's words, by passage."""
    keys = [p[(p >= 0) & (terms >= 0)].astype(np.int64) * n_terms + terms[(p >= 0) & (terms >= 0)] for p in (here, before)]
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return found // n_terms, found % n_terms, counts


def parsed(batch: pa.RecordBatch, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of a batch: number of the first one, words per text, terms of all words."""
    texts = texts_of(batch)
    for a, b in runs([len(t) for t in texts], RUN_BYTES):
        words = [plain_words(t) for t in texts[a:b]]
        yield a, np.array([len(w) for w in words], np.int64), block.numbered([w for part in words for w in part])


def inverse_frequencies(docs: DataFrame, block: Block) -> tuple[np.ndarray, float]:
    """IDF of the block's terms over all passages, and the weight of any other word (their mean)."""
    n_terms = len(block.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for _, sizes, terms in parsed(batch, block):
                first, here, before = cut(sizes)
                _, term, _ = term_counts(terms, here, before, n_terms)
                totals[:n_terms] += np.bincount(term, minlength=n_terms)
                totals[n_terms] += first[-1]
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "passages": pa.array(totals[at])})

    rows = docs.select("text").mapInArrow(count, "term int, passages long").groupBy("term").agg(F.sum("passages").alias("n")).collect()
    totals = np.zeros(n_terms + 1)
    for r in rows:
        totals[r["term"]] = r["n"]
    idf = np.log((totals[n_terms] + 1) / (totals[:n_terms] + 1)) + 0.1
    return idf, float(idf.mean())


def energy_shares(block: Block, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each term (slice starts), the item passages that it tells of, its share in their energy, and their number."""
    cut_off = np.log(100 / FREQUENT_PERCENT)
    found, passages = [], 0
    for words in block.words:
        for start in range(0, max(1, len(words) - HALF), HALF):
            terms = np.unique(words[start : start + 2 * HALF])
            rare = terms[idf[terms] >= cut_off]
            if len(rare) < RAREST:
                rare = terms[np.argsort(-idf[terms], kind="stable")[:RAREST]]
            energy = idf[rare] ** 2
            found += zip(rare.tolist(), [passages] * len(rare), (energy / energy.sum()).tolist(), strict=True)
            passages += 1
    found.sort()
    term, owner, share = (np.array(x) for x in zip(*found, strict=True))
    return np.searchsorted(term, np.arange(len(block.terms) + 1)), owner, share, passages


def likely(passage: np.ndarray, term: np.ndarray, shares: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Passages that hold enough of some item passage's energy, given their distinct terms."""
    starts, owner, share, n_items = shares
    counts = starts[term + 1] - starts[term]
    at = np.repeat(starts[term] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    pair, place = np.unique(np.repeat(passage, counts) * n_items + owner[at], return_inverse=True)
    held = np.bincount(place, share[at], minlength=len(pair))
    return np.unique(pair[100 * held >= MIN_SHARE_PERCENT] // n_items)


def in_order_at_least(percent: int, size: int) -> int:
    """Words in order that hold this part of an item of so many words."""
    return -(-percent * size // 100)


def hashed(words: np.ndarray) -> np.ndarray:
    """A number for each run of ``ANSWER_WORDS`` words."""
    n = max(0, len(words) - ANSWER_WORDS + 1)
    total = np.zeros(n, np.uint64)
    for i in range(ANSWER_WORDS):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n].astype(np.uint64)
    return total


class WordBounds:
    """What a text must hold of each item's words for a match to be possible.

    A match of ``LEAK_PERCENT`` leaves out so few words that some of the item's rarest half
    are bound to be there; the other kind of match holds the answer.
    """

    def __init__(self, block: Block, idf: np.ndarray):
        self.words = [np.unique(words, return_counts=True) for words in block.words]
        self.sizes = np.array([len(words) for words in block.words])
        rare, self.needed = [], np.zeros(len(block.words))
        for i, (terms, counts) in enumerate(self.words):
            order = np.argsort(-idf[terms], kind="stable")
            order = order[: np.searchsorted(np.cumsum(counts[order]), (self.sizes[i] + 1) // 2) + 1]
            rare += zip(terms[order].tolist(), [i] * len(order), counts[order].tolist(), strict=True)
            left_out = self.sizes[i] - in_order_at_least(LEAK_PERCENT, int(self.sizes[i]))
            self.needed[i] = counts[order].sum() - left_out
        term, self.item, self.weight = (np.array(x, np.int64) for x in zip(*sorted(rare), strict=True))
        self.starts = np.searchsorted(term, np.arange(len(block.terms) + 1))
        answers = np.array([hashed(words[-ANSWER_WORDS:])[0] for words in block.words])
        self.answer_item = np.argsort(answers, kind="stable")
        self.answers = answers[self.answer_item]

    def by_rare_words(self, sizes: np.ndarray, text: np.ndarray, place: np.ndarray, terms: np.ndarray, span: int) -> np.ndarray:
        """(text * items + item): two neighbouring stretches of ``span`` words hold enough of the item's rarest words."""
        n_items, n_terms = len(self.words), len(self.starts) - 1
        first = np.cumsum(sizes // span + 2) - (sizes // span + 2)  # an empty stretch ends each text
        known = np.flatnonzero(terms >= 0)
        counts = self.starts[terms[known] + 1] - self.starts[terms[known]]
        posting = np.repeat(self.starts[terms[known]] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        word = np.repeat(known, counts)
        cells = (first[text[word]] + place[word] // span) * n_items + self.item[posting]
        _, once = np.unique(cells * n_terms + terms[word], return_index=True)
        cell, at = np.unique(cells[once], return_inverse=True)
        held = np.append(np.bincount(at, self.weight[posting[once]], minlength=len(cell)), 0)
        after = np.searchsorted(cell, cell + n_items)
        follows = np.append(cell, -1)[after] == cell + n_items
        cell = cell[held[:-1] + np.where(follows, held[after], 0) >= self.needed[cell % n_items]]
        return (np.searchsorted(first, cell // n_items, "right") - 1) * n_items + cell % n_items

    def by_answer(self, text: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text * items + item) with the answer in one piece, and the word where it begins."""
        found = hashed(terms)
        lo, hi = np.searchsorted(self.answers, found), np.searchsorted(self.answers, found, "right")
        hi = np.where(text[: len(found)] == text[len(text) - len(found) :], hi, lo)  # inside one text
        word = np.repeat(np.arange(len(found)), hi - lo)
        posting = np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange(len(word))
        return text[word] * len(self.words) + self.answer_item[posting], word

    def possible_pairs(self, sizes: np.ndarray, terms: np.ndarray, first: np.ndarray, around: int) -> dict[int, list[int]]:
        """The items of each passage whose region has enough words in common with them for a match."""
        n_items = len(self.words)
        starts = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(sizes)), sizes)
        answered, word = self.by_answer(text, terms)
        pairs = np.union1d(self.by_rare_words(sizes, text, np.arange(len(terms)) - starts[text], terms, 2 * (HALF + around)), answered)
        found: dict[int, list[int]] = {}
        for pair in pairs.tolist():
            d, i = divmod(pair, n_items)
            words = terms[starts[d] : starts[d] + sizes[d]]
            begin = np.arange(int(first[d + 1] - first[d])) * HALF
            from_, to = np.maximum(begin - around, 0), np.minimum(begin + 2 * HALF + around, sizes[d])
            common = np.zeros(len(begin), np.int64)
            own = np.flatnonzero(np.isin(words, self.words[i][0]))
            for term, count in zip(*self.words[i], strict=True):
                at = own[words[own] == term]
                common += np.minimum(np.searchsorted(at, to) - np.searchsorted(at, from_), count)
            at = word[answered == pair] - starts[d]
            has_answer = np.searchsorted(at, to - ANSWER_WORDS, "right") > np.searchsorted(at, from_)
            size = int(self.sizes[i])
            enough = (common >= in_order_at_least(LEAK_PERCENT, size)) | (has_answer & (common >= in_order_at_least(PARAPHRASE_PERCENT, size)))
            for p in (first[d] + np.flatnonzero(enough)).tolist():
                found.setdefault(p, []).append(i)
        return found


def likely_passages(docs: DataFrame, block: Block, idf: np.ndarray, other: float) -> DataFrame:
    """Passages with enough of the benchmark's words or with items that they may match, each with the words around it."""
    n_terms, around = len(block.terms), block.longest + block.longest // 4
    shares, bounds = energy_shares(block, idf), WordBounds(block, idf)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, orders = batch.column("doc_id").to_pylist(), batch.column("text_order").to_pylist()
            for a, sizes, terms in parsed(batch, block):
                first, here, before = cut(sizes)
                passage, term, count = term_counts(terms, here, before, n_terms)
                near, possible = likely(passage, term, shares), bounds.possible_pairs(sizes, terms, first, around)
                chosen = np.union1d(near, np.fromiter(possible, np.int64, len(possible)))
                inside = np.bincount(passage, (count * idf[term]) ** 2, minlength=first[-1])
                outside = sum(np.bincount(p[(p >= 0) & (terms < 0)], minlength=first[-1]) for p in (here, before)) * other**2
                ends = np.cumsum(sizes)
                from_, to = np.searchsorted(passage, chosen), np.searchsorted(passage, chosen, "right")
                owner = np.searchsorted(first, chosen, "right") - 1
                names = ("doc_id", "text_order", "start", "terms", "counts", "length", "region", "likely", "items")
                rows: dict[str, list] = {name: [] for name in names}
                retrieved = np.isin(chosen, near)
                for p, lo, hi, d, is_near in zip(chosen.tolist(), from_.tolist(), to.tolist(), owner.tolist(), retrieved.tolist(), strict=True):
                    start, begin = int(p - first[d]) * HALF, int(ends[d] - sizes[d])
                    region = terms[begin + max(0, start - around) : min(int(ends[d]), begin + start + 2 * HALF + around)]
                    rows["doc_id"].append(keys[a + d])
                    rows["text_order"].append(orders[a + d])
                    rows["start"].append(start)
                    rows["terms"].append(term[lo:hi].astype(np.int32))
                    rows["counts"].append(count[lo:hi].astype(np.int32))
                    rows["length"].append(float(np.sqrt(inside[p] + outside[p])))
                    rows["region"].append(region.tobytes())
                    rows["likely"].append(is_near)
                    rows["items"].append(possible.get(p, []))
                if rows["start"]:
                    kinds = {"terms": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "length": pa.float64(), "region": pa.binary(),
                             "likely": pa.bool_(), "items": pa.list_(pa.int32())}
                    yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in rows.items()})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_order")).mapInArrow(find, PASSAGE_SCHEMA)


def projected(batch: pa.RecordBatch, idf: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows times a matrix; and the rows themselves as (row, term, value)."""
    lists = batch.column("terms")
    sizes = np.diff(lists.offsets.to_numpy())
    term = lists.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), sizes)
    value = batch.column("counts").flatten().to_numpy() * idf[term] / batch.column("length").to_numpy()[row]
    out = np.zeros((batch.num_rows, matrix.shape[1]))
    if len(term):
        filled = sizes > 0  # the region of a passage may hold an item of which the passage itself has no word
        starts = (np.cumsum(sizes) - sizes)[filled]
        out[filled] = np.add.reduceat(matrix[term] * value[:, None], starts)
    return out, row, term, value


def gram_product(passages: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A^T A M over all document passages: partial sums per task, summed per block of terms in two steps."""
    n_terms, rank = matrix.shape
    sent = passages.sparkSession.sparkContext.broadcast((idf, matrix))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, matrix = sent.value
        total = np.zeros((n_terms, rank))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out, row, term, value = projected(batch, idf, matrix)
                order = np.argsort(term, kind="stable")
                distinct, starts = np.unique(term[order], return_index=True)
                if len(distinct):
                    total[distinct] += np.add.reduceat(out[row[order]] * value[order][:, None], starts)
        for block in range(0, n_terms, TERM_BLOCK):
            part = total[block : block + TERM_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "total": pa.array([part.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table["total"].to_pylist())
        return pa.table({"block": table["block"][:1].cast(pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, total binary"
    parts = passages.select("terms", "counts", "length").mapInArrow(multiply, schema).withColumn("salt", F.spark_partition_id() % 32)
    sums = parts.groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    product = np.zeros((n_terms, rank))
    for r in sums.collect():
        product[r["block"] : r["block"] + TERM_BLOCK] = np.frombuffer(r["total"]).reshape(-1, rank)
    sent.unpersist()
    return product


def latent_space(passages: DataFrame, block: Block, idf: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Right singular vectors of document and item passages, by a randomised range finder."""
    weight = max(1, passages.count()) / len(items)
    rank = min(len(block.terms), len(items) + SPARE_RANK)
    basis = np.random.default_rng(SEED).standard_normal((len(block.terms), rank))
    for _ in range(2):
        basis, _ = np.linalg.qr(basis)
        image = gram_product(passages, idf, basis) + weight * items.T @ (items @ basis)
        small, start = basis.T @ image, basis
        basis = image
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return start @ vectors[:, np.argsort(-values)]


def lcs(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over the item's words."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in region.tolist():
        match = masks.get(w, 0)
        if match:
            both = row & match
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


def holds(region: np.ndarray, answer: np.ndarray) -> bool:
    at = np.flatnonzero(region[: max(0, len(region) - len(answer) + 1)] == answer[0])
    return any(np.array_equal(region[i : i + len(answer)], answer) for i in at.tolist())


def checked(passages: DataFrame, block: Block, idf: np.ndarray, space: np.ndarray, items: np.ndarray, owner: np.ndarray) -> DataFrame:
    """Items near a passage in the latent space, or possible by its words, that the words' order confirms."""
    latent = items @ space
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    sent = passages.sparkSession.sparkContext.broadcast((idf, space, latent, owner, block.words, block.ids))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, space, latent, owner, words, ids = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                cosine = projected(batch, idf, space)[0] @ latent.T
                rows: list[dict] = []
                near: dict[tuple[int, int], float] = {}
                for p, q in zip(*np.nonzero(cosine >= MIN_COSINE), strict=True):
                    key = int(p), int(owner[q])
                    near[key] = max(near.get(key, 0.0), float(cosine[p, q]))
                for p, possible in enumerate(batch.column("items").to_pylist()):
                    for i in possible:
                        if (p, i) not in near:
                            near[p, i] = float(cosine[p, owner == i].max())
                for (p, i), value in near.items():
                    region, item = np.frombuffer(batch.column("region")[p].as_py(), np.int32), words[i]
                    common = lcs(item, region)
                    answered = holds(region, item[-ANSWER_WORDS:])
                    if 100 * common >= LEAK_PERCENT * len(item) or (answered and 100 * common >= PARAPHRASE_PERCENT * len(item)):
                        rows.append({
                            "doc_id": batch.column("doc_id")[p].as_py(), "text_order": batch.column("text_order")[p].as_py(), "item_id": ids[i],
                            "start": batch.column("start")[p].as_py(), "lcs_words": common, "item_words": len(item), "cosine": value, "has_answer": answered,
                        })
                kinds = {"cosine": pa.float64(), "has_answer": pa.bool_()}
                names = [part.split()[0] for part in LEAK_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names})

    return passages.mapInArrow(check, LEAK_SCHEMA)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in runs of about ``block_bytes``, by item id."""
    before = Window.orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))
    items = stored(benchmark.filter("text IS NOT NULL").select("item_id", "text", F.floor(size / block_bytes).alias("block")), "benchmark-blocks")
    for number in sorted(r["block"] for r in items.select("block").distinct().collect()):
        yield Block([(r["item_id"], r["text"]) for r in items.filter(F.col("block") == number).orderBy("item_id", "text").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold a benchmark item, with the best match of each item."""
    spark, found = docs.sparkSession, None
    for block in blocks(benchmark, block_bytes):
        if not block.words:
            continue
        idf, other = inverse_frequencies(docs, block)
        passages = stored(likely_passages(docs, block, idf, other), "likely-passages")
        items, owner = block.passages(idf)
        space = latent_space(passages.filter("likely"), block, idf, items)
        rows = checked(passages, block, idf, space, items, owner)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], LEAK_SCHEMA)
    # what retrieval found goes before what only the words showed
    order = F.struct(F.col("cosine") >= MIN_COSINE, "lcs_words", "cosine", -F.col("start"))
    best = F.max_by(F.struct("start", "lcs_words", "item_words", "cosine", "has_answer"), order)
    return found.groupBy("doc_id", "text_order", "item_id").agg(best.alias("best")).select("doc_id", "text_order", "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no benchmark item was found."""
    found = leaks(docs, benchmark, block_bytes).select(F.col("doc_id").alias("leak_id"), F.col("text_order").alias("leak_order")).distinct()
    keyed = hidden(docs, id=F.col("doc_id").cast("long"), text_order=F.xxhash64("text"))
    return keyed.join(found, F.col("id").eqNullSafe(F.col("leak_id")) & (F.col("text_order") == F.col("leak_order")), "left_anti").select("row.*")
