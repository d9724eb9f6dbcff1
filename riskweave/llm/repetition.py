"""Quality rules: repetition inside a document, by suffix arrays over words.

Each text's words get a suffix array by prefix doubling; longest common prefixes of
neighbours give the intervals of repeated substrings. The longest repeat that starts
at a word is the larger of its two neighbours' prefixes, and the union of the maximal
repeats of at least ``MIN_REPEAT`` words is the union of those spans. A document is
rejected if the spans cover too large a share of its characters, or if its longest
repeat is too long, besides the two base rules (too few words, too many words in
repeated five-word windows).

Many documents share one array: a suffix starts with its document's number, so
that suffixes of different documents never share a prefix.

Defined results: a null or empty text, and one of white space only, has no words
and fails the base rules; rows with null or repeated ids are judged one by one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from riskweave.llm.common import numbered, runs, texts_of, words_of

MIN_WORDS = 10
MIN_REPEAT = 5
MAX_REPEAT_WORDS_PERCENT = 20
#: Largest share of a document's word characters inside repeats.
MAX_COVERED_CHARS_PERCENT = 20
#: Longest single repeat, in words, that is still accepted ...
MAX_LONGEST_REPEAT = 50
#: ... unless it is a smaller part of its document than this.
MAX_LONGEST_PERCENT = 10
#: Bytes of text whose documents share one suffix array.
ARRAY_BYTES = 1 << 20

SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, covered_chars long, longest_repeat long, kept boolean, spans array<struct<start: long, until: long>>"
)


def suffix_levels(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; the last level has no equal ranks.

    A rank is the place of its group's first member in the order, so only members
    of groups that are still shared are sorted again.
    """
    n = len(ids)
    place = np.arange(n)

    def grouped(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.ones(len(sorted_keys), bool)
        first[1:] = sorted_keys[1:] != sorted_keys[:-1]
        alone = first & np.append(first[1:], True)
        return np.maximum.accumulate(np.where(first, place[: len(sorted_keys)], 0)), alone

    key = doc * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    starts, alone = grouped(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = starts
    levels, active, width = [rank], order[~alone], 1
    while active.size:
        ahead = active + width
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old, _ = grouped(rank[active])
        new, alone = grouped(key)
        rank = rank.copy()
        rank[active] += new - old
        levels.append(rank)
        active = active[~alone]
        width *= 2
    return levels


def repeat_lengths(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, at_least: int = 1) -> np.ndarray:
    """Words of the longest repeat that starts at each word, 0 if under ``at_least``."""
    found = np.zeros(len(ids), np.int64)
    if len(ids) < 2:
        return found
    levels = suffix_levels(ids, doc, end)
    order = np.empty(len(ids), np.int64)
    order[levels[-1]] = np.arange(len(ids))
    # neighbours that share the largest power of two below the limit
    sure = min(at_least.bit_length() - 1, len(levels) - 1)
    close = levels[sure][order[:-1]] == levels[sure][order[1:]]
    a, b = order[:-1][close], order[1:][close]
    common = np.zeros(len(a), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        x, y = np.where(inside, x, a), np.where(inside, y, b)
        common += np.where(inside & (levels[power][x] == levels[power][y]), 1 << power, 0)
    common[common < at_least] = 0
    found[a] = common
    found[b] = np.maximum(found[b], common)
    return found


def spans_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans ``[i, i + lengths[i])``."""
    covered = np.zeros(len(lengths) + 1, np.int64)
    at = np.flatnonzero(lengths)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + lengths[at], -1)
    inside = np.concatenate(([False], np.cumsum(covered[:-1]) > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def judged(texts: list[bytes]) -> dict[str, list]:
    words = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(counts)
    starts = ends - counts
    flat = [w for part in words for w in part]
    spans: list[list[dict[str, int]]] = [[] for _ in texts]
    covered_words, covered_chars, longest, chars = (np.zeros(len(texts), np.int64) for _ in range(4))
    if flat:
        ids, distinct = numbered(flat)
        lengths_of = pc.utf8_length(distinct.cast(pa.string())).to_numpy(zero_copy_only=False)[ids].astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        repeats = repeat_lengths(ids, doc, ends[doc], MIN_REPEAT)
        before = np.concatenate(([0], np.cumsum(lengths_of)))
        chars = before[ends] - before[starts]
        np.maximum.at(longest, doc, repeats)
        # spans never pass their document's end, but two may touch there: cut at document starts
        begin, until = spans_of(repeats)
        for a, b in zip(begin.tolist(), until.tolist(), strict=True):
            while a < b:
                d = int(doc[a])
                stop = min(b, int(ends[d]))
                spans[d].append({"start": a - int(starts[d]), "until": stop - int(starts[d])})
                covered_words[d] += stop - a
                covered_chars[d] += before[stop] - before[a]
                a = stop
    base = (counts < MIN_WORDS) | (100 * covered_words > MAX_REPEAT_WORDS_PERCENT * counts)
    repetitive = (100 * covered_chars > MAX_COVERED_CHARS_PERCENT * chars) | (
        (longest > MAX_LONGEST_REPEAT) & (100 * longest > MAX_LONGEST_PERCENT * counts)
    )
    return {
        "n_words": counts, "word_chars": chars,
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": [dup_lines(t) for t in texts], "n_repeat_words": covered_words, "base_failed": base,
        "covered_chars": covered_chars, "longest_repeat": longest, "kept": ~base & ~repetitive, "spans": spans,
    }


def repetition(docs: DataFrame) -> DataFrame:
    """Counts, repeat spans (in words) and the verdict for each document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id")
            for a, b in runs([len(t) for t in texts], ARRAY_BYTES):
                result = judged(texts[a:b])
                kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64())]))}
                columns = {name: pa.array(values, kinds.get(name, pa.int64())) for name, values in result.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a:b].cast(pa.int64())} | columns)

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


def without_repetitive(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, as they are."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            kept = [judged(texts[a:b])["kept"] for a, b in runs([len(t) for t in texts], ARRAY_BYTES)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else [], pa.bool_()))

    return docs.mapInArrow(pick, docs.schema)
