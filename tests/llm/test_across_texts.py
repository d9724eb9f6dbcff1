"""Operators that compare texts with each other."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import decontamination, line_dedup, near_dedup, passage_dedup
from riskweave.llm.components import components
from tests.conftest import SMALL
from tests.llm import corpora


def plain_components(data: list[tuple]) -> list[tuple]:
    groups = corpora.linked(data)
    least: dict[int, int | None] = {}
    for r, g in zip(data, groups, strict=True):
        least[g] = min((x for x in (least.get(g), r[0]) if x is not None), default=None)
    return sorted((r[0] or -1, len(corpora.shingles(r[1])), least[g] or -1 if least[g] != 0 else 0, r[0] == least[g]) for r, g in zip(data, groups, strict=True))


def test_near_duplicates_match_all_pairs(spark):
    data = corpora.rows() + [(1000 + i, corpora.changed(corpora.text(900 + i % 8, 130), i, i // 4), "en", "a", 1) for i in range(48)]
    got = near_dedup.near_duplicates(corpora.frame(spark, data)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in got) == plain_components(data)


def test_near_duplicates_of_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [
        (max(a, 0), n, c, k) for a, n, c, k in sorted((r[0], len(corpora.shingles(r[1])), c, k) for r, (c, k) in zip(data, rooted(data), strict=True))
    ]


def rooted(data: list[tuple]) -> list[tuple[int, bool]]:
    groups = corpora.linked(data)
    least = {g: min(r[0] for r, h in zip(data, groups, strict=True) if h == g) for g in set(groups)}
    return [(least[g], r[0] == least[g]) for r, g in zip(data, groups, strict=True)]


def test_one_row_of_each_group_stays(spark):
    data = corpora.rows()
    docs = corpora.frame(spark, data)
    left = near_dedup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    groups = corpora.linked(data)
    worded = {g for r, g in zip(data, groups, strict=True) if corpora.words(r[1])}
    wordless = sum(not corpora.words(r[1]) for r in data)
    assert left.count() == len(worded) + wordless
    assert near_dedup.without_near_duplicates(corpora.frame(spark, [])).collect() == []


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    for percent in (75, 90):
        common = int(300 * 2 * percent / (100 + percent))
        pool = rng.integers(0, 1 << 63, 600 - common, dtype=np.uint64)
        samples = near_dedup.samples_of([np.unique(pool[:300]), np.unique(pool[300 - common :])])
        assert abs((samples[:, 0] == samples[:, 1]).mean() - percent / 100) < 0.2
        x, y = near_dedup.odd_sketches(samples).view(np.uint64)
        assert np.bitwise_count(x ^ y).sum() <= near_dedup.MAX_ODD_BITS


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(20)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200 + i: 100 for i in range(20)}


def covered(rows: list) -> dict:
    found = defaultdict(set)
    for r in rows:
        found[r["doc_id"], r["text_order"]].update(range(r["start"], r["until"]))
    return found


@pytest.mark.parametrize("partitions", [3, 40])
def test_repeated_passages_match_all_windows(spark, partitions):
    data = corpora.rows()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = passage_dedup.repeated_passages(corpora.frame(spark, data)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    width, texts = passage_dedup.MIN_WORDS, [corpora.words(r[1]) for r in data]
    windows = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    expected = defaultdict(set)
    for r, w in zip(data, texts, strict=True):
        for i in range(len(w) - width + 1):
            if windows[tuple(w[i : i + width])] > 1:
                expected[r[0]].update(range(i, i + width))
    mine = defaultdict(set)
    for (doc_id, _), places in covered(got).items():
        mine[doc_id] |= places
    assert mine == expected
    earlier = {r["doc_id"]: r["earlier_id"] for r in got}
    assert earlier[104] < 104 and earlier[3] is None and set(earlier) >= {300, 301, 302}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.integers(1, 12))
def test_least_in_windows(values, width):
    array, width = np.array(values, np.uint64), min(width, len(values))
    expected = {i + int(np.argmin(array[i : i + width])) for i in range(len(values) - width + 1)}
    assert passage_dedup.least_in_windows(array, width).tolist() == sorted(expected)


ITEMS = [(i, " ".join(corpora.prose(5000 + i, 16 + 9 * i))) for i in range(6)] + [(90, "too short"), (91, None), (None, " ".join(corpora.prose(4999, 20)))]


def test_planted_items_are_found_and_clean_texts_are_not(spark):
    items = dict(ITEMS)
    paraphrase = items[3].split(" ")
    for i in range(2, len(paraphrase) - 8, 4):
        paraphrase[i] = "instead"
    planted = {2000 + i: (i, f"{corpora.text(i, 70)} {items[i]} {corpora.text(40 + i, 90)}") for i in range(6)}
    planted[2100] = (3, f"{corpora.text(60, 30)} {' '.join(paraphrase)} {corpora.text(61, 30)}")
    planted[2101] = (1, items[1].upper().replace(" ", "\n"))
    planted[2102] = (None, items[None])
    half = items[5].split(" ")
    data = corpora.rows() + [(k, t, "en", "a", 1) for k, (_, t) in planted.items()] + [(2200, " ".join(half[:20]), "en", "a", 1)]
    benchmark = spark.createDataFrame([(i, t, "own") for i, t in ITEMS], "item_id long, text string, size string")
    for block_bytes in (1 << 17, 200):
        got = decontamination.leaks(corpora.frame(spark, data), benchmark, block_bytes).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, i) for k, (i, _) in planted.items()}
    left = decontamination.without_leaks(corpora.frame(spark, data), benchmark)
    assert left.count() == len(data) - len(planted)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(corpora.frame(spark, data), none).collect() == []
    assert decontamination.leaks(corpora.frame(spark, []), benchmark).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(-1, 4), max_size=30))
def test_lcs_matches_the_table(item, region):
    table = [[0] * (len(region) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item):
        for j, y in enumerate(region):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontamination.lcs(np.array(item, np.int32), np.array(region, np.int32)) == table[-1][-1]


def line(name: str) -> str:
    return " ".join(f"{name}{i}" for i in range(6))


LINES = [
    (1, "\n".join(map(line, "abcdef")), "en", "a", 1),
    (2, "\n".join([line("x"), line("b"), line("c"), "", line("d"), line("y")]), "en", "a", 1),  # a block with a blank line inside
    (3, "\n".join([line("a"), line("z"), line("f")]), "en", "a", 1),  # single lines are too short to be blocks
    (4, "\n".join(map(line, "abcdef")), "en", "a", 1),  # a copy
    (5, "\n".join([line("c"), line("b"), line("q")]), "en", "a", 1),  # other order: no block of two
    (None, "\n".join(map(line, "abcdef")), "en", "a", 1),
]


def test_common_blocks_leave_the_later_document(spark):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(corpora.frame(spark, LINES + corpora.AWKWARD[:4])).collect()}
    assert got[1]["n_deleted"] == 0 and got[1]["blocks"] is None
    assert got[2]["text"] == f"{line('x')}\n{line('y')}" and got[2]["n_deleted"] == 4 and got[2]["first_from"] == 1
    assert got[3]["n_deleted"] == 0 and got[5]["n_deleted"] == 0
    assert got[4]["text"] == "" and got[4]["n_deleted"] == 6 and got[None]["n_deleted"] == 6
    assert got[900]["text"] is None and got[901]["text"] == "" and got[900]["n_lines"] == 0
    assert line_dedup.line_dedup(corpora.frame(spark, [])).collect() == []


def test_deleted_lines_stand_in_earlier_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen: set[str] = set()
    texts: dict[str, int] = {}
    for r in line_dedup.line_dedup(docs.withColumnRenamed("n_chars", "n")).join(docs.selectExpr("doc_id", "text AS whole"), "doc_id").orderBy("doc_id").collect():
        lines = r["whole"].split("\n")
        gone = {i for b in r["blocks"] or [] for i in range(b["start"], b["until"])}
        assert all(lines[i] in seen or not lines[i].split() for i in gone)
        assert r["text"] == "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if r["whole"] in texts and len(r["whole"].split()) >= line_dedup.MIN_BLOCK_WORDS:
            assert r["n_deleted"] == len(lines)
        seen.update(lines)
        texts[r["whole"]] = r["doc_id"]


def test_line_dedup_holds_few_rows_at_a_time(spark):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, 700)]
    cut = list(line_dedup.slices(iter(batches)))
    assert [x for b in cut for x in b.column("x").to_pylist()] == [0, *range(700)]
    assert max(b.num_rows for b in cut) == line_dedup.SLICE_ROWS < 700
    texts = [(i, "\n".join(f"line {i} {k}" for k in range(i % 7)) if i % 11 else None) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.n_lines, r.places, r.words) for r in line_dedup.line_table(docs).collect()}
    assert got == {i: (n := len(text.split("\n")) if text else 0, list(range(n)), [3] * n) for i, text in texts}



@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=15), st.lists(st.integers(0, 9), max_size=15))
def test_patience_aligns_equal_values_in_order(x, y):
    pairs = line_dedup.patience(x, y)
    assert all(x[i] == y[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    if x == y:
        assert len(pairs) == len(x)


def test_a_step_that_changes_nothing_ends_the_components_without_a_shuffle(spark, monkeypatch):
    """Jobs of one call on stars: the edges and one step are written, and the files are asked for an edge that moved."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # one job a query
    try:
        edges = spark.createDataFrame([(9, 1), (8, 1), (7, 2)], "a long, b long")
        spark.sparkContext.setJobGroup("stars", "stars")
        found = components(edges, "test")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("stars")
    finally:
        spark.sparkContext.setJobGroup("", "")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r["node"]: r["root"] for r in found.collect()} == {9: 1, 8: 1, 7: 2}
    assert len(jobs) <= 8, len(jobs)
