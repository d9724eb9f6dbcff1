"""Centroids, spelling variants and the n-gram join against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import centroids, ngram_join, spelling
from riskweave.llm.shingles import mixed
from tests.llm import corpora

# --- centroids ---------------------------------------------------------------

VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n: int, seed: int = 1, width: int = 64) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    return [(i, (centres[i % 5] + 0.3 * rng.normal(size=width)).astype(np.float32).tolist(), i % 5) for i in range(n)]


def plain_clusters(rows: list[tuple], k: int = 16, rounds: int = 3) -> list[tuple]:
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**21 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(b"1:%d" % (r[0] or 0)).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(centres)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found]


def clusters(spark, rows: list[tuple], **options) -> list[tuple]:
    table = spark.createDataFrame(rows, VECTOR_SCHEMA).withColumns({"cluster": F.lit("own"), "whole": F.lit(1), "rest": F.lit(2)})
    found = centroids.cluster_vectors(table, **options).withColumn("sha", centroids.digest(F.col("centroid")))
    return [tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "sha").collect()]


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=str)


def test_centroids_equal_plain_rounds(spark):
    rows = vectors(300)
    bad = [float("nan"), float("inf"), None, -float("inf"), float(2**22)]
    rows += [(1000 + i, [x, *rows[0][1][1:]], 1) for i, x in enumerate(bad)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, rows[0][1][:63], 1), (2003, [*rows[0][1], 0.0], 1)]
    rows += [(None, rows[1][1], 1), (3, rows[3][1], 1), (3, rows[4][1], 1), (4000, [0.0] * 64, 1), (4001, [-0.001] * 64, 1)]
    assert in_order(clusters(spark, rows)) == in_order(plain_clusters(rows))


@pytest.mark.parametrize("rows", [[], vectors(3), vectors(20)[:1] * 40])
def test_centroids_of_few_or_equal_vectors(spark, rows):
    assert in_order(clusters(spark, rows)) == in_order(plain_clusters(rows))


def test_filter_loses_no_nearest_centroid():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-90, 90, (400, 64)), rng.integers(-2**27, 2**27, (50, 64)), np.zeros((3, 64), np.int64)])
    centres = np.concatenate([x[::40], x[:2] + 1])  # ties and near ties
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1][:, :12].copy()
    leading, rest = centroids.rotated(x, axes)
    cluster, distance, _ = centroids.nearest(x, leading, rest, centres, axes)
    exact = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_filter_spares_most_distances():
    rows = vectors(2000, seed=3)
    x = np.floor(64 * np.array([v for _, v, _ in rows])).astype(np.int64)
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1][:, :12].copy()
    leading, rest = centroids.rotated(x, axes)
    verified = centroids.nearest(x, leading, rest, x[:16], axes)[2]
    assert verified < 0.5 * 16 * len(x)


# --- spelling ----------------------------------------------------------------


def plain_words(data: list[tuple]) -> dict[str, int]:
    found: Counter = Counter()
    for doc_id, text, *_ in data:
        for run in spelling.RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if n >= 3 and len(w) >= 5}


def edits(word: str, letters: set[str]) -> set[str]:
    places = range(len(word) + 1)
    found = {word[:i] + word[i + 1 :] for i in places[:-1]} | {word[:i] + c + word[i:] for i in places for c in letters}
    return (found | {word[:i] + c + word[i + 1 :] for i in places[:-1] for c in letters}) - {word}


def plain_variants(data: list[tuple]) -> dict[str, tuple]:
    words = plain_words(data)
    letters = {c for w in words for c in w}
    near = {w: sorted((v for v in edits(w, letters) if v in words), key=lambda v: (-words[v], v)) for w in words}
    form = {w: v[0] if v and words[v[0]] >= 2 * words[w] else None for w, v in near.items()}
    found = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        found[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return found


def variants(spark, data: list[tuple], **options) -> dict[str, tuple]:
    docs = corpora.frame(spark, data).withColumns({c: F.lit("own") for c in ("word", "n", "head", "piece", "near", "form", "held")})
    rows = spelling.spelling_variants(docs, **options).collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def spelled(seed: int, n: int) -> list[tuple]:
    """Texts over few letters, so that many words are near many others."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abàÿ") for _ in range(rng.randrange(4, 9))) for _ in range(300)]
    return [(i, " ".join(rng.choice(pool[: 1 + rng.randrange(300)]).title() if rng.random() < 0.2 else rng.choice(pool) for _ in range(60)), "en", "a", 1)
            for i in range(n)]


def test_variants_equal_plain_edits(spark):
    long = "ab" * 400
    data = spelled(1, 60) + [(900 + i, f"{long} {long[:-1]} {long[:300]}x{long[300:]} {'a' * 260} {'a' * 261}", "en", "a", 1) for i in range(4)]
    data += [(None, "straße naïve", "de", "b", 1)] * 3 + [(1, "", "en", "a", 1), (2, None, "en", "a", 1), (3, "1 2 ... ×÷", "en", "a", 1)]
    expected = plain_variants(data)
    assert sum(v[0] is not None for v in expected.values()) > 20 and any(v[0] != v[1] and v[0] for v in expected.values())
    assert variants(spark, data) == expected


def test_large_initial_states_are_cut_into_parts(spark):
    data = spelled(2, 60)
    assert variants(spark, data, block=3) == plain_variants(data)


def test_no_words(spark):
    assert variants(spark, []) == {} and variants(spark, corpora.AWKWARD[:2]) == {}


def test_equal_futures_are_one_state():
    machine = spelling.Acceptor()
    start = machine.initial(sorted(["winding", "binding", "finding", "wind", "bind", "find"]))
    assert len(machine.final) == len("inding") + 2
    assert set(machine.pairs(start, start)) == {(x + t, y + t) for t in ("ind", "inding") for x in "wbf" for y in "wbf" if x != y}


# --- n-gram join -------------------------------------------------------------


def plain_components(data: list[tuple], width: int = 4, percent: int = 85) -> list[int | None]:
    sets = [corpora.shingles(r[1], width) for r in data]
    group = list(range(len(data)))
    by_word = defaultdict(set)
    for i, x in enumerate(sets):
        others = set().union(*(by_word[s] for s in x)) if x else set()
        for j in others:
            if 100 * len(x & sets[j]) >= percent * len(x | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
        for s in x:
            by_word[s].add(i)
    ids = defaultdict(list)
    for r, g in zip(data, group, strict=True):
        if r[0] is not None:
            ids[g].append(r[0])
    return [min(ids[g], default=None) for g in group]


def joined(spark, data: list[tuple], **options) -> list[tuple]:
    docs = corpora.frame(spark, data).withColumns({c: F.lit("own") for c in ("cells", "tile", "previous", "a", "b", "wide", "no_id")})
    rows = ngram_join.ngram_components(docs, **options)
    return sorted((tuple(r) for r in rows.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def expected(data: list[tuple], **options) -> list[tuple]:
    sizes = [len(corpora.shingles(r[1], options.get("width", 4))) for r in data]
    return sorted(zip([r[0] for r in data], sizes, plain_components(data, **options), strict=True), key=str)


def test_join_equals_all_pairs(spark):
    rng = random.Random(3)
    data = corpora.rows()
    for i in range(150):  # sizes from five words on, changes around the threshold
        words = corpora.prose(5000 + i, rng.randrange(5, 120))
        data.append((3000 + 3 * i, " ".join(words), "en", "a", 1))
        cut = rng.randrange(1, 4)
        data.append((3001 + 3 * i, " ".join(words[cut:] if i % 2 else [*words, *corpora.prose(9000 + i, cut)]), "en", "a", 1))
        data.append((3002 + 3 * i, corpora.changed(" ".join(words), i, 1 + i % 3), "en", "b", 1))
    wanted = expected(data)
    assert len({c for _, _, c in wanted}) < len(data) - 100
    assert joined(spark, data) == wanted


def test_join_inside_a_family_that_shares_most_of_its_text(spark):
    rng = random.Random(4)
    template = corpora.prose(41, 120)

    def variant(words: list[str], name: str, n: int) -> list[str]:
        out = list(words)
        for place in rng.sample(range(len(out)), n):
            out[place] = f"{name}x{place}"
        return out

    family = [variant(template, f"v{i}", 3) for i in range(400)]
    family += [variant(family[i], f"w{i}", 1) for i in range(100)]
    data = [(i, " ".join(words), "en", "a", 1) for i, words in enumerate(family)]
    data += [(10_000 + i, " ".join(template), "en", "a", 1) for i in range(300)]  # and many exact copies
    assert joined(spark, data) == expected(data)


@pytest.mark.parametrize("rows", [[], corpora.AWKWARD, corpora.AWKWARD[:2]])
def test_join_of_awkward_rows(spark, rows):
    assert joined(spark, rows) == expected(rows)


def test_join_at_other_widths_and_thresholds(spark):
    data = corpora.rows()
    assert joined(spark, data, width=2, min_percent=60) == expected(data, width=2, percent=60)


@pytest.mark.parametrize("percent", [60, 75, 85, 95])
def test_linked_sets_always_meet_in_a_cell(percent):
    classes, rng = ngram_join.Classes(percent), np.random.default_rng(percent)
    for size in [*range(1, 40), 57, 100, 333, 1000, 5000]:
        for _ in range(8):
            x = np.unique(mixed(rng.integers(0, 2**63, size).astype(np.uint64)))
            # as many shingles dropped and added as a link allows
            most = 2 * len(x) * (100 - percent) // (100 + percent)
            dropped = rng.integers(0, most // 2 + 1)
            y = np.unique(np.concatenate((x[dropped:], mixed(rng.integers(0, 2**63, most - 2 * dropped if most > 2 * dropped else 0).astype(np.uint64)))))
            if len(y) and not np.array_equal(x, y) and ngram_join.linked(x, y, percent):
                assert np.intersect1d(ngram_join.cells_of(x, classes), ngram_join.cells_of(y, classes)).size


def test_trees_find_every_pair_that_the_bound_allows():
    rng = np.random.default_rng(8)
    base = rng.poisson(4, (12, 30))
    points = np.maximum(0, base[rng.integers(0, 12, 300)] + rng.integers(-1, 2, (300, 30)) * (rng.random((300, 30)) < 0.15)).astype(np.int32)
    sizes, roots, every = points.sum(1), np.arange(300) // 2, np.arange(300)
    found = {(i, j) for _, i, j in ngram_join.close_points(every, every, points, sizes, roots, 85)}
    found = {tuple(sorted(x)) for x in found}
    least = np.minimum(points[:, None], points[None]).sum(2)
    wanted = {(i, j) for i in range(300) for j in range(i + 1, 300) if roots[i] != roots[j] and 185 * least[i, j] >= 85 * (sizes[i] + sizes[j])}
    assert len(wanted) > 500 and found >= wanted
    assert {(i, j) for i, j in found if 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j])} == wanted
