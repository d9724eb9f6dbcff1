"""Inputs in which the texts to be found are hidden among many that look alike."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers

from riskweave.llm import line_dedup, near_dedup, passage_dedup, secret_scan
from riskweave.llm.shingles import gram_hashes, word_hashes
from tests.llm import corpora


def variant(words: list[str], name: str, rng: random.Random, n: int) -> list[str]:
    out = list(words)
    for place in rng.sample(range(len(out)), n):
        out[place] = f"{name}x{place}"
    return out


def least_linked(data: list[tuple]) -> dict[int, int]:
    """Least row of each row's component, from all pairs."""
    sets = [corpora.shingles(r[1]) for r in data]
    number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, x in enumerate(sets):
        held[i, [number[y] for y in x]] = 1
    common, size = held @ held.T, held.sum(1)
    links = 100 * common >= 75 * (size[:, None] + size - common)
    least = np.arange(len(sets))
    while True:
        lower = np.array([least[row].min() for row in links])
        if (lower == least).all():
            return dict(enumerate(least.tolist()))
        least = lower


def test_near_duplicates_inside_a_family_of_one_template(spark):
    rng = random.Random(7)
    template = corpora.prose(31, 150)
    family = [variant(template, f"v{i}", rng, 4) for i in range(1200)]
    family += [variant(family[i], f"w{i}", rng, 3) for i in range(120)]
    data = [(i, " ".join(words), "en", "a", 1) for i, words in enumerate(family)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(corpora.frame(spark, data)).collect()}
    least = least_linked(data)
    assert len(set(least.values())) > 600
    assert got == least


def boilerplate() -> list[str]:
    """Twenty words with a gram of so small a hash that suffixes nearly always begin there."""
    for seed in range(10_000):
        words = corpora.prose(seed, 20)
        if gram_hashes(word_hashes([w.encode() for w in words]), passage_dedup.GRAM).min() < 2**64 // 500:
            return words
    raise AssertionError


def test_passages_that_lie_before_a_common_line(spark):
    line = boilerplate()
    data, expected = [], {}
    for i in range(300):
        own, after = corpora.prose(50_000 + i, 60), corpora.prose(60_000 + i, 60)
        if i >= 290:  # shares the 35 words before the line with a document far from it
            own[-35:] = corpora.prose(50_000 + i - 290, 60)[-35:]
            own[-36] = "other"
            expected |= {i: [(25, 80, i - 290)], i - 290: [(25, 80, None)]}
        data.append((i, " ".join(own + line + after), "en", "a", 1))
    got: dict[int, list] = {}
    for r in passage_dedup.repeated_passages(corpora.frame(spark, data)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["until"], r["earlier_id"]))
    assert got == expected


def test_blocks_of_lines_that_all_stand_elsewhere_before(spark):
    data = []
    for i in range(12):
        block = [f"block {i} line {k}" for k in range(3)]
        for base in (0, 500, 700):  # the lines one by one, before and between the holders of the block
            data += [(base + 3 * i + k, f"head {base} {i} {k} of its own\n{line}\ntail {base} {i} {k} of its own") for k, line in enumerate(block)]
        data += [(base + i, "\n".join([f"top {base} {i}", *block, f"end {base} {i}"])) for base in (400, 900)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    held: dict[tuple, int] = {}
    expected: dict[int, set] = {}
    for doc, text in sorted(data):
        lines = text.split("\n")
        for a in range(len(lines)):
            until = next((b for b in range(a + 1, len(lines) + 1) if sum(len(x.split()) for x in lines[a:b]) >= line_dedup.MIN_BLOCK_WORDS), None)
            if until and held.setdefault(tuple(lines[a:until]), doc) < doc:
                expected.setdefault(doc, set()).update(range(a, until))
    got = {r["doc_id"]: {i for b in r["blocks"] for i in range(b["start"], b["until"])} for r in line_dedup.line_cuts(docs).collect()}
    assert len(expected) == 12
    assert got == expected


def test_random_keys_of_one_case_and_inside_paths():
    tokens = secret_scan.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(11)
    assert secret_scan.random_spans("JBSWY3DPEHPK3PXP", [], tokens) == [(0, 3, 16)]
    kinds = [("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), ("abcdefghijklmnopqrstuvwxyz0123456789", 24)]
    for letters, n in kinds:
        for before in ("key ", "see /downloads/customers/documents/"):
            found = 0
            for _ in range(200):
                key = "".join(rng.choices(letters, k=n))
                spans = secret_scan.random_spans(f"{before}{key} end", [], tokens)
                found += any(a <= len(before) and b == len(before) + n for a, _, b in spans)
            assert found >= 196
    names = "some_long_identifier_name CamelCaseIdentifierName src/main/java/example/ServiceController 2024-01-01-00-00-00 ================ MAX_RETRY_COUNT_VALUE"
    assert secret_scan.random_spans(names, [], tokens) == []
