"""Very long texts and empty tables, for the operators that look at whole texts."""

from __future__ import annotations

import pytest

from riskweave.llm import line_dedup, near_dedup, ngram_join, passage_dedup, repetition, secret_scan, spelling, token_counts, token_files
from tests.llm import corpora

N = 120_000


@pytest.fixture(scope="module")
def long_docs(spark):
    words = [f"w{i}x{i * 7919 % 1000}" for i in range(N)]
    text = "\n".join(" ".join(words[i : i + 12]) for i in range(0, N, 12))
    other = " ".join([*words[: N // 2], *(f"v{i}" for i in range(N // 2))])
    return corpora.frame(spark, [(1, text, "en", "a", 1), (2, text.replace("\n", "  \n", 3), "en", "a", 1), (3, other, "en", "b", 1), (4, "short one", "en", "b", 1)])


def test_passages_of_long_texts(long_docs):
    rows = {(r["doc_id"], r["start"], r["until"]) for r in passage_dedup.repeated_passages(long_docs).collect()}
    # an edge is told by 15 bits a word, so a span may end a word or two late
    assert {(d, s) for d, s, _ in rows} == {(1, 0), (2, 0), (3, 0)}
    assert all(u == N if d < 3 else N // 2 <= u <= N // 2 + 2 for d, _, u in rows)


def test_components_of_long_texts(long_docs):
    for found in (near_dedup.near_duplicates(long_docs), ngram_join.ngram_components(long_docs)):
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_other_operators_on_long_texts(long_docs):
    lines = {r["doc_id"]: (r["n_lines"], r["n_deleted"]) for r in line_dedup.line_dedup(long_docs).collect()}
    assert lines[1] == (N // 12, 0) and lines[2] == (N // 12, N // 12 - 3) and lines[3] == (1, 0)
    assert {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in repetition.repetition(long_docs).collect()} == {1: (N, 0), 2: (N, 0), 3: (N, 0), 4: (2, 0)}
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(long_docs).collect()}
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_files.token_file_rows(long_docs).collect()} == tokens
    assert all(r["n_hex"] == 0 for r in secret_scan.scan_secrets(long_docs).collect())
    assert spelling.spelling_variants(long_docs).count() == 0  # runs of one letter


def test_empty_tables(spark):
    docs = corpora.frame(spark, [])
    for found in (passage_dedup.repeated_passages(docs), near_dedup.without_near_duplicates(docs), ngram_join.ngram_components(docs), line_dedup.line_dedup(docs),
                  token_files.token_file_rows(docs), spelling.spelling_variants(docs), repetition.repetition(docs), secret_scan.scan_secrets(docs)):
        assert found.collect() == []
