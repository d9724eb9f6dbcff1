"""The pipeline against a plain version of all its stages."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import corpora


def plain(data: list[tuple], items: list[str]) -> list[tuple]:
    """The rows that reach the last stage, in the order of the data."""
    kept = [r for r in data if len(corpora.words(r[1])) >= 10 and 5 * corpora.repeated_words(corpora.words(r[1])) <= len(corpora.words(r[1]))]
    groups, first = corpora.linked(kept), {}
    for r, g in zip(kept, groups, strict=True):
        if g not in first or (r[0] is None, r[0]) < (first[g][0] is None, first[g][0]):
            first[g] = r
    kept = [r for r in first.values() if not any(item in r[1] for item in items)]
    _, taken = corpora.mix(kept)
    return [r for r, t in zip(kept, taken, strict=True) for _ in range(int(t / len(corpora.words(r[1])) + 0.5))]


def test_run_matches_the_plain_version(spark, tmp_path):
    items = [" ".join(corpora.prose(7000 + i, 30)) for i in range(4)]
    data = corpora.rows() + [(3000 + i, f"{corpora.text(90 + i, 60)} {items[i % 4]}", "en", "b", 1) for i in range(6)]
    corpora.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = plain(data, items)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(r[1].encode()) + 8) for r in expected)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing", "sharding"]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpora.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpora.frame(spark, []).columns and docs.count() == 0
