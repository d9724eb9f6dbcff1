from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import md5

import pytest

from riskweave.llm import mixing, sharding
from riskweave.llm.oracles import LLM_ORACLES
from riskweave.llm.queries import LLM_REGISTRY
from tests.compare import connect, difference
from tests.conftest import SMALL
from tests.llm import corpora


def test_mix_matches_sql(spark):
    assert difference(spark, connect(SMALL), SMALL, LLM_REGISTRY["op2_mix_sources"], LLM_ORACLES["op2_mix_sources"]) is None


def test_mix_of_awkward_rows_matches_resharing_and_seats_one_by_one(spark):
    data = corpora.rows()
    target, taken = corpora.mix(data)
    got = mixing.mix(corpora.frame(spark, data)).collect()
    expected = sorted((r[0] or -1, len(corpora.words(r[1])), t) for r, t in zip(data, taken, strict=True))
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == expected
    assert {round(r["target"], 6) for r in got} == {round(t, 6) for t in target.values()}
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_quotas_of_shards_sum_to_one_apportionment(spark):
    docs = corpora.frame(spark, corpora.rows())
    rows = mixing.sized(docs)
    sources = mixing.with_block(mixing.source_targets(rows), 64)
    whole = {r["source_rank"]: r["quota"] for r in mixing.shard_quotas(sources, 1 << 40).collect()}
    cells = mixing.shard_quotas(sources, 100).collect()
    per_source, per_shard = defaultdict(int), defaultdict(int)
    for r in cells:
        assert r["quota"] >= 0
        per_source[r["source_rank"]] += r["quota"]
        per_shard[r["shard"]] += r["quota"]
    assert dict(per_source) == whole
    assert {n for shard, n in per_shard.items() if shard < max(per_shard)} == {100}


def test_mixed_documents_are_whole_texts_near_their_share(spark):
    data = corpora.rows()
    docs = corpora.frame(spark, data)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    _, taken = corpora.mix(data)
    copies = sum(int(t / len(corpora.words(r[1])) + 0.5) for r, t in zip(data, taken, strict=True) if corpora.words(r[1]))
    assert mixed.count() == copies


@pytest.mark.parametrize("digits", [1, 3])
def test_shards_are_minimax_and_keep_equal_texts_together(spark, digits):
    data = corpora.rows()
    got = sharding.shard_documents(corpora.frame(spark, data), 7, digits).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(
        (r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in data
    )
    groups: dict[str, int] = defaultdict(int)
    for r in data:
        groups[md5((r[1] or "").encode()).hexdigest()] += len((r[1] or "").encode()) + 8
    loads, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert max(loads.values()) <= corpora.capacity([groups[k] for k in sorted(groups)], 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_one_group_larger_than_a_shard_leaves_the_others_even(spark):
    data = [(i, "same text " * 50, "en", "a", 1) for i in range(60)] + [(100 + i, corpora.text(i, 60), "en", "a", 1) for i in range(60)]
    loads = defaultdict(int)
    for r in sharding.shard_documents(corpora.frame(spark, data), 6, 1).collect():
        loads[r["shard"]] += r["size"]
    assert len(loads) == 6 and max(loads.values()) == 60 * 508


def test_empty_tables(spark):
    empty = corpora.frame(spark, [])
    assert mixing.mix(empty).collect() == [] and sharding.shard_documents(empty).collect() == []
    assert mixing.mixed_documents(empty).collect() == []
