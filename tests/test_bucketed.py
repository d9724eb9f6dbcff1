"""Tables in buckets: sources that are not moved, and the index of earlier contents."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskweave.operators import dedup, structure
from riskweave.operators.lexer import token_table
from riskweave.plans.analysis import analyse_uploads
from riskweave.sources import checksum_index
from riskweave.sources.bucketed import store_sources, stored_sources
from riskweave.sources.checksum_index import ChecksumIndex

COLUMNS = "file_id bigint, file_name string, src string, size_bytes int"


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_stored_sources_are_not_moved(spark, tmp_path):
    rows = [(i, f"F{i}.java", f"class A {{ String apiKey = \"abcd{i}\"; void m() {{ }} }}", 50) for i in range(60)]
    files = spark.createDataFrame(rows, COLUMNS)
    for part in (files.where("file_id < 40"), files.where("file_id >= 40")):  # two days
        store_sources(part, str(tmp_path / "sources"), buckets=4)
    stored = stored_sources(spark, str(tmp_path / "sources"), COLUMNS, buckets=4)
    assert stored.count() == 60
    for df in (token_table(stored, in_buckets=True), structure.code_sites(stored, in_buckets=True)):
        plan = plan_of(df)
        assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    result, rejected = analyse_uploads(stored, in_buckets=True)
    moved, _ = analyse_uploads(files)
    assert rejected.count() == 0
    drop = ["record_id", "run_id"]
    assert result.records.drop(*drop).exceptAll(moved.records.drop(*drop)).count() == 0 and result.records.count() == 60


def days(spark, seed: int, n: int):
    pick = random.Random(seed)
    return spark.createDataFrame([(f"{seed}-{i}", f"text {pick.randrange(400)}") for i in range(n)], "file_id string, src string")


def test_contents_of_earlier_days_are_known(spark, tmp_path):
    index, first = ChecksumIndex(spark, str(tmp_path / "index"), buckets=4), {}
    for day in range(1, 4):
        files = days(spark, day, 150)
        sums = dedup.stored_checksums(files)
        got = {r.file_id: r for r in dedup.reupload_across_runs(sums, index.lookup(sums)).collect()}
        texts = {r.file_id: r.src for r in files.collect()}
        for file_id, text in texts.items():
            same = [f for f, t in texts.items() if t == text]
            row = got[file_id]
            assert (row.n_copies, row.first_file) == (len(same), min(same))
            assert (row.seen_run, row.seen_file) == first.get(text, (None, None))
            assert row.is_reupload == (text in first or file_id != min(same))
        for _ in range(2):  # a repeated run adds nothing
            index.add(sums, f"2024-01-0{day}", f"run-{day}")
        for text in set(texts.values()) - set(first):
            first[text] = (f"run-{day}", min(f for f, t in texts.items() if t == text))
        assert index.rows.count() == len(first)
    again = ChecksumIndex(spark, str(tmp_path / "index"), buckets=4)  # another session opens the same files
    assert again.rows.count() == len(first)


def test_index_is_filtered_where_it_lies(spark, tmp_path, monkeypatch):
    index = ChecksumIndex(spark, str(tmp_path / "index"), buckets=4)
    history = spark.range(20_000).select(F.col("id").alias("file_id"), F.sha2(F.col("id").cast("string"), 256).alias("checksum_sha256"))
    index.add(history, "2024-01-01", "run-1")
    today = history.where("file_id % 1000 = 0").unionByName(history.select((F.col("file_id") + 10**6).alias("file_id"), F.sha2(
        (F.col("file_id") + 10**6).cast("string"), 256).alias("checksum_sha256")).where("file_id % 1000 = 0"))
    found = index.lookup(today)
    assert {r.seen_file for r in found.collect()} == {str(i) for i in range(0, 20_000, 1000)}
    wanted = today.select("checksum_sha256").distinct()
    assert index._probed(wanted, 1).count() < 200  # 40 keys in 32,768 bits; 20 of them are there
    stored = str(tmp_path / "today")
    today.write.parquet(stored)
    plan = plan_of(index.lookup(spark.read.parquet(stored)))
    assert "Bucketed: true" in plan and "getbit" in plan  # neither the semi join nor the grouping moves the index
    assert plan.count("Exchange hashpartitioning(checksum_sha256") == plan.count("today]")
    monkeypatch.setattr(checksum_index, "MOST_CELLS", 1)  # a full filter lets everything through and loses nothing
    everything = history.withColumn("file_id", F.col("file_id") + 1)
    assert index.lookup(everything).count() == 20_000
