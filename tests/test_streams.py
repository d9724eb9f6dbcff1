"""The stream queries on tables that are folders of files."""

from __future__ import annotations

from riskweave.plans import queries


def test_streams_read_tables_of_many_files(spark, tmp_path):
    texts = [(1, "one two"), (2, "one two"), (3, None), (4, "class A { }")]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    events = [(i, "error" if i % 2 else "view", f"2024-01-01 {i:02d}:00:00") for i in range(24)]
    spark.createDataFrame(events, "event_id bigint, event_type string, ts string").withColumn(
        "ts", queries.F.to_timestamp("ts")).repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    sums = queries.REGISTRY["stream_reupload"](spark, str(tmp_path)).collect()
    assert len(sums) == len({text for _, text in texts}) and all(r["has_file"] for r in sums)
    scanned = queries.REGISTRY["stream_scan"](spark, str(tmp_path)).collect()
    assert sorted(r["file_id"] for r in scanned) == [1, 2, 4]  # a file without content is rejected
    windows = queries.REGISTRY["stream_status"](spark, str(tmp_path)).collect()
    assert sum(r["n_runs"] for r in windows) == 18
