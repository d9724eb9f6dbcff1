"""Published results: visibility, repetition, pruning and history; streams that publish."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from riskweave.operators import history
from riskweave.sources import store
from riskweave.streaming import jobs

RECORD = "file_id bigint, file_name string, record_id string, run_id string, total_findings int, analysed_at timestamp_ntz"
FINDING = "file_id bigint, record_id string, severity string, vulnerability_type string"


def records(spark, run_id: str, at: str, ids: list[int]):
    rows = [(i, f"F{i}.java", f"{run_id}/{i}", run_id, 1) for i in ids]
    return spark.createDataFrame(rows, RECORD.rsplit(",", 1)[0]).withColumn("analysed_at", F.lit(at).cast("timestamp_ntz"))


def findings(spark, run_id: str, ids: list[int]):
    return spark.createDataFrame([(i, f"{run_id}/{i}", s, "X") for i in ids for s in ("LOW", "CRITICAL")], FINDING)


def put(spark, root: str, run_id: str, at: str, ids: list[int]) -> None:
    store.publish({"records": records(spark, run_id, at, ids), "findings": findings(spark, run_id, ids)}, root, at[:10], run_id)


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_run_that_was_cut_is_invisible(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, "r1", "2024-01-01 10:00:00", [1, 2])
    broken = findings(spark, "r1", [3]).withColumn("severity", F.raise_error(F.lit("the writer is gone")).cast("string"))
    for run_id in ("r1", "r2"):
        with pytest.raises(Exception, match="the writer is gone"):
            store.publish({"records": records(spark, run_id, "2024-01-02 10:00:00", [3]), "findings": broken}, root, "2024-01-01", run_id)
    assert sorted(r.file_id for r in store.published(spark, root, "records").collect()) == [1, 2]
    assert store.published(spark, root, "findings").count() == 4
    put(spark, root, "r1", "2024-01-01 11:00:00", [7])
    assert [r.file_id for r in store.published(spark, root, "records").collect()] == [7]
    assert store.published(spark, root, "findings").count() == 2
    assert store.vacuum(spark, root, ["records", "findings"]) == 0  # too young
    assert store.vacuum(spark, root, ["records", "findings"], older_than_s=-60) == 1
    assert [r.file_id for r in store.published(spark, root, "records").collect()] == [7] and store.commits(spark, root).count() == 1


def test_names_of_runs_stay_text(spark, tmp_path):
    names = ["007", "7", "1e5", "a/b=c %41", "2024-01-01"]
    for i, name in enumerate(names):
        put(spark, str(tmp_path), name, "2024-01-01 10:00:00", [i])
    rows = store.published(spark, str(tmp_path), "records").collect()
    assert {r.run_id: r.file_id for r in rows} == dict(zip(names, range(5), strict=True)) and {r.run_date for r in rows} == {"2024-01-01"}


def test_a_run_without_rows(spark, tmp_path):
    put(spark, str(tmp_path), "r1", "2024-01-01 10:00:00", [])
    assert store.published(spark, str(tmp_path), "records").count() == 0 and store.stored_runs(spark, str(tmp_path)).count() == 1
    assert store.stored_latest_findings(spark, str(tmp_path)).count() == 0 and store.stored_recent_runs(spark, str(tmp_path)).count() == 0


def test_latest_goes_by_time_and_number(spark):
    rows = records(spark, "r-9", "2024-01-02 00:00:00", [9, 10]).unionByName(records(spark, "r-10", "2024-01-01 00:00:00", [50]))
    got = history.latest_run_findings(rows, findings(spark, "r-9", [9, 10]).unionByName(findings(spark, "r-10", [50]))).collect()
    assert [(r.record_id, r.severity) for r in got] == [("r-9/10", "CRITICAL"), ("r-9/10", "LOW")]
    untimed = history.latest_run_findings(rows.drop("analysed_at"), findings(spark, "r-9", [9, 10]).unionByName(findings(spark, "r-10", [50])))
    assert {r.record_id for r in untimed.collect()} == {"r-10/50"}


def test_history_opens_the_runs_it_needs(spark, tmp_path):
    root = str(tmp_path)
    for day in range(1, 10):
        put(spark, root, f"run-{day}", f"2024-01-0{day} 10:00:00", list(range(day, day + 10)))
    recent = store.stored_recent_runs(spark, root, 15)
    assert [r.record_id for r in recent.collect()] == [
        *[f"run-9/{i}" for i in sorted(range(9, 19), key=str, reverse=True)], *[f"run-8/{i}" for i in sorted(range(8, 18), key=str, reverse=True)][:5]]
    latest = store.stored_latest_findings(spark, root)
    assert [(r.record_id, r.severity) for r in latest.collect()] == [("run-9/18", "CRITICAL"), ("run-9/18", "LOW")]
    of_file = store.stored_runs_for_file(spark, root, "F9.java", since="2024-01-05")
    assert [r.run_id for r in of_file.collect()] == [f"run-{d}" for d in (9, 8, 7, 6, 5)]
    for rows, most in ((recent, 20), (latest, 20), (of_file, 50)):  # of 90 records and 180 findings
        plan = plan_of(rows)
        assert re.search(r"PartitionFilters: \[[^]]*run_date", plan), plan
        assert 0 < rows_read(rows) <= most


def rows_read(rows) -> int:
    """Rows that the scans of the data folders gave, from the plan's own counters."""
    total, todo = 0, [rows._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name.startswith("Scan parquet") and "run_date" in node.relation().partitionSchema().simpleString():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


JAVA = "class A {{ String apiKey = \"abcd1234{}\"; int m() {{ return 1; }} }}"


def arriving(spark, tmp_path, name: str, ids: list[int]):
    folder = tmp_path / name
    spark.createDataFrame([(i, f"F{i}.java", JAVA.format(i)) for i in ids], "file_id bigint, file_name string, src string").withColumn(
        "size_bytes", F.octet_length("src")).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema("file_id bigint, file_name string, src string, size_bytes int").parquet(str(folder))


def test_two_streams_share_a_sink(spark, tmp_path):
    sink, root = str(tmp_path / "sink"), spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    for name, ids in (("a", [1, 2, 3]), ("b", [4, 5])):
        jobs.stream_scan(arriving(spark, tmp_path, name, ids), sink, str(tmp_path / f"checkpoint-{name}")).awaitTermination()
    rows = store.published(spark, sink, "records").collect()
    assert sorted(r.file_id for r in rows) == [1, 2, 3, 4, 5] and len({r.run_id for r in rows}) == 2
    assert store.published(spark, sink, "findings").count() == 5 and store.published(spark, sink, "rejected").count() == 0
    assert set(os.listdir(root)) == before  # no stage stays behind
    # the first query goes on, with new files only
    jobs.stream_scan(arriving(spark, tmp_path, "a", [6]), sink, str(tmp_path / "checkpoint-a")).awaitTermination()
    rows = store.published(spark, sink, "records").collect()
    assert sorted(r.file_id for r in rows) == [1, 2, 3, 4, 5, 6] and len({r.run_id.rsplit("-", 1)[0] for r in rows}) == 2


def test_a_committed_batch_is_not_run_again(spark, tmp_path):
    sink, checkpoint = str(tmp_path / "sink"), tmp_path / "checkpoint"
    jobs.stream_scan(arriving(spark, tmp_path, "a", [1]), sink, str(checkpoint)).awaitTermination()
    first = store.commits(spark, sink).first()
    for path in (checkpoint / "commits").iterdir():  # as if the driver died between the batch's commit and the query's
        path.unlink()
    jobs.stream_scan(spark.readStream.schema("file_id bigint, file_name string, src string, size_bytes int").parquet(str(tmp_path / "a")),
                     sink, str(checkpoint)).awaitTermination()
    assert store.commits(spark, sink).collect() == [first]
    assert store.published(spark, sink, "records").count() == 1
