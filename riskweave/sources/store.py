"""Published results: the tables of a run become visible together.

Every attempt to write a run has folders of its own, one per table, below
``<table>/run_date=.../run_id=.../attempt=...``. The last thing an attempt writes is one row in
``commits``, which names it. Readers take the newest committed attempt of each run and
nothing else, so a run that was cut between two tables does not exist for them, a repeated
run replaces its own rows only, and readers of the old attempt are not disturbed.

The commits also say how many rows a run has and from when to when its records are, so
history queries open the folders of the runs they need and no others.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import constants as K
from riskweave.operators import history
from riskweave.plans.stage import remove

RUN = ["run_date", "run_id", "attempt"]
COMMIT_SCHEMA = ("run_date string, run_id string, committed_at bigint, counts map<string, bigint>,"
                 " first_at timestamp_ntz, last_at timestamp_ntz, attempt string")


def attempt_folder(root: str, name: str, run_date: str, run_id: str, attempt: str) -> str:
    """Where an attempt writes a table."""
    parts = "/".join(f"{key}={quote(value, safe='')}" for key, value in zip(RUN, (run_date, run_id, attempt), strict=True))
    return f"{root}/{name}/{parts}"


def publish(tables: dict[str, DataFrame], root: str, run_date: str, run_id: str, when: str = "analysed_at") -> str:
    """Write all tables of a run, then commit them; returns the attempt.

    Rows are counted while they are written. ``when``: the column of ``records`` that says when.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    counts, span = {}, (None, None)
    for name, rows in tables.items():
        seen, timed = Observation(), when in rows.columns
        bounds = [F.min(when).cast("timestamp_ntz").alias("first"), F.max(when).cast("timestamp_ntz").alias("last")] if timed else []
        own = rows.drop(*RUN).observe(seen, F.count(F.lit(1)).alias("n"), *bounds)
        own.write.mode("overwrite").parquet(attempt_folder(root, name, run_date, run_id, attempt))
        counts[name] = seen.get["n"]
        if timed and name == "records":
            span = (seen.get["first"], seen.get["last"])
    row = (run_date, run_id, time.time_ns() // 1000, counts, *span, attempt)
    commit = spark.createDataFrame([row], COMMIT_SCHEMA).drop("attempt").coalesce(1)
    commit.write.mode("overwrite").parquet(f"{root}/commits/attempt={attempt}")
    return attempt


def commits(spark: SparkSession, root: str) -> DataFrame:
    """All committed attempts."""
    return spark.read.schema(COMMIT_SCHEMA).parquet(f"{root}/commits")


def has_run(spark: SparkSession, root: str, run_id: str) -> bool:
    """Has the run been committed? A store that does not exist yet has no runs."""
    try:
        return not commits(spark, root).where(F.col("run_id") == run_id).isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def stored_runs(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed attempt of each run, with its numbers of rows and its span of time."""
    newest = F.max_by(F.struct("committed_at", "counts", "first_at", "last_at", "attempt"), F.struct("committed_at", "attempt"))
    return commits(spark, root).groupBy("run_date", "run_id").agg(newest.alias("c")).select("run_date", "run_id", "c.*")


def _attempts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of all attempts, committed or not; what names a run is text, whatever it looks like."""
    path = f"{root}/{name}"
    columns = [field for field in spark.read.parquet(path).schema if field.name not in RUN]
    return spark.read.schema(T.StructType([*columns, *[T.StructField(c, T.StringType()) for c in RUN]])).parquet(path)


def published(spark: SparkSession, root: str, name: str, runs: DataFrame | None = None) -> DataFrame:
    """Rows of a table of the committed runs, or of ``runs`` among them.

    The runs reach the scan as a filter on its partitions: folders of other runs and of
    attempts that were replaced or never committed are not opened.
    """
    runs = (stored_runs(spark, root) if runs is None else runs).where("committed_at > 0")
    return _attempts(spark, root, name).join(runs.select(*RUN), RUN, "left_semi").drop("attempt")


def vacuum(spark: SparkSession, root: str, names: list[str], older_than_s: float = 86_400) -> int:
    """Delete the folders of attempts that a later one replaced so long ago; returns their number."""
    known, live = commits(spark, root), stored_runs(spark, root)
    replaced = known.join(live.select("run_date", "run_id", F.col("committed_at").alias("since")), ["run_date", "run_id"]).where(
        (F.col("committed_at") < F.col("since")) & (F.col("since") < (time.time_ns() // 1000) - int(older_than_s * 1e6)))
    gone = replaced.select(*RUN).collect()  # a row per replaced attempt
    for row in gone:
        for name in names:
            remove(spark, attempt_folder(root, name, *row))
        remove(spark, f"{root}/commits/attempt={row.attempt}")
    return len(gone)


# --- history ----------------------------------------------------------------

def stored_recent_runs(spark: SparkSession, root: str, n: int = K.HISTORY_SIZE) -> DataFrame:
    """The newest n records of all runs.

    Runs that are sure to hold n records, newest first, bound the time from which on
    records can be among the newest; runs that ended before are not opened.
    """
    runs = stored_runs(spark, root)
    older = runs.selectExpr("first_at", "sum(counts['records']) over (order by first_at desc) as held")  # a row per run
    bound = older.where(F.col("held") >= n).agg(F.max("first_at")).scalar()
    needed = runs.where(F.coalesce(F.col("last_at") >= bound, F.lit(True)))
    return history.recent_runs(published(spark, root, "records", needed), n)


def stored_runs_for_file(spark: SparkSession, root: str, file_name: str, since: str | None = None) -> DataFrame:
    """All records of a file, newest first; with ``since`` only runs of that date and later are opened."""
    runs = stored_runs(spark, root)
    return history.runs_for_file(published(spark, root, "records", runs if since is None else runs.where(F.col("run_date") >= since)), file_name)


def stored_latest_findings(spark: SparkSession, root: str) -> DataFrame:
    """Findings of the newest record, ordered by severity as text; two folders are opened."""
    runs = stored_runs(spark, root).where("counts['records'] > 0")
    latest = runs.agg(F.max_by(F.struct(*RUN), F.struct("last_at", "committed_at", "attempt")).alias("run"))

    def of_latest(name: str) -> DataFrame:
        rows = _attempts(spark, root, name)
        for column in RUN:
            rows = rows.where(F.col(column) == latest.select(f"run.{column}").scalar())
        return rows.drop("attempt")

    return history.latest_run_findings(of_latest("records"), of_latest("findings"))

