"""Structured Streaming jobs: files that arrive over time."""

from __future__ import annotations

from datetime import UTC, datetime
from threading import Event

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.functions import constants as K
from riskweave.plans.analysis import analyse_uploads
from riskweave.plans.stage import stages_removed
from riskweave.sources.store import has_run, publish

SALTS = 32


def stream_scan(files: DataFrame, sink: str, checkpoint: str, max_bytes: int = K.MAX_FILE_BYTES,
                max_snippets: int | None = None, max_chars: int | None = None, run_date: str | None = None) -> StreamingQuery:
    """Analyse every batch of arriving files; records, findings and rejected files are published to ``sink``.

    The windows of the analysis need whole files, not a whole stream, so each
    micro-batch runs the batch plan. A batch is one run, named after the query and the
    batch's number, and its tables are committed together (``sources.store``). The query's
    id lives in its checkpoint: a restarted query goes on with its own runs, a batch that
    was committed already is not run again, and any number of queries share a sink.
    Intermediate stages of a batch are deleted when it is committed.
    """
    begun = Event()
    name: list[str] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        begun.wait()
        spark, run_id = batch.sparkSession, f"{name[0]}-{batch_id}"
        if has_run(spark, sink, run_id):
            return
        day = run_date or datetime.now(UTC).date().isoformat()
        with stages_removed(spark):
            result, rejected = analyse_uploads(
                batch, analysed_at=F.current_timestamp(), run_id=run_id, max_bytes=max_bytes, max_snippets=max_snippets, max_chars=max_chars)
            publish({"records": result.records, "findings": result.findings, "rejected": rejected}, sink, day, run_id)

    query = (files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    name.append(str(query.id))
    begun.set()
    return query


def stream_reupload(files: DataFrame, time: str, delay: str, content: str = "src") -> DataFrame:
    """Arriving files, with checksum and size, each content once within the watermark.

    Copies are dropped per salted checksum first, so the copies of one frequent
    file are spread over tasks and at most ``SALTS`` of them meet afterwards.
    """
    sums = files.withWatermark(time, delay).select(
        "*", F.sha2(F.col(content).cast("binary"), 256).alias("checksum_sha256"),
        F.octet_length(F.col(content).cast("binary")).cast("int").alias("file_size_bytes"),
        F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).alias("salt"))
    return (
        sums.dropDuplicatesWithinWatermark(["checksum_sha256", "salt"])
        .dropDuplicatesWithinWatermark(["checksum_sha256"])
        .drop("salt")
    )


def stream_status(runs: DataFrame, width: str, delay: str, time: str = "analysed_at") -> DataFrame:
    """Per tumbling window: runs, degraded runs and their share; late rows are dropped.

    In append mode a window comes out when the watermark has passed its end; windows
    that are still open are withheld.
    """
    degraded = F.count(F.when(F.col("ai_engine_status") == "DEGRADED", 1))
    return (
        runs.withWatermark(time, delay).groupBy(F.window(time, width))
        .agg(F.count("*").alias("n_runs"), degraded.alias("n_degraded"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "n_runs", "n_degraded", F.round(F.col("n_degraded") / F.col("n_runs"), 6).alias("degraded_share"))
    )


def run_to_parquet(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available now and write it to Parquet."""
    query = (stream.writeStream.format("parquet").option("path", sink).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
