"""Per-file roll-ups of findings and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions.columns import severity_weight

COUNT_COLUMNS = {"critical_count": "CRITICAL", "high_count": "HIGH", "medium_count": "MEDIUM", "low_count": "LOW"}


def _band_counts() -> list[Column]:
    return [F.count("severity").cast("int").alias("total_findings"), *[
        F.count(F.when(F.col("severity") == band, 1)).cast("int").alias(name)
        for name, band in COUNT_COLUMNS.items()]]


def _risk() -> Column:
    weights = F.sum(F.when(F.col("severity").isNotNull(), severity_weight(F.col("severity"))))
    return F.least(F.coalesce(weights, F.lit(0)), F.lit(K.MAX_RISK)).cast("int").alias("risk_score")


def severity_counts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """total_findings and the four band counts of every file; clean files count zero."""
    rows = files.select("file_id").join(findings.select("file_id", "severity"), "file_id", "left")
    return rows.groupBy("file_id").agg(*_band_counts())


def risk_score(findings: DataFrame, files: DataFrame) -> DataFrame:
    rows = files.select("file_id").join(findings.select("file_id", "severity"), "file_id", "left")
    return rows.groupBy("file_id").agg(_risk())


def finding_summary(findings: DataFrame) -> DataFrame:
    """Counts and risk of the files that have findings, in one aggregation."""
    return findings.groupBy("file_id").agg(*_band_counts(), _risk())


def run_status(scored: DataFrame, files: DataFrame) -> DataFrame:
    """DEGRADED when snippets were scored and every one fell back, else SUCCESS."""
    return files.select("file_id").join(_degraded(scored), "file_id", "left").select(
        "file_id", F.coalesce("ai_engine_status", F.lit("SUCCESS")).alias("ai_engine_status"))


def _degraded(scored: DataFrame) -> DataFrame:
    return scored.groupBy("file_id").agg(
        F.when(F.every("fallback"), "DEGRADED").otherwise("SUCCESS").alias("ai_engine_status"))


def methods_analysed(methods: DataFrame, files: DataFrame) -> DataFrame:
    counts = methods.groupBy("file_id").agg(F.count("*").cast("int").alias("methods_analysed"))
    return files.select("file_id").join(counts, "file_id", "left").select(
        "file_id", F.coalesce("methods_analysed", F.lit(0)).alias("methods_analysed"))


def count_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n_findings"))


def runs_by_status(records: DataFrame, status: str = "ai_engine_status") -> DataFrame:
    return records.groupBy(status).agg(F.count("*").alias("n_runs"))


def scored_summary(scored: DataFrame) -> DataFrame:
    """Status and number of scored snippets of the files that have some, in one aggregation."""
    return scored.groupBy("file_id").agg(
        F.when(F.every("fallback"), "DEGRADED").otherwise("SUCCESS").alias("ai_engine_status"),
        F.count("*").cast("int").alias("methods_scored"))


def analysis_records(files: DataFrame, findings: DataFrame, scored: DataFrame, method_counts: DataFrame) -> DataFrame:
    """One row per analysed file.

    ``files``: file_id, file_name, file_size_bytes, checksum_sha256 of the files
    whose structure holds.  All parts are keyed by file_id, one row per file.
    """
    zero = ["total_findings", *COUNT_COLUMNS, "risk_score", "methods_analysed", "methods_scored"]
    joined = (
        files.join(finding_summary(findings), "file_id", "left")
        .join(method_counts, "file_id", "left")
        .join(scored_summary(scored), "file_id", "left")
    )
    return joined.select(
        "file_id", "file_name", "file_size_bytes", "checksum_sha256",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in zero],
        F.coalesce("ai_engine_status", F.lit("SUCCESS")).alias("ai_engine_status"),
        F.lit(K.ENGINE_VERSION).alias("engine_version"),
    )
