"""Constraints of the result tables as a data-quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import constants as K

# Longest text allowed per column
RECORD_LENGTHS = {"file_name": 255, "checksum_sha256": 64, "ai_engine_status": 20, "engine_version": 50}
FINDING_LENGTHS = {
    "vulnerability_type": 100, "display_name": 120, "severity": 20, "category": 30, "owasp_category": 80,
    "file_name": 255, "method_name": 150, "code_snippet": 4000, "description": 2000, "remediation": 4000,
    "detection_source": 20,
}
RECORD_REQUIRED = [
    "file_name", "file_size_bytes", "checksum_sha256", "total_findings", "critical_count", "high_count",
    "medium_count", "low_count", "risk_score", "methods_analysed", "ai_engine_status", "analysed_at",
]
FINDING_REQUIRED = [
    "vulnerability_type", "display_name", "severity", "category", "description", "confidence", "detection_source",
]


def _length_and_null_checks(prefix: str, lengths: dict[str, int], required: list[str],
                            columns: list[str]) -> dict[str, Column]:
    checks = {f"{prefix}.{name}.required": F.col(name).isNull() for name in required if name in columns}
    checks |= {f"{prefix}.{name}.length": F.length(name) > limit for name, limit in lengths.items() if name in columns}
    return checks


def record_checks(columns: list[str]) -> dict[str, Column]:
    """Rule -> condition that marks a violating record; null values pass range and domain rules."""
    return {
        "record.ai_engine_status.domain": ~F.col("ai_engine_status").isin(K.STATUSES),
        "record.risk_score.range": ~F.col("risk_score").between(0, K.MAX_RISK),
        **_length_and_null_checks("record", RECORD_LENGTHS, RECORD_REQUIRED, columns),
    }


def finding_checks(columns: list[str]) -> dict[str, Column]:
    return {
        "finding.severity.domain": ~F.col("severity").isin(K.SEVERITIES),
        "finding.category.domain": ~F.col("category").isin(K.CATEGORIES),
        "finding.detection_source.domain": ~F.col("detection_source").isin(K.SOURCES),
        "finding.confidence.range": ~F.col("confidence").between(0.0, 1.0),
        **_length_and_null_checks("finding", FINDING_LENGTHS, FINDING_REQUIRED, columns),
    }


def _violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All conditions counted in one aggregation, then one row per rule."""
    names = list(checks)
    counted = rows.agg(*[F.count(F.when(checks[name], 1)).alias(f"c{i}") for i, name in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("n_violations"))
                      for i, name in enumerate(names)])
    return counted.select(F.inline(pairs))


def constraint_check(records: DataFrame, findings: DataFrame, key: str = "record_id") -> DataFrame:
    """(rule, n_violations) for domains, ranges, lengths, required columns and the foreign key."""
    orphans = findings.select(key).join(records.select(key), key, "left_anti").agg(
        F.lit("finding.record.foreign_key").alias("rule"), F.count("*").alias("n_violations"))
    return (
        _violations(records, record_checks(records.columns))
        .unionByName(_violations(findings, finding_checks(findings.columns)))
        .unionByName(orphans)
    )
