"""History and report queries over stored runs and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions.columns import percent


def _newest_first(runs: DataFrame, time: str, key: str) -> list[Column]:
    return [F.desc(time), F.desc(key)]


def recent_runs(runs: DataFrame, n: int = K.HISTORY_SIZE, time: str = "analysed_at",
                key: str = "record_id") -> DataFrame:
    """The newest n runs; each task keeps its own n before they are merged."""
    return runs.orderBy(*_newest_first(runs, time, key)).limit(n)


def runs_for_file(runs: DataFrame, file_name: str, time: str = "analysed_at", key: str = "record_id") -> DataFrame:
    return runs.where(F.col("file_name") == file_name).orderBy(*_newest_first(runs, time, key))


def runs_overview(runs: DataFrame, time: str = "analysed_at", key: str = "record_id") -> DataFrame:
    return runs.select(
        key, "file_name", "total_findings", "risk_score", "ai_engine_status", time,
    ).orderBy(*_newest_first(runs, time, key))


def findings_for_record(findings: DataFrame, record: int | Column, key: str = "file_id") -> DataFrame:
    return findings.where(F.col(key) == record)


def nested_findings(findings: DataFrame, key: str = "file_id") -> DataFrame:
    """One array of findings per record, in display order.

    The findings of one record come from one file, whose size the gate bounds.
    """
    item = F.struct("display_seq", "vulnerability_type", "severity", "line_number", "method_name",
                    "confidence", "detection_source")
    return findings.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("findings"))


def record_with_findings(records: DataFrame, findings: DataFrame, record: int | str | None = None,
                         key: str = "file_id") -> DataFrame:
    """Records with their nested findings; an unknown id gives no row, a clean file an empty array."""
    if record is not None:
        records, findings = records.where(F.col(key) == record), findings.where(F.col(key) == record)
    joined = records.join(nested_findings(findings, key), key, "left")
    empty = F.array().cast(joined.schema["findings"].dataType)
    return joined.withColumn("findings", F.coalesce("findings", empty))


def latest_run_findings(records: DataFrame, findings: DataFrame, key: str = "record_id", time: str = "analysed_at",
                        file: str = "file_id") -> DataFrame:
    """Findings of the newest record, ordered by severity as text.

    The newest is the one with the latest time; records of one time, or of no time, go by
    their file id, which is a number where the files have numbers, and then by their own id.
    An id as text says nothing about which record is newer.
    """
    order = F.struct(*[F.col(name) for name in dict.fromkeys([time, file, key]) if name in records.columns])
    latest = records.agg(F.max_by(key, order)).scalar()
    return findings.where(F.col(key) == latest).orderBy("severity")


def severity_css(severity: Column) -> Column:
    css = F.when(F.lit(False), "")
    for band, name in K.SEVERITY_CSS.items():
        css = css.when(severity == band, name)
    return css.otherwise(K.SEVERITY_CSS["LOW"])


def service_label(reachable: Column, model_loaded: Column) -> Column:
    return F.when(~reachable, "DEGRADED").when(model_loaded, "ONLINE").otherwise("ONLINE (rule-only)")


def service_css(reachable: Column, model_loaded: Column) -> Column:
    css = K.STATUS_CSS
    return F.when(~reachable, css["DEGRADED"]).when(model_loaded, css["ONLINE"]).otherwise(css["PARTIAL"])


def run_banner(status: Column) -> Column:
    """Label of a stored run: scoring worked at the time, or it did not."""
    worked = F.coalesce(status != "DEGRADED", F.lit(True))
    return service_label(worked, F.lit(True))


def report_findings(findings: DataFrame) -> DataFrame:
    """Findings with the columns a report shows."""
    return findings.withColumn("confidence_percent", percent(F.col("confidence"))).withColumn(
        "severity_css", severity_css(F.col("severity")))


def report_runs(runs: DataFrame, time: str = "analysed_at") -> DataFrame:
    """Runs with the columns the history list shows."""
    degraded = F.coalesce(F.col("ai_engine_status") == "DEGRADED", F.lit(False))
    critical = F.when(F.col("critical_count") > 0, F.concat(F.col("critical_count").cast("string"), F.lit(" critical")))
    return (
        runs.withColumn("when_short", F.date_format(time, "dd MMM HH:mm"))
        .withColumn("when_long", F.date_format(time, "dd MMM yyyy, HH:mm"))
        .withColumn("critical_badge", critical)
        .withColumn("status_css", F.when(degraded, K.STATUS_CSS["DEGRADED"]).otherwise(K.STATUS_CSS["ONLINE"]))
        .withColumn("banner", run_banner(F.col("ai_engine_status")))
    )
