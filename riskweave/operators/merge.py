"""Merge of structural findings and scored snippets: each issue reported once.

A scored snippet and a finding are one issue when file and type agree (ignoring
case) and the finding's line lies within the snippet.  The first such finding
in list order is upgraded; a snippet without one is appended.  Appended
findings take part for later snippets, which matters for nested methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.columns import has_finding, severity_weight, truncate
from riskweave.operators.catalog import banded_severity, catalog_lookup

FINDING_COLUMNS = [
    "file_id", "list_seq", "vulnerability_type", "display_name", "severity", "category", "owasp_category",
    "method_name", "line_number", "code_snippet", "description", "remediation", "confidence", "detection_source",
]


def scored_hits(scored: DataFrame) -> DataFrame:
    """Scored snippets that report a finding, with the key used for matching."""
    return scored.where(has_finding(F.col("vulnerability_type"))).withColumn(
        "type_key", F.lower("vulnerability_type"))


def corroborations(static: DataFrame, hits: DataFrame) -> DataFrame:
    """(file_id, method_seq, target_seq): the first structural finding each hit agrees with.

    A sweep instead of a join of findings with hits. The findings of a file and type are
    numbered by line, so a hit's line range is a range of numbers, found by one sort of
    findings and range borders. The least ``list_seq`` of a range comes from blocks of 1, 2,
    4, ... findings: each finding is in one block per length and a range is made of two
    blocks per length at most. Work is n log n in the findings and hits of a file, whatever
    their lines; all of it keeps the one exchange by file.
    """
    places = static.select("file_id", F.lower("vulnerability_type").alias("type_key"), F.col("list_seq").alias("seq"), F.lit(1).alias("finding"),
                           F.expr("array(struct(line_number as at, 1 as turn))").alias("events"))
    ranges = hits.where("start_line <= end_line").select("file_id", "type_key", F.col("method_seq").alias("seq"), F.lit(0).alias("finding"),
                         F.expr("array(struct(start_line as at, 0 as turn), struct(end_line as at, 2 as turn))").alias("events"))
    group = "partition by file_id, type_key"
    numbered = places.unionByName(ranges).repartition("file_id").selectExpr("file_id", "type_key", "seq", "finding", "inline(events)").selectExpr(
        "file_id", "type_key", "seq", "finding",
        f"sum(finding) over ({group} order by at, turn rows between unbounded preceding and current row) as upto",
        f"sum(finding) over ({group}) as held")
    # a finding's number is upto - 1; a hit's range ends before the larger upto of its borders
    spans = numbered.where("held > 0").groupBy("file_id", "type_key", "finding", "seq", "held").agg(F.min("upto").alias("low"), F.max("upto").alias("high"))
    own = "array(struct(n, shiftright(low - 1, n) as block))"
    first, end = "int(ceil(low / shiftleft(1, n)))", "shiftright(high, n)"
    covering = (f"if({first} < {end}, array_compact(array(if({first} % 2 = 1, struct(n, bigint({first}) as block), null),"
                f" if({end} % 2 = 1, struct(n, {end} - 1 as block), null))), array())")
    lengths = "sequence(0, int(floor(log2(held))))"
    blocks = spans.where("finding = 1 or low < high").selectExpr(
        "file_id", "type_key", "finding", "seq",
        f"inline(flatten(transform({lengths}, n -> if(finding = 1, {own}, {covering}))))")
    least = f"min(if(finding = 1, seq, null)) over ({group}, n, block)"
    return (
        blocks.selectExpr("file_id", "finding", "seq", f"{least} as least").where("finding = 0 and least is not null")
        .groupBy("file_id", F.col("seq").alias("method_seq")).agg(F.min("least").alias("target_seq"))
    )


def appended_findings(hits: DataFrame) -> DataFrame:
    """Hits as findings of their own: line = snippet start, catalog band for known types."""
    known = catalog_lookup(
        hits.withColumnRenamed("owasp_category", "score_owasp"), "vulnerability_type")
    return known.select(
        "file_id", "method_seq", "vulnerability_type", "display_name",
        banded_severity(F.col("is_known"), F.col("severity"), F.col("severity_score")).alias("severity"),
        "category", F.coalesce("score_owasp", "owasp_category").alias("owasp_category"),
        "method_name", F.col("start_line").alias("line_number"), truncate(F.col("code")).alias("code_snippet"),
        F.col("issue_description").alias("description"), F.col("suggested_fix").alias("remediation"),
        "confidence", F.lit("AI").alias("detection_source"),
    )


def merge_nested_hits(hits: DataFrame) -> DataFrame:
    """Decide for hits without a structural match who is appended and who agrees with whom.

    Adds ``is_appended`` and ``absorbed_by`` (method_seq of the appended hit).
    Inner methods come first, so an earlier hit ends no later than this one and
    lies inside of it exactly if the latest start so far is not before its start.
    Appended hits lie side by side, in the order of their lines: the first one
    inside is the first appended one that starts at or behind this start. Both are running
    extrema, from the front and from the back.
    """
    same = Window.partitionBy("file_id", "type_key")
    before = same.orderBy("method_seq").rowsBetween(Window.unboundedPreceding, -1)
    behind = same.orderBy(F.desc("start_line")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.coalesce(F.max("start_line").over(before), F.lit(-1))
    rows = hits.withColumn("is_appended", latest < F.col("start_line"))
    inside = F.min(F.when(F.col("is_appended"), F.col("method_seq"))).over(behind)
    return rows.withColumn("absorbed_by", F.when(~F.col("is_appended"), inside))


def merge_ai_only(static: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that agree with no structural finding of their file."""
    return hits.join(corroborations(static, hits), ["file_id", "method_seq"], "left_anti")


def upgraded(findings: DataFrame, agreements: DataFrame, key_cols: list[str]) -> DataFrame:
    """Findings with a larger confidence and joint attribution where a hit agreed."""
    best = agreements.groupBy(*key_cols).agg(F.max("confidence").alias("hit_confidence"))
    agreed = F.col("hit_confidence").isNotNull()
    return (
        findings.join(best, key_cols, "left")
        .withColumn("confidence", F.greatest("confidence", "hit_confidence"))
        .withColumn("detection_source", F.when(agreed, F.lit("STATIC+AI")).otherwise(F.col("detection_source")))
        .drop("hit_confidence")
    )


def merge_corroborate(static: DataFrame, hits: DataFrame) -> DataFrame:
    """Structural findings after the hits that agree with them have been folded in."""
    agreements = (
        hits.select("file_id", "method_seq", "confidence")
        .join(corroborations(static, hits), ["file_id", "method_seq"])
        .select("file_id", F.col("target_seq").alias("list_seq"), "confidence")
    )
    return upgraded(static, agreements, ["file_id", "list_seq"])


def merge_order(findings: DataFrame) -> DataFrame:
    """Add display_seq: heaviest first, then by line, ties in list order."""
    in_file = Window.partitionBy("file_id").orderBy(
        F.desc(severity_weight(F.col("severity"))), F.coalesce("line_number", F.lit(0)), "list_seq")
    return findings.withColumn("display_seq", F.row_number().over(in_file))


def merged_findings(static: DataFrame, scored: DataFrame) -> DataFrame:
    """All findings of every file, ordered for display.

    ``scored`` is the output of ``attach_scores``: snippet columns plus score columns.
    """
    hits = scored_hits(scored)
    corroborated = merge_corroborate(static, hits).select(*FINDING_COLUMNS)

    left = merge_nested_hits(merge_ai_only(static, hits))
    agreements = left.where(F.col("absorbed_by").isNotNull()).select(
        "file_id", F.col("absorbed_by").alias("method_seq"), "confidence")
    appended = upgraded(appended_findings(left.where("is_appended")), agreements, ["file_id", "method_seq"])
    # structural findings come first in the list, appended ones follow in snippet order
    both = (corroborated.withColumn("part", F.lit(0))
            .unionByName(appended.withColumn("list_seq", F.col("method_seq"))
                         .select(*FINDING_COLUMNS, F.lit(1).alias("part"))))
    in_list = Window.partitionBy("file_id").orderBy("part", "list_seq")
    return merge_order(both.withColumn("list_seq", F.row_number().over(in_list)).drop("part"))
