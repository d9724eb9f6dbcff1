"""The merge against a plain loop over lists, on random small inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskweave.operators import merge

TYPES = ["SQL_INJECTION", "RESOURCE_LEAK", "MADE_UP"]
BAND = {"SQL_INJECTION": "CRITICAL", "RESOURCE_LEAK": "MEDIUM"}
WEIGHT = {"CRITICAL": 10, "HIGH": 6, "MEDIUM": 3, "LOW": 1}


def nested_ranges(pick: random.Random, low: int, high: int) -> list[tuple[int, int]]:
    """Line ranges that nest, inner ones first."""
    ranges, at = [], low
    while at < high and len(ranges) < 6:
        end = pick.randint(at, high)
        if pick.random() < 0.5 and end > at:
            ranges += nested_ranges(pick, at + 1, end)
        ranges.append((at, end))
        at = end + 1
    return ranges


def by_loop(static: list[dict], hits: list[dict]) -> list[tuple]:
    merged = [dict(s) for s in static]
    for hit in hits:
        if hit["type"].upper() == "NONE":
            continue
        same = [f for f in merged if f["type"].lower() == hit["type"].lower() and hit["start"] <= f["line"] <= hit["end"]]
        if same:
            same[0]["source"] = "STATIC+AI"
            same[0]["conf"] = max(same[0]["conf"], hit["conf"])
        else:
            score = hit["score"]
            band = BAND.get(hit["type"].upper()) or (
                "CRITICAL" if score >= 8 else "HIGH" if score >= 6 else "MEDIUM" if score >= 3 else "LOW")
            merged.append({"type": hit["type"], "line": hit["start"], "conf": hit["conf"], "source": "AI", "severity": band})
    order = sorted(merged, key=lambda f: (-WEIGHT[f["severity"]], f["line"]))
    return [(f["type"], f["line"], f["conf"], f["source"], f["severity"]) for f in order]


def test_merge_equals_the_loop(spark):
    pick = random.Random(3)
    static_rows, scored_rows, expected = [], [], {}
    for file_id in range(300):
        static, hits = [], []
        for seq in range(1, pick.randint(1, 6)):
            kind = pick.choice(TYPES[:2])
            static.append({"type": kind, "line": pick.randint(1, 20), "conf": 0.7, "source": "STATIC", "severity": BAND[kind]})
            static_rows.append((file_id, seq, kind, "n", BAND[kind], "c", None, "m", static[-1]["line"], "s", "d", "r", 0.7, "STATIC"))
        for seq, (start, end) in enumerate(nested_ranges(pick, 1, 20)[:25], 1):
            kind = pick.choice([*TYPES, "sql_injection", "NONE"])
            hit = {"type": kind, "start": start, "end": end, "conf": pick.choice([0.5, 0.8, 0.95]), "score": pick.choice([2.0, 4.0, 7.0, 9.0])}
            hits.append(hit)
            scored_rows.append((file_id, seq, "m", "code", start, end, kind, hit["score"], "d", "f", None, hit["conf"]))
        expected[file_id] = by_loop(static, hits)
    static = spark.createDataFrame(
        static_rows, "file_id bigint, list_seq int, vulnerability_type string, display_name string, severity string,"
        "category string, owasp_category string, method_name string, line_number int, code_snippet string,"
        "description string, remediation string, confidence double, detection_source string")
    scored = spark.createDataFrame(
        scored_rows, "file_id bigint, method_seq int, method_name string, code string, start_line int, end_line int,"
        "vulnerability_type string, severity_score double, issue_description string, suggested_fix string,"
        "owasp_category string, confidence double")
    got: dict[int, list[tuple]] = {}
    for r in merge.merged_findings(static, scored).orderBy("file_id", "display_seq").collect():
        got.setdefault(r.file_id, []).append(
            (r.vulnerability_type, r.line_number, r.confidence, r.detection_source, r.severity))
    assert {k: v for k, v in expected.items() if v} == got


def test_first_finding_of_any_line_range(spark):
    pick = random.Random(9)
    static, hits, expected = [], [], set()
    for file_id in range(40):
        findings = [(seq, pick.choice("AB"), pick.choice([None, *range(1, 60)])) for seq in range(1, pick.randint(1, 80))]
        static += [(file_id, *f) for f in findings]
        for seq in range(1, 40):
            start, end, kind = pick.randint(1, 60), pick.randint(1, 60), pick.choice("ABC")  # ranges cross each other, some are empty
            hits.append((file_id, seq, kind.lower(), start, end))
            inside = [n for n, k, line in findings if k == kind and line is not None and start <= line <= end]
            if inside:
                expected.add((file_id, seq, min(inside)))
    got = merge.corroborations(
        spark.createDataFrame(static, "file_id bigint, list_seq int, vulnerability_type string, line_number int"),
        spark.createDataFrame(hits, "file_id bigint, method_seq int, type_key string, start_line int, end_line int"))
    assert len(expected) > 400 and {tuple(r) for r in got.collect()} == expected


def test_many_methods_in_one_file_are_no_product(spark):
    n = 20_000
    numbers = spark.range(1, n + 1).select(F.lit(1).cast("bigint").alias("file_id"), F.col("id").cast("int").alias("i"))
    static = numbers.selectExpr("file_id", "i as list_seq", "'SQL_INJECTION' as vulnerability_type", "3 * i as line_number")
    hits = numbers.selectExpr("file_id", "i as method_seq", "'sql_injection' as type_key", "3 * i - 1 as start_line", "3 * i + 1 as end_line")
    got = merge.corroborations(static, hits)
    assert got.where("method_seq = target_seq").count() == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    alone = merge.merge_nested_hits(hits)  # and as many without a finding
    assert alone.where("is_appended").count() == n
