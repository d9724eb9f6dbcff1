"""Gates, dedup, sources, scoring and the contract of the entry module."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from riskweave.functions.columns import method_hint, sanitise_name
from riskweave.operators import dedup, gates, history, scoring, structure
from riskweave.operators.catalog import uncatalogued_signatures
from riskweave.operators.signatures import signature_scan
from riskweave.plans.analysis import analyse, analyse_uploads
from riskweave.sources.corpus import oversized_files, scan_corpus, write_results
from riskweave.sources.score_lines import refused_fields, scores_json_in, snippets_json_in
from tests.compare import connect, difference
from tests.conftest import SMALL


def test_gates(spark):
    cases = [
        ("Foo.java", b"public class Foo {}", None), ("notes.txt", b"hello", "NOT_JAVA"), ("Foo.java", b"", "EMPTY"),
        (" ", b"class A {}", "NO_NAME"), (None, b"class A {}", "NO_NAME"), ("../../x.java", b"class A {}", "PATH_CHARS"),
        ("a\\b.java", b"class A {}", "PATH_CHARS"), ("Foo.JAVA", b"enum E {}", None),
        ("Foo.java", b"class A { int a_long_name_here; int another_long_name; }", "TOO_LARGE"),
        ("Foo.java", bytes([0x50, 0x4B, 3, 4, 0, 0, 0]), "BINARY"), ("Foo.java", b"prose only", "NO_TYPE_DECL"),
        ("Foo.java", b"the subclass", None),
    ]
    files = spark.createDataFrame([(i, n, b, len(b)) for i, (n, b, _) in enumerate(cases)],
                                  "file_id bigint, file_name string, src binary, size_bytes int")
    rows = gates.gated(files, max_bytes=50).orderBy("file_id").collect()
    assert [r.reject_reason for r in rows] == [reason for _, _, reason in cases]


def test_nul_after_the_window_is_text(spark):
    files = spark.createDataFrame([(1, b"class " + b"x" * 1018 + b"\0"), (2, b"class " + b"x" * 1017 + b"\0")],
                                  "file_id bigint, src binary")
    got = {r.file_id: r.reject_reason for r in gates.gate_content(files).collect()}
    assert got == {1: None, 2: "BINARY"}


def test_sanitise(spark):
    row = spark.range(1).select(sanitise_name(F.lit("a\r\n<b>\t")).alias("a"), sanitise_name(F.lit("x" * 121)).alias("b"),
                                sanitise_name(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(row) == ("ab", "x" * 120 + "...", "")


def test_hints(spark):
    texts = ['run("select 1" + x)', 'run(\n"select 1" + x)', 'apiKey = "x"', "if (a) {} catch", "token"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(method_hint(F.col("t")).alias("h"))
    assert [r.h for r in df.collect()] == [
        "possible_sql_injection", None, "possible_hardcoded_secret", "possible_swallowed_exception", None]


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_dedup_does_not_depend_on_the_parts(spark, salts):
    files = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(60)], "file_id bigint, src string")
    got = {r.file_id: (r.n_copies, r.first_file, r.is_reupload) for r in
           dedup.reupload_dedup(files, salts=salts).collect()}
    texts = {r.file_id: r.src for r in files.collect()}
    for i, text in texts.items():
        copies = [j for j, other in texts.items() if other == text]
        assert got[i] == (len(copies), min(copies), i != min(copies))


def test_every_signature_type_is_catalogued(spark):
    assert uncatalogued_signatures(spark).count() == 0


def test_signature_cases(spark):
    cases = {
        'rs = stmt.executeQuery("SELECT * FROM u WHERE n = \'" + n + "\'");': {"SQL_INJECTION"},
        'String dbPassword = "SuperSecret123";': {"HARDCODED_SECRET"},
        'MessageDigest.getInstance("MD5")': {"WEAK_CRYPTOGRAPHY"}, 'MessageDigest.getInstance("SHA-256")': set(),
        'Runtime.getRuntime().exec("convert " + f);': {"COMMAND_INJECTION"},
        "try { r(); } catch (IOException e) {}": {"EMPTY_CATCH_BLOCK"},
        'for (String s : xs) { out += s + ","; }': {"STRING_CONCAT_IN_LOOP"}, "for (int v : vs) { sum += v; }": set(),
        "return a + b;": set(), "x.get().run()": {"NULL_POINTER_RISK"},
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id bigint, text string")
    found: dict[int, set] = {i: set() for i in range(len(cases))}
    for r in signature_scan(df, "text", ["id"]).collect():
        found[r.id].add(r.vulnerability_type)
    assert list(found.values()) == list(cases.values())


def test_binary_corpus_end_to_end(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "A.java").write_text('class A { String apiKey = "abcd1234"; int n() { return 1; } }')
    (tmp_path / "a" / "b" / "B.java").write_bytes(b"class B { /* \xff */ }")
    (tmp_path / "a" / "readme.txt").write_text("class")
    result, rejected = analyse_uploads(scan_corpus(spark, str(tmp_path / "a")),
                                       analysed_at=F.lit("2024-01-01 00:00:00"), run_id="r1")
    rows = {r.file_name: r for r in result.records.collect()}
    assert set(rows) == {"A.java", "B.java"}
    assert (rows["A.java"].high_count, rows["A.java"].risk_score, rows["A.java"].methods_analysed) == (1, 6, 1)
    assert rows["B.java"].file_size_bytes == 19 and rows["B.java"].total_findings == 0
    assert [r.reject_reason for r in rejected.collect()] == ["NOT_JAVA"]
    target = str(tmp_path / "out")
    for _ in range(2):  # a rerun replaces its own rows
        write_results(result.records, target, "2024-01-01")
    write_results(result.records, target, "2024-01-02")
    assert spark.read.parquet(target).groupBy("run_date").count().count() == 2
    assert spark.read.parquet(target).count() == 4
    write_results(result.records.withColumn("run_id", F.lit("r2")), target, "2024-01-01")  # another run of a day stays beside it
    assert spark.read.parquet(target).where("run_date = '2024-01-01'").groupBy("run_id").count().count() == 2
    assert len({r.record_id for r in result.records.collect()}) == 2
    assert {r.record_id for r in result.findings.collect()} <= {r.record_id for r in result.records.collect()}
    folder = str(tmp_path / "a")
    assert {r.file_name for r in scan_corpus(spark, folder, max_bytes=30).collect()} == {"B.java", "readme.txt"}
    assert [(r.safe_name, r.reject_reason) for r in oversized_files(spark, folder, 30).collect()] == [("A.java", "TOO_LARGE")]
    assert history.record_with_findings(result.records, result.findings, record="no such file").count() == 0


def test_snippet_cap_limits_before_the_exchange(spark):
    df = structure.snippet_cap(spark.read.parquet(f"{SMALL}/conversations.parquet"), "conv_id", "turn", "text")
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_vectors_raise_and_lower_confidence(spark):
    methods = spark.createDataFrame(
        [(1, 1, 'new File("a" + b)', None), (1, 2, 'new File("a" + b)', None), (1, 3, "clean", None)],
        "file_id bigint, method_seq int, code string, hint string")
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0])], "file_id bigint, method_seq int, vector array<double>")
    anchors = spark.createDataFrame([("PATH_TRAVERSAL", [1.0, 0.0])], "vulnerability_type string, anchor_vector array<double>")
    scores = scoring.score_with_vectors(methods, vectors, anchors, "encoder-1").orderBy("method_seq").collect()
    assert [(s.vulnerability_type, s.confidence) for s in scores] == [
        ("PATH_TRAVERSAL", 1.0), ("PATH_TRAVERSAL", 0.5), ("NONE", 0.0)]


def test_mean_pool(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, None], 1), ("a", [1e30, 5.0], 0), ("a", None, 1), ("a", [9.0, 9.0], None), ("b", [4.0, -4.0], 0),
            ("c", [], 1), ("d", [0.0, 0.0], 1), ("e", [2.0] * 768, 1)]
    chunks = spark.createDataFrame(rows, "k string, v array<float>, m int")
    got = {r.k: r.pooled for r in scoring.mean_pool(chunks, "k", "v", "m").collect()}
    assert got == {"a": [2.0, 1.0], "b": [0.0, 0.0], "d": [0.0, 0.0], "e": [2.0] * 768}
    plan = scoring.mean_pool(chunks, "k", "v", "m")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate" not in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_every_file_is_analysed_or_rejected(spark):
    good, broken = "class A { void m() { } }", "class A {\n void a( {\n }\n}"
    files = spark.createDataFrame(
        [(1, "A.java", good), (2, "B.java", broken), (None, "C.java", good), (4, "D.txt", good), (5, "E.java", "x" * 90)],
        "file_id bigint, file_name string, src string").withColumn("size_bytes", F.octet_length("src"))
    result, rejected = analyse_uploads(files, max_bytes=80)
    assert [r.file_id for r in result.records.collect()] == [1]
    assert sorted((r.safe_name, r.reject_reason, r.line) for r in rejected.collect()) == [
        ("B.java", "BRACKET_MISMATCH", 4), ("C.java", "NO_FILE_ID", None), ("D.txt", "NOT_JAVA", None), ("E.java", "TOO_LARGE", None)]


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_content_is_read_once(spark, tmp_path):
    files = [(i, f"F{i}.java" if i % 5 else "x.txt", b"class A { void m() { } }" if i % 7 else b"\0") for i in range(40)] + [(None, "N.java", b"class N { }")]
    source = str(tmp_path / "source")
    spark.createDataFrame(files, "file_id bigint, file_name string, content binary").selectExpr(
        "*", "octet_length(content) as size_bytes", "make_valid_utf8(string(content)) as src").write.parquet(source)
    stored = spark.read.parquet(source)
    for about in (["file_name", "size_bytes"], ["file_name", "checksum", "reject_reason"]):
        judged = stored.withColumns({"reject_reason": gates.content_reason(F.col("content")), "checksum": F.sha2("content", 256)})
        plan = executed(structure.all_sites(judged, about))
        assert plan.count("- Exchange hashpartitioning") == 1 and plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
    result, rejected = analyse_uploads(stored)
    for rows in (result.records, result.findings):
        plan = executed(rows)
        assert "/source" not in plan and "content:" not in plan
    plan = executed(rejected)
    assert "content:" not in plan and plan.count("/source") == 1  # names of files without id
    counts = {r.reject_reason: r["count"] for r in rejected.groupBy("reject_reason").count().collect()}
    assert counts == {**result.reject_counts, "NO_FILE_ID": 1} == {"NOT_JAVA": 8, "BINARY": 4, "NO_FILE_ID": 1}
    assert result.records.count() == 28


def test_parts_of_an_analysis_are_built_when_asked_for(spark, monkeypatch):
    from riskweave.plans import analysis
    stages = []
    monkeypatch.setattr(analysis, "staged", lambda df, purpose: (stages.append(purpose), df)[1])
    result = analyse(spark.createDataFrame([(1, "A.java", "class A { void m() { } }")], "file_id bigint, file_name string, src string"))
    assert stages == []
    assert result.methods.count() == 1 and stages == ["sites"]
    assert result.scored.count() == 1 and result.records.count() == 1 and result.findings.count() == 0
    assert stages == ["sites", "scored", "findings"]


def test_limits_on_scoring_are_options(spark):
    body = "".join(f'String p{i}(R q) {{ return q.getParameter("k").trim(); }}\n' for i in range(40))
    files = spark.createDataFrame([(1, "A.java", f"class A {{ {body} }}")], "file_id bigint, file_name string, src string")
    for limit, scored in ((None, 40), (25, 25)):
        record = analyse(files, max_snippets=limit).records.first()
        assert (record.total_findings, record.methods_analysed, record.methods_scored) == (scored, 40, scored)


def test_one_score_per_snippet(spark):
    snippets = spark.createDataFrame([(1, 1), (1, 2)], "file_id bigint, method_seq int")
    row = ("d", "f", None, 0.5, "m", False)
    scores = spark.createDataFrame(
        [(1, 1, "A", 3.0, *row), (1, 1, "B", 7.0, *row), (1, 1, "B", 7.0, *row)],
        "file_id bigint, method_seq int, vulnerability_type string, severity_score double, issue_description string, suggested_fix string,"
        "owasp_category string, confidence double, model_version string, fallback boolean")
    got = scoring.fallback_fill(snippets, scores).orderBy("method_seq").collect()
    assert [(r.vulnerability_type, r.fallback) for r in got] == [("B", False), ("NONE", True)]


def test_score_lines_need_a_key_and_no_null_confidence(spark):
    line = '{"fileId":1,"methodSeq":2,"vulnerabilityType":"X","severityScore":1.0,"issueDescription":"d"%s}'
    lines = [line % "", line % ',"confidence":0.5', line % ',"confidence":null', line.replace('"fileId":1,', "") % "", line.replace('"methodSeq":2,', "") % ""]
    ok, bad = scores_json_in(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r.confidence for r in ok.collect()) == [0.0, 0.5] and bad.count() == 3


def test_score_lines_of_scanned_files_and_reasons_of_others(spark):
    line = '{"fileId":"0af3","methodSeq":2,"vulnerabilityType":"X","severityScore":1.0,"issueDescription":"d"}'
    lines = spark.createDataFrame([(line,), (line.replace('"0af3"', "12"),), (line.replace("1.0", '"NaN"'),), (line.replace("1.0", "true"),), (None,)], "value string")
    ok, bad = scores_json_in(lines)
    assert sorted((r.file_id, r.severity_score) for r in ok.collect()) == [("0af3", 1.0), ("0af3", 1.0), ("12", 1.0)]
    assert sorted((r.field or "", r.reason) for r in refused_fields(bad).collect()) == [("", "NOT_JSON"), ("severity_score", "TOO_SMALL")]
    ok, bad = scores_json_in(lines, key_type="bigint")
    assert [r.file_id for r in ok.collect()] == [12] and ok.schema["file_id"].dataType.simpleString() == "bigint"


def test_snippet_lines_need_a_key_and_code(spark):
    lines = ['{"fileId":"a","methodSeq":1,"codeSnippet":"x","startLine":3}', '{"codeSnippet":"x"}', '{"fileId":"a","methodSeq":1,"codeSnippet":"","startLine":-1}',
             '{"fileId":"a","methodSeq":1,"codeSnippet":null,"startLine":null}']
    ok, bad = snippets_json_in(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.file_id, r.start_line) for r in ok.collect()] == [("a", 3)]
    assert sorted((r.field, r.reason) for r in refused_fields(bad).collect()) == [
        ("code_snippet", "EMPTY"), ("code_snippet", "NULL"), ("file_id", "MISSING"), ("method_seq", "MISSING"), ("start_line", "NULL"), ("start_line", "TOO_SMALL")]


SAMPLE = """public class Sample {
    private String dbPassword = "hunter2hunter2";
    private String apiToken = "tok-123456";
    public Object find(Statement st, String who) throws Exception {
        return st.executeQuery("SELECT a FROM b WHERE c='" + who + "'");
    }
    public void thumb(String f) throws Exception {
        Runtime.getRuntime().exec("convert " + f);
    }
    public byte[] hash(byte[] in) throws Exception {
        return MessageDigest.getInstance("MD5").digest(in);
    }
    public String config(String p) {
        try {
            BufferedReader r = new BufferedReader(new FileReader(p));
            return r.readLine();
        } catch (IOException e) { }
        return null;
    }
    public String user(String n) throws Exception {
        File f = new File("/data/" + n);
        BufferedReader r = new BufferedReader(new FileReader(f));
        return r.readLine();
    }
    public String join(List<String> xs) {
        String out = "";
        for (String x : xs) { out += x + ","; }
        return out;
    }
}
"""


def test_sample_with_twelve_findings(spark):
    files = spark.createDataFrame([(1, "Sample.java", SAMPLE)], "file_id bigint, file_name string, src string")
    result = analyse(files)
    got = [(r.line_number, r.vulnerability_type, r.detection_source) for r in result.findings.orderBy("display_seq").collect()]
    assert got == [
        (5, "SQL_INJECTION", "STATIC+AI"), (8, "COMMAND_INJECTION", "STATIC+AI"), (2, "HARDCODED_SECRET", "STATIC"),
        (3, "HARDCODED_SECRET", "STATIC"), (11, "WEAK_CRYPTOGRAPHY", "STATIC+AI"), (21, "PATH_TRAVERSAL", "STATIC+AI"),
        (15, "RESOURCE_LEAK", "STATIC+AI"), (15, "RESOURCE_LEAK", "STATIC"), (17, "EMPTY_CATCH_BLOCK", "STATIC"),
        (22, "RESOURCE_LEAK", "STATIC"), (22, "RESOURCE_LEAK", "STATIC"), (27, "STRING_CONCAT_IN_LOOP", "STATIC+AI")]
    assert result.records.first().risk_score == 60


def test_merge_plan_reads_stored_stages(spark):
    files = spark.createDataFrame([(1, "Sample.java", SAMPLE)], "file_id bigint, file_name string, src string")
    result = analyse(files)
    for rows in (result.findings, result.records):
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "getParameter" not in plan and "sha2(" not in plan and "regexp_extract_all" not in plan
        assert plan.count("Exchange hashpartitioning") <= 6


def test_entry_and_contract(spark):
    import __spark_entry__ as contract
    from riskweave.plans.oracles import all_oracles
    from riskweave.plans.queries import REGISTRY
    assert contract.entry(spark).count() > 0
    assert set(all_oracles()) == set(REGISTRY) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("missing", ["tiktoken", "xxhash", "riskweave.llm", "corpus_pipeline"])
def test_entry_without_the_corpus_operators(missing):
    code = (f"import sys; sys.modules['{missing}'] = None\nimport __spark_entry__ as e\n"
            "assert len(e.queries()) > 90 and not [q for q in e.queries() if q.startswith('op')] and set(e.oracle_sql()) == set(e.queries())")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


CHEAP = ["gate_upload", "gate_content", "quarantine_split", "sanitise_name", "checksum_size", "reupload_dedup",
         "scores_json_in", "scores_json_rejected", "snippets_json_in", "constraint_check", "token_table", "nesting_groups",
         "method_snippets", "attribute_scope", "static_findings", "finding_texts", "signature_scan", "signature_stats",
         "mean_pool", "confidence_map", "hint_bonus", "best_match", "fallback_fill", "catalog_lookup", "merged_findings",
         "merged_findings_degraded", "analysis_records", "record_with_findings", "recent_runs", "report_runs",
         "stream_scan", "stream_reupload", "stream_status", "analysis_of_uploads", "rejected_files", "write_results",
         "score_with_vectors", "merged_findings_vectors", "merge_nested_hits", "latest_run_findings", "severity_counts", "scan_corpus",
         "scores_json_reasons", "scores_json_text_ids", "scores_for_scanned_files", "reupload_across_runs", "analysis_of_stored_sources",
         "published_records", "published_findings", "stored_recent_runs", "stored_runs_for_file", "stored_latest_findings", "merge_corroborate"]


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    import __spark_entry__ as contract
    assert difference(spark, connect(SMALL), SMALL, contract.queries()[name], contract.oracle_sql()[name]) is None
