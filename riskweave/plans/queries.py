"""Every operator as a query over the tables of one data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions.columns import (
    env_name, has_finding, method_hint, sanitise_name, score_band, severity_weight,
)
from riskweave.operators import (
    catalog, dedup, gates, history, merge, quality, rules, scoring, signatures, structure, summary,
)
from riskweave.operators.lexer import parts_for, token_table
from riskweave.plans.analysis import Analysis, analyse, analyse_uploads, record_id
from riskweave.plans.java_corpus import java_corpus
from riskweave.plans.stage import staged, work_folder
from riskweave.sources.bucketed import store_sources, stored_sources
from riskweave.sources.checksum_index import ChecksumIndex
from riskweave.sources.corpus import as_source_files, scan_corpus, write_results
from riskweave.sources.score_lines import refused_fields, scores_json_in, snippets_json_in
from riskweave.sources.store import attempt_folder, publish, published, stored_latest_findings, stored_recent_runs, stored_runs_for_file
from riskweave.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def query_as(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        REGISTRY[name] = function
        return function
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code(spark: SparkSession, sf: str) -> DataFrame:
    return java_corpus(table(spark, sf, "documents"))


def code_sites(spark: SparkSession, sf: str) -> DataFrame:
    return structure.code_sites(code(spark, sf), apart=True)


def code_methods(spark: SparkSession, sf: str) -> DataFrame:
    return structure.method_snippets(code_sites(spark, sf))


def analysed(spark: SparkSession, sf: str) -> Analysis:
    return analyse(code(spark, sf), run_id="run-1")


def snippet_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the methods of the code, as (origin, id, seq, text)."""
    documents = table(spark, sf, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).alias("seq"), "text")
    methods = code_methods(spark, sf).select(
        F.lit("method").alias("origin"), F.col("file_id").alias("id"), F.col("method_seq").alias("seq"),
        F.col("code").alias("text"))
    return documents.unionByName(methods)


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """The events table read as a log of analysis runs."""
    return table(spark, sf, "events").select(*_run_columns())


def _run_columns() -> list:
    whole = F.floor("value").cast("int")
    return [
        F.col("event_id").alias("record_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(".java")).alias("file_name"),
        (whole % 7).alias("total_findings"),
        (whole % 3).alias("critical_count"),
        F.least(whole, F.lit(K.MAX_RISK)).alias("risk_score"),
        F.when(F.col("event_type") == "error", "DEGRADED").otherwise("SUCCESS").alias("ai_engine_status"),
        F.col("ts").cast("timestamp_ntz").alias("analysed_at"),
    ]


def logged_scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as snippets, and a score table that lacks the failed ones."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("method_seq"), "event_type", "value")
    snippets = events.select("file_id", "method_seq")
    scores = events.where(F.col("event_type") != "error").select(
        "file_id", "method_seq",
        F.when(F.col("event_type") == "view", "None").when(F.col("event_type") == "click", " ")
        .otherwise("SQL_INJECTION").alias("vulnerability_type"),
        F.round(F.col("value") / 50, 6).alias("severity_score"),
        F.col("event_type").alias("issue_description"),
        F.lit(None).cast("string").alias("suggested_fix"),
        F.lit(None).cast("string").alias("owasp_category"),
        F.round(F.col("value") / 1000, 6).alias("confidence"),
        F.when(F.col("event_type") == "signup", "rule-only").otherwise("encoder-1").alias("model_version"),
        F.lit(False).alias("fallback"))
    return snippets, scores


# --- scans, gates, sinks ----------------------------------------------------

@query_as("scan_corpus")
def scanned_corpus(spark, sf):
    """The code corpus as a table of files on disk, read back by the scan."""
    folder = work_folder(spark, "corpus")
    code(spark, sf).drop("size_bytes").write.parquet(folder)
    return scan_corpus(spark, folder, "parquet").select(
        "file_id", "file_name", "size_bytes", F.sha2(F.col("src").cast("binary"), 256).alias("content_sha256"))


def _gate_input(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_id"),
        F.col("url").alias("file_name"), F.col("html").alias("src"),
        F.octet_length("html").cast("int").alias("size_bytes"))
    files = code(spark, sf).select(F.col("file_id").cast("string").alias("file_id"), "file_name", "src", "size_bytes")
    return files.unionByName(pages)


@query
def gate_upload(spark, sf):
    return gates.gate_upload(_gate_input(spark, sf)).select("file_id", "file_name", "reject_reason")


@query
def gate_content(spark, sf):
    texts = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), F.col("text").alias("src"))
    return gates.gate_content(_gate_input(spark, sf).select("file_id", "src").unionByName(texts)).select(
        "file_id", "reject_reason")


@query
def quarantine_split(spark, sf):
    accepted, _, reasons = gates.quarantine_split(_gate_input(spark, sf))
    taken = accepted.agg(F.lit("ACCEPTED").alias("reject_reason"), F.count("*").alias("n_files"))
    return reasons.unionByName(taken)


@query_as("sanitise_name")
def sanitised_names(spark, sf):
    names = table(spark, sf, "pages").select(F.lit("url").alias("origin"), F.col("page_id").alias("id"), "url")
    texts = table(spark, sf, "documents").select(F.lit("text"), "doc_id", "text")
    return names.union(texts).select("origin", "id", sanitise_name(F.col("url")).alias("safe_name"))


def _documents_as_files(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("src"))


@query
def checksum_size(spark, sf):
    return gates.checksum_size(_documents_as_files(spark, sf))


@query
def reupload_groups(spark, sf):
    return dedup.reupload_groups(_documents_as_files(spark, sf))


@query
def reupload_dedup(spark, sf):
    return dedup.reupload_dedup(_documents_as_files(spark, sf))


@query
def structure_quarantine(spark, sf):
    return structure.structure_quarantine(code(spark, sf))


def score_lines(documents: DataFrame) -> DataFrame:
    """JSON lines in both spellings, some out of range, some without a required key."""
    doc = F.col("doc_id")
    score = F.concat((doc % 13).cast("string"), F.lit(".5"))
    camel = F.concat(
        F.lit('{"fileId":'), doc.cast("string"), F.lit(',"methodSeq":1,"vulnerabilityType":"SQL_INJECTION",'),
        F.lit('"severityScore":'), score, F.lit(',"issueDescription":"'), F.col("source"),
        F.lit('","owaspCategory":null,"extra":{"a":[1,2]},"confidence":0.25}'))
    snake = F.concat(
        F.lit('{"file_id":'), doc.cast("string"), F.lit(',"method_seq":2,"vulnerability_type":"NONE",'),
        F.lit('"severity_score":'), score, F.lit(',"issue_description":"'), F.col("lang"),
        F.lit('","confidence":'), F.concat((doc % 3).cast("string"), F.lit(".0")), F.lit(',"model_version":"m1"}'))
    partial = F.concat(F.lit('{"fileId":'), doc.cast("string"), F.lit(',"severityScore":1.0}'))
    return documents.select(
        F.when(doc % 3 == 0, camel).when(doc % 3 == 1, snake).otherwise(partial).alias("value"))


def _score_input(spark, sf):
    lines = score_lines(table(spark, sf, "documents"))
    return lines.unionByName(table(spark, sf, "events").select(F.col("props").alias("value")))


@query
def reupload_across_runs(spark, sf):
    """The documents with odd ids as a second day's uploads, matched with the first day's by its index alone."""
    index = ChecksumIndex(spark, work_folder(spark, "checksum-index"), buckets=8)
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("src"))
    index.add(dedup.stored_checksums(files.where("file_id % 2 = 0")), "2024-01-01", "run-1")
    sums = dedup.stored_checksums(files.where("file_id % 2 = 1"))
    return dedup.reupload_across_runs(sums, index.lookup(sums))


@query_as("scores_json_in")
def scores_json(spark, sf):
    ok, _ = scores_json_in(_score_input(spark, sf), key_type="bigint")
    return ok


@query
def scores_json_rejected(spark, sf):
    _, bad = scores_json_in(_score_input(spark, sf))
    return bad.groupBy("value").agg(F.count("*").alias("n_lines"))


@query_as("snippets_json_in")
def snippets_json(spark, sf):
    turns = table(spark, sf, "conversations").select(F.to_json(F.struct(
        F.col("conv_id").alias("fileId"), F.col("turn").cast("int").alias("method_seq"),
        F.when(F.col("turn") % 5 != 4, F.col("text")).otherwise("").alias("codeSnippet"),
        (F.col("turn") - F.when(F.col("role") == "user", 1).otherwise(0)).alias("startLine"),
        F.col("role").alias("className"), F.col("role").alias("unknownKey"))).alias("value"))
    ok, _ = snippets_json_in(turns, key_type="bigint")
    return ok


#: Score lines with a text id (@ID@) each; what is wrong with them is written down beside the SQL.
ODD_SCORE_LINES = [
    '{"fileId":"@ID@","methodSeq":1,"vulnerabilityType":"X","severityScore":1.0,"issueDescription":"d"}',
    '{"file_id":"@ID@","method_seq":"1","vulnerability_type":"X","severity_score":"1.5","issue_description":"d","confidence":"0.5"}',
    '{"methodSeq":1.0,"vulnerabilityType":"X","severityScore":1,"issueDescription":"d","suggestedFix":null}',
    '{"fileId":"@ID@","methodSeq":1.5,"vulnerabilityType":7,"severityScore":"high","issueDescription":["d"]}',
    '{"fileId":"@ID@","methodSeq":1,"vulnerabilityType":"X","severityScore":10.5,"issueDescription":"d","confidence":-0.1}',
    '{"fileId":"@ID@","methodSeq":1,"vulnerabilityType":null,"severityScore":-1,"issueDescription":"d","confidence":null,"modelVersion":null}',
    '{"fileId":{"a":"@ID@"},"file_id":"@ID@","methodSeq":null,"vulnerabilityType":"X","severityScore":0,"issueDescription":""}',
    '["@ID@"]', '{"fileId":"@ID@"', "", "null",
    '{"fileId":"@ID@","methodSeq":1,"vulnerabilityType":"X","severityScore":10,"issueDescription":"d","confidence":1,"more":{"x":[null]}}',
    '{}',
]


def _odd_lines(spark, sf):
    template = F.element_at(F.array(*[F.lit(x) for x in ODD_SCORE_LINES]), (F.col("doc_id") % len(ODD_SCORE_LINES)).cast("int") + 1)
    line = F.replace(template, F.lit("@ID@"), F.concat(F.lit("f-"), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", line.alias("value"))


@query
def scores_json_reasons(spark, sf):
    """Rejected score lines: one row per line and field, with the reason."""
    _, bad = scores_json_in(_odd_lines(spark, sf))
    return refused_fields(bad).groupBy("value", "field", "reason").agg(F.count("*").alias("n_lines"))


@query
def scores_json_text_ids(spark, sf):
    """Score lines of files whose ids are text."""
    ok, _ = scores_json_in(_odd_lines(spark, sf))
    return ok


@query
def scores_for_scanned_files(spark, sf):
    """Files as a folder gives them, and an external scorer's lines for the first method of each, under the ids of the scan."""
    raw = code(spark, sf).select(
        F.concat(F.lit("file:/corpus/"), F.col("file_name")).alias("path"), F.octet_length("src").cast("bigint").alias("length"),
        F.col("src").cast("binary").alias("content"))
    files = as_source_files(raw)
    lines = files.select(F.to_json(F.struct(
        F.col("file_id").alias("fileId"), F.lit(1).alias("methodSeq"), F.lit("RESOURCE_LEAK").alias("vulnerabilityType"),
        F.lit(5.5).alias("severityScore"), F.lit("left open").alias("issueDescription"), F.lit(0.75).alias("confidence"))).alias("value"))
    scores, _ = scores_json_in(lines)
    scored = scores.withColumn("fallback", F.lit(False))
    result, _ = analyse_uploads(files, scores=scored, run_id="run-1")
    return result.scored.select("file_id", "method_seq", "method_name", "vulnerability_type", "severity_score", "confidence", "fallback")


@query_as("write_results")
def written_results(spark, sf):
    """Two runs of one day; the second one is written twice, as a repeated run is."""
    target = work_folder(spark, "results")
    records = analysed(spark, sf).records
    for run in ("run-1", "run-2", "run-2"):
        write_results(records.withColumn("run_id", F.lit(run)).withColumn("record_id", record_id(run)), target, "2024-01-01")
    return spark.read.parquet(target).withColumn("run_date", F.col("run_date").cast("string"))


@query
def constraint_check(spark, sf):
    """Runs and findings read from the events log, with many violations on purpose."""
    events = table(spark, sf, "events")
    records = events.select(
        F.col("event_id").alias("record_id"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("file_name"),
        F.upper("event_type").alias("ai_engine_status"), F.floor("value").cast("int").alias("risk_score"),
        F.repeat("event_type", 10).alias("engine_version"), F.col("ts").cast("timestamp_ntz").alias("analysed_at"))
    findings = events.select(
        (F.col("event_id") + 7).alias("record_id"),  # the last ones point to no record
        F.when(F.col("event_type") == "error", "CRITICAL").otherwise("low").alias("severity"),
        F.when(F.col("event_type") != "view", "SECURITY").alias("category"),
        F.when(F.col("event_type") == "click", "STATIC+AI").otherwise("BOTH").alias("detection_source"),
        (F.col("value") / 400).alias("confidence"), F.repeat("props", 200).alias("description"))
    return quality.constraint_check(records, findings)


# --- structure --------------------------------------------------------------

@query_as("token_table")
def tokens(spark, sf):
    return token_table(code(spark, sf)).select("file_id", "pos", "tok", "line", "kind")


@query
def nesting_groups(spark, sf):
    return structure.nesting_groups(token_table(code(spark, sf)))


@query
def method_snippets(spark, sf):
    return code_methods(spark, sf)


@query
def attribute_scope(spark, sf):
    return structure.attribute_scope(code_sites(spark, sf)).drop("pos")


@query
def method_hints(spark, sf):
    texts = table(spark, sf, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"),
                                                 F.lit(0).cast("bigint").alias("seq"), "text")
    turns = table(spark, sf, "conversations").select(F.lit("turn"), "conv_id", "turn", "text")
    return texts.union(turns).select("origin", "id", "seq", method_hint(F.col("text")).alias("hint"))


@query
def snippet_cap(spark, sf):
    capped = structure.snippet_cap(table(spark, sf, "conversations"), "conv_id", "turn", "text", max_n=4, max_chars=200)
    return capped.select("conv_id", "turn", "snippet_rank", "text")


@query
def snippet_cap_code(spark, sf):
    return structure.snippet_cap(code_methods(spark, sf)).select("file_id", "method_seq", "snippet_rank", "code")


# --- structural rules -------------------------------------------------------

def _rule_query(rule: str) -> Query:
    def run(spark, sf):
        hits = rules.rule_hits(code_sites(spark, sf), only=rule)
        return hits.select("file_id", "vulnerability_type", "line", "method_name", "class_name",
                           F.col("node").alias("code_snippet"))
    return run


for _rule in rules.RULE_ORDER:
    REGISTRY[_rule] = _rule_query(_rule)


@query
def static_findings(spark, sf):
    return rules.static_findings(code_sites(spark, sf)).drop("rule", "description", "remediation")


@query
def finding_texts(spark, sf):
    return rules.finding_texts(rules.rule_hits(code_sites(spark, sf))).select(
        "file_id", "rule", "line", "description", "remediation")


@query_as("env_name")
def env_names(spark, sf):
    names = table(spark, sf, "events").select(
        "event_id", F.concat("event_type", F.lit("Db"), F.col("user_id").cast("string"), F.lit("ApiKeyX")).alias("name"))
    return names.select("event_id", "name", env_name(F.col("name")).alias("env_name"))


# --- signatures -------------------------------------------------------------

SIGNATURE_QUERIES = {
    "sig_sql": "SQL_INJECTION", "sig_secret": "HARDCODED_SECRET", "sig_crypto": "WEAK_CRYPTOGRAPHY",
    "sig_command": "COMMAND_INJECTION", "sig_path": "PATH_TRAVERSAL", "sig_empty_catch": "EMPTY_CATCH_BLOCK",
    "sig_leak": "RESOURCE_LEAK", "sig_concat_loop": "STRING_CONCAT_IN_LOOP", "sig_null_risk": "NULL_POINTER_RISK",
}


def _signature_query(kind: str) -> Query:
    def run(spark, sf):
        return signatures.one_signature(snippet_texts(spark, sf), kind, "text", ["origin", "id", "seq"])
    return run


for _name, _kind in SIGNATURE_QUERIES.items():
    REGISTRY[_name] = _signature_query(_kind)


@query
def signature_scan(spark, sf):
    return signatures.signature_scan(snippet_texts(spark, sf), "text", ["origin", "id", "seq"])


@query
def signature_stats(spark, sf):
    return signatures.signature_stats(table(spark, sf, "documents"), "text", ["source", "lang"])


# --- scoring ----------------------------------------------------------------

def label_centroids(spark, sf):
    return scoring.mean_pool(table(spark, sf, "embeddings"), "label", "embedding")


@query
def mean_pool(spark, sf):
    pooled = label_centroids(spark, sf)
    return pooled.select("label", F.posexplode("pooled").alias("i", "mean")).select(
        "label", "i", F.round("mean", 6).alias("mean"))


def _similarities(spark, sf):
    """Every vector against the centroid of its label."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("kind"), F.col("embedding").alias("vector"))
    anchors = label_centroids(spark, sf).select(F.col("label").alias("kind"), F.col("pooled").alias("anchor_vector"))
    return scoring.anchor_similarity(
        vectors.select("vec_id", "kind"), vectors, anchors, ["vec_id"], "kind")


@query
def anchor_similarity(spark, sf):
    return _similarities(spark, sf).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def confidence_map(spark, sf):
    return scoring.confidence_map(_similarities(spark, sf)).select("vec_id", F.round("confidence", 6).alias("confidence"))


def _event_types(spark, sf):
    """Events tagged with catalog types in mixed case, and with unknown ones."""
    kind = (
        F.when(F.col("event_type") == "error", "sql_injection").when(F.col("event_type") == "purchase", "HARDCODED_SECRET")
        .when(F.col("event_type") == "click", "Empty_Catch_Block").when(F.col("event_type") == "view", "SOMETHING_NEW"))
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", kind.alias("vulnerability_type"))


@query
def hint_bonus(spark, sf):
    hint = (
        F.when(F.col("user_id") % 4 == 0, "possible_sql_injection,possible_swallowed_exception")
        .when(F.col("user_id") % 4 == 1, "Possible_Hardcoded_Secret").when(F.col("user_id") % 4 == 2, "possible_swallowed_exception"))
    rows = _event_types(spark, sf).withColumn("hint", hint).withColumn("confidence", F.round(F.col("value") / 500, 6))
    return scoring.hint_bonus(rows).select("event_id", "hint", F.round("confidence", 6).alias("confidence"))


def _line_hits(spark, sf):
    """Order lines read as signature hits: many hits per snippet, with ties."""
    hits = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (F.col("l_suppkey") % 3).cast("int").alias("method_seq"),
        (F.col("l_partkey") % 9 + 1).cast("int").alias("sig_seq"),
        F.round(F.col("l_discount").cast("double"), 2).alias("confidence"))
    # nine fixed rows
    kinds = F.broadcast(catalog.signature_table(spark).select("sig_seq", "vulnerability_type", "severity"))
    return hits.join(kinds, "sig_seq")


@query
def best_match(spark, sf):
    return scoring.best_match(_line_hits(spark, sf))


@query
def model_label(spark, sf):
    return scoring.model_label(scoring.fallback_fill(*logged_scores(spark, sf)))


@query
def fallback_fill(spark, sf):
    return scoring.fallback_fill(*logged_scores(spark, sf)).select(
        "file_id", "method_seq", "vulnerability_type", "severity_score", "confidence", "model_version", "fallback")


@query_as("has_finding")
def finding_flags(spark, sf):
    filled = scoring.fallback_fill(*logged_scores(spark, sf))
    return filled.select("file_id", "method_seq", has_finding(F.col("vulnerability_type")).alias("has_finding"))


@query
def score_methods(spark, sf):
    return scoring.score_methods(code_methods(spark, sf)).select(
        "file_id", "method_seq", "vulnerability_type", "severity_score", "owasp_category", "confidence",
        "model_version", "fallback")


@query
def score_with_vectors(spark, sf):
    """Methods scored by signatures whose certainty comes from vectors: an embedding for the first
    method of a file, and the centroid of label n as anchor of signature n + 1."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("file_id"), F.lit(1).alias("method_seq"), F.col("embedding").alias("vector"))
    kinds = catalog.signature_table(spark).select((F.col("sig_seq") - 1).alias("label"), "vulnerability_type")
    anchors = label_centroids(spark, sf).join(kinds, "label").select("vulnerability_type", F.col("pooled").alias("anchor_vector"))
    scores = scoring.score_with_vectors(code_methods(spark, sf), vectors, anchors, "encoder-1")
    return scores.select("file_id", "method_seq", "vulnerability_type", "severity_score", "confidence", "model_version")


@query
def merged_findings_vectors(spark, sf):
    """The merge with scores from vectors: a surer score raises the certainty of a structural finding."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("file_id"), F.lit(1).alias("method_seq"), F.col("embedding").alias("vector"))
    kinds = catalog.signature_table(spark).select((F.col("sig_seq") - 1).alias("label"), "vulnerability_type")
    anchors = label_centroids(spark, sf).join(kinds, "label").select("vulnerability_type", F.col("pooled").alias("anchor_vector"))
    result = analyse(code(spark, sf), lambda methods: scoring.score_with_vectors(methods, vectors, anchors, "encoder-1"), run_id="run-1")
    return result.findings.select("display_seq", "severity", "file_name", *_PLACE)


@query
def attach_scores(spark, sf):
    """Methods with an external score table that knows the first method of each file."""
    methods = code_methods(spark, sf).select("file_id", "method_seq", "method_name", "code")
    none = F.lit(None).cast("string")
    scores = table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), F.lit(1).alias("method_seq"), F.col("source").alias("vulnerability_type"),
        F.lit(5.0).alias("severity_score"), F.col("lang").alias("issue_description"), none.alias("suggested_fix"),
        none.alias("owasp_category"), F.lit(0.5).alias("confidence"), F.lit("encoder-1").alias("model_version"),
        F.lit(False).alias("fallback"))
    return scoring.attach_scores(methods, scores).select(
        "file_id", "method_seq", "method_name", "vulnerability_type", "severity_score", "model_version", "fallback")


# --- catalog ----------------------------------------------------------------

@query
def catalog_lookup(spark, sf):
    return catalog.catalog_lookup(_event_types(spark, sf)).select(
        "event_id", "vulnerability_type", "display_name", "severity", "category", "owasp_category",
        "rule_confidence", "is_known")


@query_as("severity_weight")
def severity_weights(spark, sf):
    found = catalog.catalog_lookup(_event_types(spark, sf)).withColumn(
        "severity", F.when(F.col("event_type") != "signup", F.col("severity")))
    return found.select("event_id", "severity", severity_weight(F.col("severity")).alias("weight"))


@query_as("score_band")
def score_bands(spark, sf):
    return table(spark, sf, "events").select("event_id", score_band(F.col("value") / 50).alias("band"))


@query
def catalog_coverage(spark, sf):
    """Coverage as seen in the corpus: which types do rules and signatures report?"""
    sites = staged(code_sites(spark, sf), "sites")
    by_rule = rules.rule_hits(sites).groupBy("vulnerability_type").agg(F.count("*").alias("n_rule_hits"))
    hits = signatures.signature_scan(structure.method_snippets(sites), "code", ["file_id"])
    by_signature = hits.groupBy("vulnerability_type").agg(F.count("*").alias("n_signature_hits"))
    declared = catalog.catalog_coverage(spark, rules.rule_types(spark))
    counts = ["n_rule_hits", "n_signature_hits"]
    return (
        declared.join(by_rule, "vulnerability_type", "full").join(by_signature, "vulnerability_type", "full")
        .select("vulnerability_type", "in_catalog", "has_rule", "has_signature",
                *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])
    )


@query
def catalog_listing(spark, sf):
    """The catalog page with the number of findings per type."""
    found = rules.rule_hits(code_sites(spark, sf)).groupBy("vulnerability_type").agg(F.count("*").alias("n_findings"))
    return catalog.catalog_listing(spark).join(found, "vulnerability_type", "left").withColumn(
        "n_findings", F.coalesce("n_findings", F.lit(0)))


@query
def catalog_counts(spark, sf):
    """Findings per category and OWASP class."""
    found = catalog.catalog_lookup(rules.rule_hits(code_sites(spark, sf)).select("vulnerability_type"))
    return found.groupBy("category", "owasp_category").agg(
        F.countDistinct("vulnerability_type").alias("n_types"), F.count("*").alias("n_findings"))


# --- merge ------------------------------------------------------------------

_PLACE = ["file_id", "vulnerability_type", "line_number", "method_name", "confidence", "detection_source"]


@query
def merge_corroborate(spark, sf):
    a = analysed(spark, sf)
    return merge.merge_corroborate(a.static, merge.scored_hits(a.scored)).select("list_seq", *_PLACE)


@query
def merge_ai_only(spark, sf):
    a = analysed(spark, sf)
    return merge.merge_ai_only(a.static, merge.scored_hits(a.scored)).select(
        "file_id", "method_seq", "vulnerability_type", "start_line", "confidence")


@query
def merge_nested_hits(spark, sf):
    a = analysed(spark, sf)
    left = merge.merge_ai_only(a.static, merge.scored_hits(a.scored))
    return merge.merge_nested_hits(left).select(
        "file_id", "method_seq", "vulnerability_type", "is_appended", "absorbed_by")


@query
def merge_order(spark, sf):
    return merge.merge_order(rules.static_findings(code_sites(spark, sf))).select(
        "file_id", "display_seq", "list_seq", "vulnerability_type", "severity")


@query
def merged_findings(spark, sf):
    return analysed(spark, sf).findings.select("display_seq", "severity", "file_name", *_PLACE)


@query
def merged_findings_degraded(spark, sf):
    """The same merge when no scores could be obtained."""
    files = code(spark, sf)
    nothing = spark.createDataFrame([], "file_id bigint, method_seq int, vulnerability_type string, severity_score double,"
                                        "issue_description string, suggested_fix string, owasp_category string,"
                                        "confidence double, model_version string, fallback boolean")
    return analyse(files, nothing).findings.select("display_seq", "severity", "file_name", *_PLACE)


# --- roll-ups ---------------------------------------------------------------

@query
def severity_counts(spark, sf):
    a = analysed(spark, sf)
    return summary.severity_counts(a.findings, a.records)  # a broken file is no clean file


@query
def risk_score(spark, sf):
    a = analysed(spark, sf)
    return summary.risk_score(a.findings, a.records)


@query
def run_status(spark, sf):
    snippets, scores = logged_scores(spark, sf)
    filled = scoring.fallback_fill(snippets, scores)
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"))
    return summary.run_status(filled, users.unionByName(snippets.select("file_id")).distinct())


@query
def methods_analysed(spark, sf):
    a = analysed(spark, sf)
    return summary.methods_analysed(a.methods, a.records)


@query
def analysis_records(spark, sf):
    return analysed(spark, sf).records


@query
def analysis_of_stored_sources(spark, sf):
    """Records of files kept in buckets of their id."""
    files, path = code(spark, sf), work_folder(spark, "sources")
    buckets = parts_for(files)  # a bucket is a task's work
    store_sources(files, path, buckets=buckets)
    stored = stored_sources(spark, path, "file_id bigint, file_name string, src string, size_bytes int", buckets=buckets)
    return analyse_uploads(stored, run_id="run-1", in_buckets=True)[0].records


@query
def analysis_of_uploads(spark, sf):
    """Gates and analysis together: one row per file, analysed or rejected."""
    result, rejected = analyse_uploads(code(spark, sf), run_id="run-1")
    taken = result.records.select("file_id", "risk_score", F.lit(None).cast("string").alias("reject_reason"))
    return taken.unionByName(rejected.select("file_id", F.lit(None).cast("int").alias("risk_score"), "reject_reason"))


@query
def rejected_files(spark, sf):
    """Files that a gate or the structure turns away, with the line of the first problem."""
    _, rejected = analyse_uploads(code(spark, sf), run_id="run-1")
    return rejected


@query
def count_by_severity(spark, sf):
    return summary.count_by_severity(analysed(spark, sf).findings)


@query
def runs_by_status(spark, sf):
    return summary.runs_by_status(run_log(spark, sf))


# --- history and reports ----------------------------------------------------

@query
def recent_runs(spark, sf):
    return history.recent_runs(run_log(spark, sf))


@query
def runs_for_file(spark, sf):
    return history.runs_for_file(run_log(spark, sf), "U8.java")


@query
def runs_overview(spark, sf):
    return history.runs_overview(run_log(spark, sf))


@query
def record_with_findings(spark, sf):
    a = analysed(spark, sf)
    nested = history.record_with_findings(a.records.select("file_id", "file_name", "risk_score"), a.findings)
    return nested.select("file_id", "file_name", "risk_score", F.size("findings").alias("n_findings"),
                         F.explode_outer("findings").alias("f")).select(
        "file_id", "file_name", "risk_score", "n_findings", "f.display_seq", "f.vulnerability_type", "f.line_number")


@query
def findings_for_record(spark, sf):
    wanted = code(spark, sf).where("file_id = 12")  # one record needs one file
    return history.findings_for_record(analyse(wanted, run_id="run-1").findings, 12).select(*_PLACE)


@query
def latest_run_findings(spark, sf):
    a = analysed(spark, sf)
    return history.latest_run_findings(a.records, a.findings, "file_id").select(*_PLACE, "severity")


@query
def report_findings(spark, sf):
    rows = catalog.catalog_lookup(_event_types(spark, sf)).withColumn(
        "confidence", F.when(F.col("event_type") != "click", F.round(F.col("value") / 500, 3)))
    return history.report_findings(rows).select("event_id", "confidence", "confidence_percent", "severity", "severity_css")


@query
def report_runs(spark, sf):
    return history.report_runs(run_log(spark, sf)).select(
        "record_id", "file_name", "when_short", "when_long", "total_findings", "critical_badge", "risk_score",
        "ai_engine_status", "status_css", "banner")


@query
def service_labels(spark, sf):
    reachable, loaded = F.col("event_type") != "error", F.col("event_type") == "view"
    return table(spark, sf, "events").select(
        "event_id", history.service_label(reachable, loaded).alias("label"),
        history.service_css(reachable, loaded).alias("css_class"))


# --- history of stored results ----------------------------------------------

def _store(spark, sf):
    """Three runs of two days; the first one was repeated, and an attempt at another was cut short."""
    root, result = work_folder(spark, "store"), analysed(spark, sf)

    def run(run_id, day, keep):
        own = {"run_id": F.lit(run_id), "record_id": record_id(run_id)}
        at = F.lit(f"{day} 12:00:00").cast("timestamp_ntz")
        return {"records": result.records.where(keep).withColumns(own | {"analysed_at": at}),
                "findings": result.findings.where(keep).withColumns(own | {"created_at": at})}

    publish(run("run-10", "2024-01-02", "file_id % 2 = 0"), root, "2024-01-02", "run-10")
    for keep in ("file_id % 7 = 0", "file_id % 3 = 0"):
        publish(run("run-9", "2024-01-01", keep), root, "2024-01-01", "run-9")
    publish(run("run-8", "2024-01-01", "file_id = 1"), root, "2024-01-01", "run-8")
    cut = attempt_folder(root, "records", "2024-01-03", "run-11", "never-committed")
    run("run-11", "2024-01-03", "true")["records"].drop("run_id").write.parquet(cut)
    return root


_RECORD = ["run_date", "run_id", "record_id", "file_id", "file_name", "total_findings", "risk_score", "analysed_at"]


@query
def published_records(spark, sf):
    return published(spark, _store(spark, sf), "records").select(*_RECORD)


@query
def published_findings(spark, sf):
    return published(spark, _store(spark, sf), "findings").select("run_date", "run_id", "record_id", "display_seq", *_PLACE)


@query_as("stored_recent_runs")
def recent_of_store(spark, sf):
    return stored_recent_runs(spark, _store(spark, sf)).select(*_RECORD)


@query_as("stored_runs_for_file")
def runs_of_file_in_store(spark, sf):
    return stored_runs_for_file(spark, _store(spark, sf), "C12.java").select(*_RECORD)


@query_as("stored_latest_findings")
def latest_of_store(spark, sf):
    return stored_latest_findings(spark, _store(spark, sf)).select("run_id", "record_id", "severity", *_PLACE)


# --- streams ----------------------------------------------------------------

def _stream(spark, sf, name):
    """A table as a stream of its files, whether it is one file or a folder of them."""
    schema = table(spark, sf, name).schema
    # a pattern that only the table fits: a plain path would have to be a folder
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.[p]arquet")


@query
def stream_scan(spark, sf):
    sink = work_folder(spark, "scan")
    job = jobs.stream_scan(java_corpus(_stream(spark, sf, "documents")), sink, f"{sink}/_progress")
    job.awaitTermination()
    run = F.concat(F.lit("batch-"), F.substring_index("run_id", "-", -1))  # the query's id is made up by Spark
    return published(spark, sink, "records").withColumn("run_id", run).withColumn(
        "record_id", F.concat_ws("/", run, "file_id")).drop("run_date", "analysed_at")


@query
def stream_reupload(spark, sf):
    files = _stream(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("text").alias("src"),
        F.col("_metadata.file_modification_time").alias("arrived"))
    sink = work_folder(spark, "reupload")
    jobs.run_to_parquet(jobs.stream_reupload(files, "arrived", "1 hour"), sink, f"{sink}-progress")
    return spark.read.parquet(sink).select("checksum_sha256", "file_size_bytes", F.col("file_id").isNotNull().alias("has_file"))


@query
def stream_status(spark, sf):
    runs = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("analysed_at"),
        F.when(F.col("event_type") == "error", "DEGRADED").otherwise("SUCCESS").alias("ai_engine_status"))
    sink = work_folder(spark, "status")
    jobs.run_to_parquet(jobs.stream_status(runs, "6 hours", "10 minutes"), sink, f"{sink}-progress")
    return spark.read.parquet(sink).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n_runs", "n_degraded", "degraded_share")
