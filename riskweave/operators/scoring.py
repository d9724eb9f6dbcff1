"""Scores per snippet: signature hits, similarity, hint bonus, best match."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions.columns import confidence_of, cosine, with_hint_bonus
from riskweave.functions.texts import NO_HIT_TEXT, NO_SCORE_TEXT, SIGNATURE_TEXTS
from riskweave.operators.signatures import signature_hits, signature_scan
from riskweave.operators.structure import snippet_cap

SNIPPET_KEY = ["file_id", "method_seq"]
SCORE_COLUMNS = [
    "vulnerability_type", "severity_score", "issue_description", "suggested_fix",
    "owasp_category", "confidence", "model_version", "fallback",
]
RULE_ONLY = "rule-only"
UNAVAILABLE = "unavailable"
# Fixed value: an empty mask counts as this much, so the mean of nothing is 0
_MIN_MASK = 1e-9
_NO_WEIGHT = 1e-30


def _by_type(column: Column, values: dict[str, object]) -> Column:
    picked = F.when(F.lit(False), F.lit(None))
    for name, value in values.items():
        picked = picked.when(column == name, F.lit(value))
    return picked


def mean_pool(vectors: DataFrame, key: str, vec: str, mask: str | None = None) -> DataFrame:
    """Element-wise mean of the vectors of a key over rows whose mask is set.

    The running mean of a key is one vector in the aggregation's buffer, combined per task,
    so a row per task and key crosses the one exchange, however many vectors a key has.
    Vectors of a key have one length; missing and empty ones do not count, null elements are
    0. A key whose rows are all masked out has a mean of 0.
    """
    given = F.greatest(F.coalesce(F.col(mask).cast("double"), F.lit(0.0)), F.lit(0.0)) if mask else F.lit(1.0)
    numbers = F.transform(vec, lambda x: F.when(F.col("w") > 0, F.coalesce(x.cast("double"), F.lit(0.0))).otherwise(0.0))
    rows = vectors.where(F.size(vec) > 0).withColumn("w", given).select(
        key, "w", F.greatest("w", F.lit(_NO_WEIGHT)).alias("counted"), array_to_vector(numbers).alias("v"))
    # the aggregate wants a weight; masked rows are zeros of a weight that adds nothing
    means = rows.groupBy(key).agg(Summarizer.mean(F.col("v"), F.col("counted")).alias("mean"), F.sum("w").alias("total"))
    share = F.col("total") / F.greatest("total", F.lit(_MIN_MASK))
    return means.select(key, F.transform(vector_to_array("mean"), lambda m: m * share).alias("pooled"))


def anchor_similarity(hits: DataFrame, vectors: DataFrame, anchors: DataFrame, key_cols: list[str],
                      type_col: str = "vulnerability_type") -> DataFrame:
    """Cosine between the vector of a snippet and the anchor vector of the matched type.

    ``vectors``: key columns + ``vector``.  ``anchors``: type column + ``anchor_vector``,
    one row per type; Spark broadcasts them when their measured size allows it.
    """
    return (
        hits.join(vectors.select(*key_cols, "vector"), key_cols, "left")
        .join(anchors.select(type_col, "anchor_vector"), type_col, "left")
        .withColumn("similarity", cosine(F.col("vector"), F.col("anchor_vector")))
        .drop("vector", "anchor_vector")
    )


def confidence_map(rows: DataFrame, similarity: str = "similarity") -> DataFrame:
    return rows.withColumn("confidence", confidence_of(F.col(similarity)))


def hint_bonus(rows: DataFrame) -> DataFrame:
    return rows.withColumn("confidence", with_hint_bonus(
        F.col("confidence"), F.col("hint"), F.col("vulnerability_type")))


def best_match(hits: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """One hit per snippet: highest severity, then confidence, then earlier signature."""
    key_cols = key_cols or SNIPPET_KEY
    rank = F.struct("severity", "confidence", (-F.col("sig_seq")).alias("earlier"))
    picked = F.struct("vulnerability_type", "severity", "confidence")
    return hits.groupBy(*key_cols).agg(F.max_by(picked, rank).alias("best")).select(
        *key_cols, "best.vulnerability_type", F.col("best.severity").alias("severity_score"),
        F.round("best.confidence", 3).alias("confidence"))


def _score_fields(vulnerability_type: Column, severity: Column, confidence: Column, model: str) -> list[Column]:
    """Columns of a score row; a null type means that no signature matched."""
    texts = SIGNATURE_TEXTS.items()
    return [
        F.coalesce(vulnerability_type, F.lit("NONE")).alias("vulnerability_type"),
        F.coalesce(severity, F.lit(0.0)).alias("severity_score"),
        F.coalesce(_by_type(vulnerability_type, {n: t[0] for n, t in texts}), F.lit(NO_HIT_TEXT)).alias(
            "issue_description"),
        _by_type(vulnerability_type, {n: t[1] for n, t in texts}).alias("suggested_fix"),
        _by_type(vulnerability_type, {n: o for n, _, _, o in K.SIGNATURES}).cast("string").alias("owasp_category"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
        F.lit(model).alias("model_version"),
        F.lit(False).alias("fallback"),
    ]


def limited(methods: DataFrame, max_snippets: int | None, max_chars: int | None) -> DataFrame:
    """The snippets that are scored: all of them, whole, unless limits are given."""
    if max_snippets is not None:
        methods = snippet_cap(methods, max_n=max_snippets, max_chars=max_chars).drop("snippet_rank")
    elif max_chars is not None:
        methods = methods.withColumn("code", F.substring("code", 1, max_chars))
    return methods


def scored_snippets(methods: DataFrame, max_snippets: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Snippets with their scores, without vectors.

    A projection of the snippets: no exchange beyond that of a cap.  Every hit
    starts at the neutral confidence; the hint bonus may raise it.
    """
    hits = F.transform(signature_hits(F.col("code")), lambda h: F.struct(
        h["severity"].alias("severity"),
        with_hint_bonus(F.lit(K.NEUTRAL_CONFIDENCE), F.col("hint"), h["vulnerability_type"]).alias("confidence"),
        (-h["sig_seq"]).alias("earlier"),
        h["vulnerability_type"].alias("vulnerability_type"),
    ))
    best = limited(methods, max_snippets, max_chars).withColumn("best", F.array_max(hits))
    return best.select("*", *_score_fields(
        F.col("best.vulnerability_type"), F.col("best.severity"), F.round("best.confidence", 3), RULE_ONLY,
    )).drop("best")


def score_methods(methods: DataFrame) -> DataFrame:
    """The score table of the default scorer, keyed by file and method."""
    return scored_snippets(methods).select(*SNIPPET_KEY, *SCORE_COLUMNS)


def score_with_vectors(methods: DataFrame, vectors: DataFrame, anchors: DataFrame, model: str,
                       max_snippets: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Scores whose confidence comes from vector similarity to the anchors."""
    capped = limited(methods, max_snippets, max_chars)
    hits = signature_scan(capped, "code", [*SNIPPET_KEY, "hint"])
    scored = hint_bonus(confidence_map(anchor_similarity(hits, vectors, anchors, SNIPPET_KEY)))
    best = best_match(scored)
    return capped.select(*SNIPPET_KEY).join(best, SNIPPET_KEY, "left").select(
        *SNIPPET_KEY,
        *_score_fields(F.col("vulnerability_type"), F.col("severity_score"), F.col("confidence"), model),
    )


def fallback_fill(methods: DataFrame, scores: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Attach scores to snippets; a snippet without a score row becomes a fallback row.

    Of several score rows of a snippet the severest counts, then the surest, then
    the last by type name; so a repeated score never repeats a snippet.
    """
    key_cols = key_cols or SNIPPET_KEY
    rank = F.struct("severity_score", "confidence", "vulnerability_type", "model_version", "issue_description")
    one = scores.groupBy(*key_cols).agg(F.max_by(F.struct(*SCORE_COLUMNS), rank).alias("one"))
    have = one.select(*key_cols, "one.*", F.lit(True).alias("scored"))
    missing = F.col("scored").isNull()
    defaults = {
        "vulnerability_type": "NONE", "severity_score": 0.0, "issue_description": NO_SCORE_TEXT,
        "confidence": 0.0, "model_version": UNAVAILABLE, "fallback": True,
    }
    filled = methods.join(have, key_cols, "left")
    for name, value in defaults.items():
        filled = filled.withColumn(name, F.when(missing, F.lit(value)).otherwise(F.col(name)))
    return filled.drop("scored")


def attach_scores(methods: DataFrame, scores: DataFrame, max_snippets: int | None = None, max_chars: int | None = None) -> DataFrame:
    """The scorer seam: the snippets of a file with any score table."""
    return fallback_fill(limited(methods, max_snippets, max_chars), scores)


def model_label(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.coalesce("model_version", F.lit("unknown")).alias("model_version")).agg(
        F.count("*").alias("n_scores"), F.count(F.when(F.col("fallback"), 1)).alias("n_fallback"))
