"""Structural rules: predicates over code sites, all evaluated in one pass.

A rule is a condition on one site row, so the ten rules cost one projection
and one explode; the sites are neither scanned again nor shuffled per rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions.columns import contains_any, env_name, truncate
from riskweave.functions.texts import RULE_TEXTS
from riskweave.operators.catalog import catalog_lookup


# report order; a type may be found by more than one rule
RULE_ORDER = {
    "rule_sql_inline": "SQL_INJECTION", "rule_sql_variable": "SQL_INJECTION",
    "rule_hardcoded_secret": "HARDCODED_SECRET", "rule_weak_crypto": "WEAK_CRYPTOGRAPHY",
    "rule_command_exec": "COMMAND_INJECTION", "rule_command_builder": "COMMAND_INJECTION",
    "rule_path_traversal": "PATH_TRAVERSAL", "rule_empty_catch": "EMPTY_CATCH_BLOCK",
    "rule_concat_in_loop": "STRING_CONCAT_IN_LOOP", "rule_resource_leak": "RESOURCE_LEAK",
}


def rules() -> dict[str, Column]:
    """Rule name -> condition on a site."""
    c = F.col
    kind, name = c("kind"), c("name")
    call = (kind == "call") & ~c("is_new")
    creation = (kind == "call") & c("is_new")
    value = c("value")
    sql_init = c("has_plus") & ~c("breaks_line") & c("code").rlike(K.SQL_WORDS)
    secret = (
        name.rlike(K.SECRET_NAME) & (F.length(value) >= K.MIN_SECRET_CHARS) & ~value.rlike(K.PLACEHOLDER)
    )
    scope = F.substring(c("code"), F.lit(1), c("scope_chars"))
    algorithm = F.upper(c("string_arg"))
    weak = F.lit(False)
    for prefix in K.WEAK_PREFIXES:
        weak = weak | algorithm.startswith(prefix)
    managed = F.array_contains(c("managed_types"), name)
    return {
        "rule_sql_inline": call & name.isin(K.SQL_CALLS) & c("sql_arg"),
        "rule_sql_variable": (kind == "init") & sql_init,
        "rule_hardcoded_secret": (kind == "init") & value.isNotNull() & secret,
        "rule_weak_crypto":
            call & (name == "getInstance") & contains_any(scope, K.CRYPTO_SCOPES) & weak,
        "rule_command_exec": call & (name == "exec") & c("has_plus"),
        "rule_command_builder": creation & (name == "ProcessBuilder") & c("has_plus"),
        "rule_path_traversal": creation & name.isin(K.FILE_TYPES) & c("has_plus"),
        "rule_empty_catch": kind == "catch",
        "rule_concat_in_loop": (kind == "append") & c("in_loop"),
        "rule_resource_leak": creation & name.isin(K.CLOSEABLE_TYPES) & ~managed,
    }


def rule_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULE_ORDER.items()), "rule string, vulnerability_type string")


def rule_hits(sites: DataFrame, only: str | None = None) -> DataFrame:
    """Raw hits: (file_id, rule_seq, rule, vulnerability_type, pos, end_pos, line, ...)."""
    conditions = rules()
    picked = [
        F.when(conditions[rule], F.struct(F.lit(seq).alias("rule_seq"), F.lit(rule).alias("rule"),
                                          F.lit(kind).alias("vulnerability_type")))
        for seq, (rule, kind) in enumerate(RULE_ORDER.items(), 1)
        if only in (None, rule)
    ]
    return (
        sites.where(F.col("kind").isin("call", "init", "catch", "append"))
        .withColumn("hit", F.explode(F.array_compact(F.array(*picked))))
        .select(
            "file_id", "hit.*", "pos", "end_pos", "line",
            F.coalesce("method_name", F.lit(K.NO_METHOD)).alias("method_name"),
            F.coalesce("class_name", F.lit(K.NO_CLASS)).alias("class_name"),
            F.col("code").alias("node"),
            F.col("name").alias("slot_name"),
            F.col("string_arg").alias("slot_value"),
        )
    )


def finding_texts(hits: DataFrame) -> DataFrame:
    """Add description and remediation, with the slots of the rule filled in."""
    handler = F.regexp_extract("node", r"(?s)^catch\s*\(\s*(?:final\s+)?(.*?)\s*([\p{L}\p{N}_$]+)\s*\)", 1)
    variable = F.regexp_extract("node", r"(?s)^catch\s*\(\s*(?:final\s+)?(.*?)\s*([\p{L}\p{N}_$]+)\s*\)", 2)
    is_catch = F.col("rule") == "rule_empty_catch"
    slots = {
        "{name}": F.col("slot_name"),
        "{detail}": F.when(is_catch, handler).otherwise(F.col("slot_value")),
        "{param}": F.when(is_catch, variable),
        "{env}": env_name(F.col("slot_name")),
    }

    def filled(position: int) -> Column:
        text = F.when(F.lit(False), "")
        for rule, texts in RULE_TEXTS.items():
            text = text.when(F.col("rule") == rule, texts[position])
        for slot, value in slots.items():
            text = F.replace(text, F.lit(slot), F.coalesce(value, F.lit("")))
        return text

    return hits.withColumn("description", filled(0)).withColumn("remediation", filled(1))


def enriched(hits: DataFrame) -> DataFrame:
    """Hits with catalog data, texts and their place in the file's finding list."""
    in_list = Window.partitionBy("file_id").orderBy("rule_seq", "end_pos", F.desc("pos"))
    return (
        catalog_lookup(finding_texts(hits))
        .withColumn("list_seq", F.row_number().over(in_list))
        .select(
            "file_id", "list_seq", "rule", "vulnerability_type", "display_name", "severity", "category",
            "owasp_category", "method_name", "class_name", F.col("line").alias("line_number"),
            truncate(F.col("node")).alias("code_snippet"), "description", "remediation",
            F.col("rule_confidence").alias("confidence"), F.lit("STATIC").alias("detection_source"),
        )
    )


def static_findings(sites: DataFrame) -> DataFrame:
    """All structural findings of every file."""
    return enriched(rule_hits(sites))
