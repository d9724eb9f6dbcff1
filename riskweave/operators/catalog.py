"""The weakness catalog and the signature table as small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions.columns import score_band
from riskweave.functions.texts import SIGNATURE_TEXTS


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.CATALOG, K.CATALOG_DDL)


def signature_table(spark: SparkSession) -> DataFrame:
    rows = [(seq, name, severity, owasp, SIGNATURE_TEXTS[name][2])
            for seq, (name, _, severity, owasp) in enumerate(K.SIGNATURES, 1)]
    return spark.createDataFrame(
        rows, "sig_seq int, vulnerability_type string, severity double, owasp_category string, anchor string")


def catalog_lookup(rows: DataFrame, type_col: str = "vulnerability_type") -> DataFrame:
    """Add display_name, severity, category, owasp_category, rule_confidence and is_known.

    The type is looked up in upper case; unknown and null types get the default entry.
    """
    # nine fixed rows: always small enough to broadcast
    entries = F.broadcast(catalog(rows.sparkSession).withColumnRenamed("vulnerability_type", "catalog_key"))
    return (
        rows.join(entries, F.upper(F.col(type_col)) == F.col("catalog_key"), "left")
        .withColumn("is_known", F.col("catalog_key").isNotNull())
        .withColumn("display_name", F.coalesce("display_name", F.lit(K.UNKNOWN_DISPLAY)))
        .withColumn("severity", F.coalesce("severity", F.lit(K.UNKNOWN_SEVERITY)))
        .withColumn("category", F.coalesce("category", F.lit(K.UNKNOWN_CATEGORY)))
        .withColumn("rule_confidence", F.coalesce("rule_confidence", F.lit(K.UNKNOWN_CONFIDENCE)))
        .drop("catalog_key")
    )


def banded_severity(is_known: Column, catalog_severity: Column, score: Column) -> Column:
    """Catalog band of a known type, else the band of the numeric score."""
    return F.when(is_known, catalog_severity).otherwise(score_band(score))


def catalog_coverage(spark: SparkSession, rule_types: DataFrame) -> DataFrame:
    """Per type: in the catalog? found by a structural rule? by a signature?"""
    known = catalog(spark).select("vulnerability_type", F.lit(True).alias("in_catalog"))
    rules = rule_types.select("vulnerability_type").distinct().withColumn("has_rule", F.lit(True))
    signatures = signature_table(spark).select("vulnerability_type", F.lit(True).alias("has_signature"))
    flags = ["in_catalog", "has_rule", "has_signature"]
    return (
        known.join(rules, "vulnerability_type", "full").join(signatures, "vulnerability_type", "full")
        .select("vulnerability_type", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
    )


def uncatalogued_signatures(spark: SparkSession) -> DataFrame:
    """Signature types missing from the catalog; must stay empty."""
    return signature_table(spark).join(catalog(spark), "vulnerability_type", "left_anti")


def catalog_listing(spark: SparkSession) -> DataFrame:
    return catalog(spark).select("vulnerability_type", "display_name", "severity", "category", "owasp_category")


def catalog_counts(spark: SparkSession) -> DataFrame:
    """Number of types per category and OWASP class."""
    return catalog(spark).groupBy("category", "owasp_category").agg(F.count("*").alias("n_types"))
