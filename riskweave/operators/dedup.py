"""Files whose identical content was seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.gates import checksum_size
from riskweave.plans.stage import staged

# Parts into which the files of one checksum are dealt.
SALTS = 64


def reupload_groups(files: DataFrame, content: str = "src") -> DataFrame:
    """(checksum_sha256, n_copies, first_file): one row per distinct content.

    Only counts and minima cross the exchange, combined per task first, so the
    copies of one frequent file never meet in one task.
    """
    return checksum_size(files, content).groupBy("checksum_sha256").agg(
        F.count("*").alias("n_copies"), F.min("file_id").alias("first_file"))


def stored_checksums(files: DataFrame, content: str = "src") -> DataFrame:
    """(file_id, checksum_sha256), stored: the content is read and hashed once."""
    return staged(checksum_size(files, content).select("file_id", "checksum_sha256"), "checksums")


def reupload_dedup(files: DataFrame, content: str = "src", salts: int = SALTS) -> DataFrame:
    """(file_id, checksum_sha256, n_copies, first_file, is_reupload) of every file.

    The content is hashed once and only ids and checksums are stored. Copies are
    dealt into salted parts, counted per part first, and get the totals through
    their part: a frequent checksum costs ``salts`` rows and keeps as many tasks busy.
    """
    return _copies(stored_checksums(files, content), salts, None).withColumn("is_reupload", F.col("file_id") != F.col("first_file"))


def reupload_across_runs(sums: DataFrame, seen: DataFrame, salts: int = SALTS) -> DataFrame:
    """``reupload_dedup`` of a run's checksums, and the earlier run that had the content first.

    ``sums``: what ``stored_checksums`` gives. ``seen``: what an index of earlier runs knows of
    them (``ChecksumIndex.lookup``); no content is read. Adds seen_file, seen_date, seen_run, null for new content.
    """
    again = (F.col("file_id") != F.col("first_file")) | F.col("seen_run").isNotNull()
    return _copies(sums, salts, seen).withColumn("is_reupload", again)


def _copies(sums: DataFrame, salts: int, seen: DataFrame | None) -> DataFrame:
    sums = sums.withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(salts)))
    parts = sums.groupBy("checksum_sha256", "salt").agg(F.count("*").alias("n"), F.min("file_id").alias("first"))
    totals = parts.groupBy("checksum_sha256").agg(F.sum("n").alias("n_copies"), F.min("first").alias("first_file"))
    totals = totals if seen is None else totals.join(seen, "checksum_sha256", "left")
    known = parts.select("checksum_sha256", "salt").join(totals, "checksum_sha256")
    return sums.join(known, ["checksum_sha256", "salt"]).drop("salt")
