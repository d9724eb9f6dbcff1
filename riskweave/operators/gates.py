"""Gates in front of the analysis: which files are taken, and why others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions.columns import contains_any, sanitise_name


#: Reasons of both gates, in the order of their tests.
REASONS = ["EMPTY", "NO_NAME", "PATH_CHARS", "NOT_JAVA", "TOO_LARGE", "BINARY", "NO_TYPE_DECL"]


def upload_reason(name: Column, size: Column, max_bytes: int = K.MAX_FILE_BYTES) -> Column:
    """First failing rule on name and size, null when the file passes."""
    return (
        F.when(size.isNull() | (size == 0), "EMPTY")
        .when(name.isNull() | name.rlike(r"^\s*$"), "NO_NAME")
        .when(contains_any(name, ["..", "/", "\\"]), "PATH_CHARS")
        .when(~F.lower(name).endswith(".java"), "NOT_JAVA")
        .when(size > max_bytes, "TOO_LARGE")
    )


def content_reason(content: Column) -> Column:
    """First failing rule on the content (text or bytes), null when it passes."""
    data = content.cast("binary")
    head = F.substring(data, 1, K.NUL_SCAN_BYTES).cast("string")
    return (
        F.when(content.isNull() | (F.octet_length(data) == 0), "EMPTY")
        .when(F.contains(head, F.char(F.lit(0))), "BINARY")
        .when(~contains_any(data.cast("string"), K.TYPE_WORDS), "NO_TYPE_DECL")
    )


def gate_upload(files: DataFrame, max_bytes: int = K.MAX_FILE_BYTES, name: str = "file_name",
                size: str = "size_bytes") -> DataFrame:
    return files.withColumn("reject_reason", upload_reason(F.col(name), F.col(size), max_bytes))


def gate_content(files: DataFrame, content: str = "src") -> DataFrame:
    return files.withColumn("reject_reason", content_reason(F.col(content)))


def gated(files: DataFrame, max_bytes: int = K.MAX_FILE_BYTES, content: str = "src") -> DataFrame:
    """Both gates, name and size first; adds reject_reason and a safe file name.

    A file without id can't be told from others and is rejected as well.
    """
    reason = F.coalesce(
        F.when(F.col("file_id").isNull(), "NO_FILE_ID"),
        upload_reason(F.col("file_name"), F.col("size_bytes"), max_bytes), content_reason(F.col(content)))
    return files.withColumn("reject_reason", reason).withColumn("safe_name", sanitise_name(F.col("file_name")))


def quarantine_split(files: DataFrame, max_bytes: int = K.MAX_FILE_BYTES,
                     content: str = "src") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted files, rejected files, rejected count per reason)."""
    judged = gated(files, max_bytes, content)
    accepted = judged.where(F.col("reject_reason").isNull()).drop("reject_reason", "safe_name")
    rejected = judged.where(F.col("reject_reason").isNotNull())
    reasons = rejected.groupBy("reject_reason").agg(F.count("*").alias("n_files"))
    return accepted, rejected, reasons


def checksum_size(files: DataFrame, content: str = "src", keep: list[str] | None = None) -> DataFrame:
    """(file_id, checksum_sha256, file_size_bytes) of the file's bytes, and the columns to keep."""
    data = F.col(content).cast("binary")
    return files.select(
        "file_id", *(keep or []), F.sha2(data, 256).alias("checksum_sha256"),
        F.octet_length(data).cast("int").alias("file_size_bytes"))
