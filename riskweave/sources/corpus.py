"""Reading source files and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.columns import sanitise_name

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; malformed bytes become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def as_source_files(raw: DataFrame) -> DataFrame:
    """binaryFile rows as (file_id, file_name, content, src, size_bytes).

    The id is a 128-bit digest of the path: stable over reruns, independent of the
    number of partitions, and without collisions among any number of files.
    """
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        path_id().alias("file_id"), name.alias("file_name"), "content",
        decoded(F.col("content")).alias("src"), F.col("length").alias("size_bytes"))


def path_id() -> Column:
    return F.substring(F.sha2("path", 256), 1, 32)


def _folder(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def scan_corpus(spark: SparkSession, path: str, fmt: str = "binaryFile", glob: str | None = None,
                max_bytes: int | None = None) -> DataFrame:
    """A folder tree of files, or a table that already has the source_files columns.

    With ``max_bytes`` the reader leaves larger files of a folder unopened;
    ``oversized_files`` reports them.
    """
    if fmt != "binaryFile":
        return with_size(spark.read.format(fmt).load(path))
    raw = _folder(spark, path, glob)
    return as_source_files(raw if max_bytes is None else raw.where(F.col("length") <= max_bytes))


def oversized_files(spark: SparkSession, path: str, max_bytes: int, glob: str | None = None) -> DataFrame:
    """The files that ``scan_corpus`` leaves unopened, in the columns of rejected files."""
    large = _folder(spark, path, glob).where(F.col("length") > max_bytes)
    name = sanitise_name(F.element_at(F.split("path", "/"), -1))
    return large.select(path_id().alias("file_id"), name.alias("safe_name"), F.lit("TOO_LARGE").alias("reject_reason"),
                        F.lit(None).cast("int").alias("line"))


def with_size(files: DataFrame) -> DataFrame:
    if "size_bytes" in files.columns:
        return files
    return files.withColumn("size_bytes", F.octet_length("src").cast("int"))


def write_results(results: DataFrame, path: str, run_date: str | Column, mode: str = "overwrite") -> None:
    """Write one run's rows under its date and, where they carry it, its run id.

    A repeated run replaces its own rows only; other runs of the day stay.
    """
    day = F.lit(run_date) if isinstance(run_date, str) else run_date
    parts = ["run_date", *(["run_id"] if "run_id" in results.columns else [])]
    (results.withColumn("run_date", day).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))
