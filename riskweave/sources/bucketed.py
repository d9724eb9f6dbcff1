"""Tables that lie in buckets of a key, so that joins and groupings by that key move nothing."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def bucketed_table(spark: SparkSession, path: str, columns: str, key: str, buckets: int = BUCKETS) -> str:
    """Name of the table at ``path``; it is made where it does not exist.

    The files are the table: any session that opens the path with the same columns, key and
    number of buckets sees the same rows.
    """
    name = f"riskweave_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key})"
              f" INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return name


def append(rows: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> None:
    """Add rows; a task writes whole buckets, so a run adds one file per bucket."""
    table = rows.sparkSession.table(name)
    rows.select(*table.columns).repartition(buckets, key).write.insertInto(name)
    rows.sparkSession.catalog.refreshTable(name)


# --- source files -------------------------------------------------------------

def store_sources(files: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Keep source files in buckets of their id, so that later analyses do not move their texts."""
    kinds = dict(files.dtypes)
    wanted = [c for c in ("file_id", "file_name", "src", "size_bytes") if c in kinds]
    spark = files.sparkSession
    name = bucketed_table(spark, path, ", ".join(f"{c} {kinds[c]}" for c in wanted), "file_id", buckets)
    append(files, name, "file_id", buckets)


def stored_sources(spark: SparkSession, path: str, columns: str, buckets: int = BUCKETS) -> DataFrame:
    """The files that ``store_sources`` kept, with these columns (as DDL)."""
    return spark.table(bucketed_table(spark, path, columns, "file_id", buckets))
