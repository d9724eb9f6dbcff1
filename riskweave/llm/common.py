"""What the corpus operators share: the word rule, stored stages, seeded places in an order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.plans.stage import work_folder

#: A word is a run without blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write the rows to the shared folder and go on from the files.

    Unlike a checkpoint this keeps columns apart, so that later plans read only
    those they need. A lost executor costs reading them once more. The schema is
    known, so no job has to look it up in the files.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hidden(docs: DataFrame, **terms: Column) -> DataFrame:
    """The documents as one column ``row`` and further terms: whatever names documents have, they meet none of an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[term.alias(name) for name, term in terms.items()])


def free_name(name: str, taken: list[str]) -> str:
    """The name, or its first numbered form that is not taken (in any case)."""
    known, n, found = {t.lower() for t in taken}, 1, name
    while found.lower() in known:
        n, found = n + 1, f"{name}_{n + 1}"
    return found


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fine_bucket(order: Column, buckets: Column) -> Column:
    """Number of the bucket of a hex digest when ``buckets`` of them share its range evenly, in order."""
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))).cast("long")


def running_start(rows: DataFrame, group: str, bucket: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows before a row in its group.

    A group may hold any share of the rows: rows are summed inside buckets that
    cut the group's order into about as many parts as a part has rows, and the
    parts' totals give each part its offset.
    """
    parts = rows.groupBy(group, bucket).agg(F.sum(amount).alias("_part"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, bucket, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(parts, [group, bucket])
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_offset")
    )


def words_of(text: bytes) -> list[bytes]:
    """The words of a text: bytes.split() parts at exactly the six separators of WORD."""
    return text.split()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text of a batch; a null is an empty text."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs whose sizes sum to about ``limit``; a larger item is a run of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def numbered(words: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words only, and the distinct words."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
