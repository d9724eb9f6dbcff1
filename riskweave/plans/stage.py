"""Where intermediate results live, and cutting a plan at a stored stage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_STAGES: ContextVar[list[str] | None] = ContextVar("stages", default=None)


def work_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session may go without one; it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return os.path.dirname(chosen.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="riskweave-")


def work_folder(spark: SparkSession, purpose: str) -> str:
    return f"{work_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Store the rows as Parquet in the shared folder and go on from the files.

    Several plans read the result without computing it again, each only the columns
    it needs, and a lost executor costs nothing but reading it once more. The
    folder belongs to the session's owner, who clears it after the run; inside
    ``stages_removed`` it goes with the block.
    """
    path = work_folder(df.sparkSession, purpose)
    stages = _STAGES.get()
    if stages is not None:
        stages.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def stages_removed(spark: SparkSession) -> Iterator[None]:
    """Stages that are stored in this block are deleted at its end."""
    made: list[str] = []
    token = _STAGES.set(made)
    try:
        yield
    finally:
        _STAGES.reset(token)
        for path in made:
            remove(spark, path)
