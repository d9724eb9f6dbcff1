"""An index of the contents of earlier runs: which run and file had a checksum first.

The index is a table in buckets of the checksum. A run's checksums are set as bits of a
bitmap, a Bloom filter of one hash, which is broadcast: at most ``MOST_CELLS`` rows of 4 KB,
however many checksums there are. The index is scanned bucket by bucket, the filter drops
nearly all of its rows, and what is left meets the run's checksums. Only these are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources.bucketed import BUCKETS, append, bucketed_table

#: Bits of a row of the filter, as Spark's bitmaps have them.
CELL_BITS = 32_768
#: Bits per checksum while the filter can still grow, and its largest size (16 MB).
BITS_PER_KEY, MOST_CELLS = 16, 4_096
COLUMNS = "checksum_sha256 string, seen_file string, n_files bigint, run_date string, run_id string"


class ChecksumIndex:
    """Checksums of earlier runs at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.buckets = spark, buckets
        self.name = bucketed_table(spark, path, COLUMNS, "checksum_sha256", buckets)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, checksums: DataFrame) -> DataFrame:
        """(checksum_sha256, seen_file, seen_date, seen_run): the first run that had each of these checksums.

        ``checksums`` has them as ``checksum_sha256``, better stored than computed: they are
        counted, made into the filter and joined.
        """
        wanted = checksums.select("checksum_sha256").distinct()
        cells = 1
        while cells < MOST_CELLS and cells * CELL_BITS < BITS_PER_KEY * wanted.count():
            cells *= 2
        earliest = F.min(F.struct("run_date", "run_id", "seen_file")).alias("first")
        found = self._probed(wanted, cells).join(wanted, "checksum_sha256", "left_semi").groupBy("checksum_sha256").agg(earliest)
        return found.select("checksum_sha256", F.col("first.seen_file").alias("seen_file"), F.col("first.run_date").alias("seen_date"),
                            F.col("first.run_id").alias("seen_run"))

    def _probed(self, wanted: DataFrame, cells: int) -> DataFrame:
        """Rows of the index whose bit is set."""
        hashed = F.pmod(F.xxhash64("checksum_sha256"), F.lit(cells * CELL_BITS))
        bits = wanted.select((hashed % CELL_BITS).alias("bit"), F.floor(hashed / CELL_BITS).alias("cell")).groupBy("cell").agg(
            F.bitmap_construct_agg("bit").alias("bitmap"))
        placed = self.rows.withColumns({"bit": hashed % CELL_BITS, "cell": F.floor(hashed / CELL_BITS)})
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
        return placed.join(F.broadcast(bits), "cell").where(is_set).drop("bit", "cell", "bitmap")

    def add(self, sums: DataFrame, run_date: str, run_id: str) -> None:
        """Add the checksums of a run that the index does not have; ``sums``: file_id, checksum_sha256."""
        own = sums.groupBy("checksum_sha256").agg(F.min("file_id").cast("string").alias("seen_file"), F.count("*").alias("n_files"))
        new = own.join(self.lookup(sums).select("checksum_sha256"), "checksum_sha256", "left_anti")
        append(new.withColumns({"run_date": F.lit(run_date), "run_id": F.lit(run_id)}), self.name, "checksum_sha256", self.buckets)
