"""Token counts: a broadcast table of frequent pieces, and worker caches for the rest.

The lengths of the most frequent pre-token pieces are broadcast: at most
``FREQUENT`` pieces of at most ``LONGEST_PIECE`` characters, so the table has a fixed
bound. They come from a bounded sample of documents and only save work; each
worker encodes what the table misses and remembers it up to a bound. No piece is
shuffled.

Defined results: a null text counts as an empty one (no bytes, no tokens); rows with
null or repeated ids are counted one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import runs
from riskweave.llm.pieces import Pieces, kept_in_worker, library

LIMIT = 512
FREQUENT = 32_768
LONGEST_PIECE = 48
#: Documents of the sample from which the frequent pieces are taken.
SAMPLE = 2_000
#: Characters of text whose unknown pieces are encoded in one call.
RUN_CHARS = 1 << 20

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def frequent_pieces(docs: DataFrame, sample: int = SAMPLE, most: int = FREQUENT) -> list[str]:
    """The most frequent pieces with a leading blank in a sample of documents."""
    one_in = max(1, docs.count() // sample)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text").limit(2 * sample)
    pieces = some.select(F.explode(F.slice(F.split("text", " "), 2, 1 << 30)).alias("piece"))
    pieces = pieces.filter((F.length("piece") <= LONGEST_PIECE) & F.col("piece").rlike(r"^[^\s\p{Z}\p{C}]"))
    top = pieces.groupBy("piece").count().orderBy(F.desc("count"), "piece").limit(most)
    return [r["piece"] for r in top.collect()]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, sample: int = SAMPLE) -> DataFrame:
    """Bytes and tokens of each document, and whether it has more tokens than ``limit``."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    local = Pieces(library(path), len)
    local.values([" ".join(["", *frequent_pieces(docs, sample)])])
    frequent = docs.sparkSession.sparkContext.broadcast(local.table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_in_worker(f"lengths {path}", lambda: Pieces(library(path), len, frequent.value))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens: list[int] = []
            for a, b in runs([len(t) for t in texts], RUN_CHARS):
                tokens += map(sum, pieces.values(texts[a:b]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
            })

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
