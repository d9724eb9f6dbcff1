"""Token-id files: one wavelet matrix per shard.

Documents are range-partitioned by id, encoded, closed by an end id, and each run of
about ``SHARD_IDS`` ids becomes one wavelet-matrix file: 16 bit-planes for a vocabulary
of up to 65,536 ids, with their ranks. Token access, counting and occurrence lookup work on
the file without a second index (``count_token``, ``find_token``). Spark writes the files as rows of a
Parquet folder (one row per file), so that they reach any store that Spark reaches.

Reading decodes each file, cuts it at its documents, and adds the ids of all files
before it.

Defined results: a null text counts as an empty one (the end id only); null ids come
first; rows of one id stand in the order of their texts' hashes; repeated rows are
written each; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import runs
from riskweave.llm.pieces import JOINED, Pieces, kept_in_worker, library
from riskweave.llm.wavelet import WaveletMatrix
from riskweave.plans.stage import work_folder

END_ID = 0
#: Ids of a file, roughly: a file ends with the document that reaches this.
SHARD_IDS = 2_000_000
#: Bytes of texts whose distinct pieces are looked up together.
RUN_BYTES = 1 << 24
#: Pieces that a worker remembers.
REMEMBERED = 1_800_000

FILE_SCHEMA = (
    "file string, first_doc long, first_order long, n_ids long, doc_ids array<long>, doc_lengths array<long>, matrix binary"
)
DOC_SCHEMA = "file string, doc_id long, offset long, n_tokens long, ids_crc32 long"


def encoded(pieces: Pieces, texts: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts one after the other, each closed by the end id, and each text's number of ids.

    Each distinct piece is looked up once; the ids of all places are gathered from the distinct
    pieces' ids. A text whose blanks join other white space is encoded as a whole.
    """
    split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy()
    firsts, pieces_of_all = offsets[:-1], split.flatten()
    head_texts, coded = pieces_of_all.take(pa.array(firsts)).to_pylist(), pieces_of_all.dictionary_encode()
    del split, pieces_of_all
    entry = coded.indices.to_numpy(zero_copy_only=False).copy()  # 32 bits: a run is bounded
    values = pieces.looked_up(coded.dictionary.to_pylist())
    del coded
    heads = pieces.looked_up([(x,) for x in head_texts])
    if JOINED in values:
        inside = np.array([v is JOINED for v in values])[entry]
        inside[firsts] = False  # a text's first piece has no blank before it
        for i in np.flatnonzero(np.add.reduceat(inside, firsts)).tolist():
            heads[i] = pieces.value(pieces.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
            entry[offsets[i] : offsets[i + 1]] = len(values)
    # the end id of a text leads the next one's first piece
    end = np.array([END_ID], kind).tobytes()
    table = [b"" if v is JOINED else v for v in values] + [b""] + [end + h if i else h for i, h in enumerate(heads)] + [end]
    entry[firsts] = len(values) + 1 + np.arange(len(texts))
    entry = np.append(entry, np.int32(len(table) - 1))
    del values
    sizes = np.fromiter(map(len, table), np.int32, len(table)) // np.dtype(kind).itemsize
    ids, starts = np.frombuffer(b"".join(table), kind), np.cumsum(sizes) - sizes
    del table
    long = sizes[entry]
    lengths = np.add.reduceat(long[:-1], firsts, dtype=np.int64) + 1
    lengths[1:] -= 1
    # the place of each id among the distinct pieces' ids: where its piece begins there, and on by one
    ends = np.cumsum(long, dtype=np.int64)
    at = np.repeat((starts[entry] - (ends - long)).astype(np.int32), long)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], lengths


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode all documents in ascending id order into wavelet-matrix files below ``path``."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    size = library(vocabulary).get_vocab_size()
    bits = max(1, (size - 1).bit_length())
    kind, code = (np.uint16, "H") if bits <= 16 else (np.uint32, "I")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_in_worker(f"ids {vocabulary}", lambda: Pieces(library(vocabulary), lambda found: array(code, found).tobytes(), remembered=REMEMBERED))
        part, made = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        first, total = (None, 0), 0

        def file() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(ids), bits).to_bytes()
            return pa.RecordBatch.from_pydict({
                "file": pa.array([f"{part:06d}-{made:06d}"]), "first_doc": pa.array([first[0]], pa.int64()),
                "first_order": pa.array([first[1]], pa.int64()), "n_ids": pa.array([total], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "doc_lengths": pa.array([lengths], pa.list_(pa.int64())),
                "matrix": pa.array([matrix], pa.binary()),
            })

        for batch in batches:
            texts = batch.column("text").fill_null("")
            keys = batch.column("doc_id").to_pylist()
            order = batch.column("text_order").to_pylist()
            for a, b in runs(pc.binary_length(texts).to_pylist(), RUN_BYTES):
                found, counts = encoded(pieces, texts.slice(a, b - a), kind)
                pa.default_memory_pool().release_unused()
                ends = np.cumsum(counts)
                at = low = 0  # documents and ids of the run that are in files
                while at < b - a:
                    if not doc_ids:
                        first = (keys[a + at], order[a + at])
                    until = min(b - a, int(np.searchsorted(ends, low + shard_ids - total)) + 1)
                    high = int(ends[until - 1])
                    ids.append(found[low:high])
                    doc_ids += keys[a + at : a + until]
                    lengths += counts[at:until].tolist()
                    total, at, low = total + high - low, until, high
                    if total >= shard_ids:
                        yield file()
                        made += 1
                        ids, doc_ids, lengths, total = [], [], [], 0
        if doc_ids:
            yield file()

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("text_order"))
    ordered = ordered.repartitionByRange("doc_id", "text_order").sortWithinPartitions("doc_id", "text_order")
    ordered.mapInArrow(build, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: ids before it, its ids, and their CRC as little-endian 32-bit integers."""
    files = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = WaveletMatrix.from_bytes(batch.column("matrix")[row].as_py()).decode().astype("<u4")
                lengths = np.array(batch.column("doc_lengths")[row].as_py(), np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                data = memoryview(ids.tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([batch.column("file")[row].as_py()] * len(lengths)),
                    "doc_id": pa.array(batch.column("doc_ids")[row].as_py(), pa.int64()),
                    "offset": pa.array(starts), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    # one row per file, some millions at the most
    in_order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_order", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("n_ids").over(in_order), F.lit(0)).alias("before"))
    rows = files.select("file", "doc_ids", "doc_lengths", "matrix").mapInArrow(decode, DOC_SCHEMA)
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(file, doc_id, document, place): every place of an id in the files, by occurrence lookup; files without it are not decoded.

    ``document`` numbers the documents of a file from 0, ``place`` the ids of a document.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix = WaveletMatrix.from_bytes(batch.column("matrix")[row].as_py())
                if not matrix.count(token):
                    continue
                places = matrix.occurrences(token)
                ends = np.cumsum(np.array(batch.column("doc_lengths")[row].as_py(), np.int64))
                document = np.searchsorted(ends, places, "right")
                starts = np.append(0, ends)[document]
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([batch.column("file")[row].as_py()] * len(places)), "doc_id": batch.column("doc_ids")[row].values.take(pa.array(document)),
                    "document": pa.array(document), "place": pa.array(places - starts),
                })

    files = spark.read.parquet(path).select("file", "doc_ids", "doc_lengths", "matrix")
    return files.mapInArrow(look, "file string, doc_id long, document long, place long")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(file, n): how often an id stands in each file; a rank and a block of each plane are read at either end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [WaveletMatrix.from_bytes(x).count(token) for x in batch.column("matrix").to_pylist()]
            yield pa.RecordBatch.from_pydict({"file": batch.column("file"), "n": pa.array(n, pa.int64())})

    return spark.read.parquet(path).select("file", "matrix").mapInArrow(count, "file string, n long")


def token_file_rows(docs: DataFrame, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the files to the shared folder and report each document as read back."""
    path = work_folder(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary, shard_ids)
    return read_token_files(docs.sparkSession, path)
