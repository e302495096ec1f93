"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: ``spark.checkpoint.dir``. Only a local session may do without: it gets a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    scratch(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the scratch folder as compressed Parquet and read again: for tables with texts, which checkpoints keep uncompressed."""
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_bucket(doc_id, modulus: int = 5) -> int:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def id_bucket_column(doc_id, modulus: int = 5):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def thinned(docs: DataFrame, rows: int) -> DataFrame:
    """About so many rows, chosen evenly in every partition and left where they are; for measurements that decide speed only."""
    n = docs.count()
    return docs if n <= rows else docs.filter(F.rand(42) < rows / n)


def texts(batch: pa.RecordBatch, column: str | int = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def sliced(batches, rows: int = 256):
    """The batches in slices of so many rows, which bounds what a worker holds besides."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class BitFilter:
    """A filter's words, compressed for the broadcast and unpacked once by each worker."""

    _unpacked: dict = {}

    def __init__(self, words: np.ndarray):
        self.tag, self.blob = uuid.uuid4().hex, zlib.compress(words.tobytes(), 1)

    @property
    def words(self) -> np.ndarray:
        held = BitFilter._unpacked
        if self.tag not in held:
            if len(held) >= 5:
                held.clear()
            held[self.tag] = np.frombuffer(zlib.decompress(self.blob), np.uint64)
        return held[self.tag]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session sends whole texts to Python by so many rows, not 10,000: a batch is held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def released(batches):
    """The batches of a task; after the last, the worker gives back what it held, as it may wait long for its next task."""
    try:
        yield from batches
    finally:
        BitFilter._unpacked.clear()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (multiply-xorshift), vectorised; overflow wraps."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def merged_bits(rows, log2_bits: int) -> np.ndarray:
    """A bit array of 2**log2_bits bits from (word index, word) rows."""
    words = np.zeros(1 << (log2_bits - 6), np.uint64)
    for batch in rows:
        if batch.num_rows:
            words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return words


def hash_filter(hashes: DataFrame, log2_bits: int) -> np.ndarray:
    """One bit for each 64-bit value of the column ``h``: a filter of fixed size, whatever the number of rows.

    A superset test: it never misses a member, and passes others at a rate of about members / 2**log2_bits.
    Rows that come to the driver: at most 2**(log2_bits - 6), by construction.
    """
    bit = F.shiftrightunsigned("h", 64 - log2_bits)
    rows = hashes.groupBy(F.shiftrightunsigned(bit, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - log2_bits}) & 63 AS int)))").alias("bits"))
    return merged_bits(rows.toArrow().to_batches(), log2_bits)


def in_filter(words: np.ndarray, hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    bit = hashes >> np.uint64(64 - log2_bits)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


class Shared:
    """A broadcast filter."""

    def __init__(self, spark, words: np.ndarray):
        self.shared = spark.sparkContext.broadcast(BitFilter(words))

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        words = self.shared.value.words
        return in_filter(words, hashes, len(words).bit_length() + 5)

    def column(self, column: str) -> Column:
        """Whether a column of signed hashes is in the filter. Only that column goes to Python."""

        @F.arrow_udf("boolean")
        def hit(h: pa.Array) -> pa.Array:
            return pa.array(self.hit(h.to_numpy(zero_copy_only=False).view(np.uint64)))

        return hit(column)
