"""Line dedup with two Bloom filters.

1. Every task puts the keys of its documents' lines into two Bloom filters: keys seen in one document, and keys seen in more.
   Filters merge block by block, each block on one reducer: a bit is in the merged "twice" filter if it is in one of the "twice"
   filters or in two "once" filters. Only the "twice" filter comes back; its size is a parameter, whatever the input.
2. Keys in that filter are suspects. Only they are shuffled, with their text: exact counts of documents, and the first one.
3. Keys found often enough are looked up in every document. They are broadcast as 128-bit digests, a slice of bounded size at a time.

A filter that is full makes more lines suspects, never fewer, so the results don't depend on its size.

A line's key is the line without ASCII white space at its ends, A-Z in lower case; empty keys are never counted or dropped.

Defined cases: a null or empty text is one empty line and stays as it is; rows count as documents of their own, equal or not;
with ``keep_first``, the row of the smallest id (null ids last) keeps the first line of a key, and rows that share that
id all do; further columns are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WHITE, settled, texts

LOG2_BITS = 27
LOG2_BLOCK = 21
#: Digests broadcast at once; more are taken a slice at a time.
SLICE = 200_000


def keys_of(raw: bytes) -> list[bytes]:
    return [line.strip(WHITE) for line in raw.lower().split(b"\n")]


def hashes_of(keys) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


class Bloom:
    """A Bloom filter of two bits a key, both in the block that the hash's upper bits name."""

    def __init__(self, log2_bits: int, words: np.ndarray | None = None):
        self.log2_bits = log2_bits
        self.block = min(LOG2_BLOCK, log2_bits)
        self.words = np.zeros(1 << (log2_bits - 6), np.uint64) if words is None else words

    def places(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        block = (h >> np.uint64(64 - (self.log2_bits - self.block))) << np.uint64(self.block) if self.log2_bits > self.block else np.zeros_like(h)
        mask = np.uint64((1 << self.block) - 1)
        out = []
        for shift in (0, 22):
            bit = block | ((h >> np.uint64(shift)) & mask)
            out.append(((bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))))
        return out

    def add(self, h: np.ndarray) -> None:
        for at, bit in self.places(h):
            np.bitwise_or.at(self.words, at, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at, bit in self.places(h):
            out &= (self.words[at] & bit) != 0
        return out


def twice_filter(docs: DataFrame, text: str, log2_bits: int = LOG2_BITS) -> np.ndarray:
    """The words of the filter of keys that occur in more than one document."""
    n_blocks = 1 << max(0, log2_bits - LOG2_BLOCK)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(log2_bits), Bloom(log2_bits)
        for batch in batches:
            all_keys: list[bytes] = []
            for raw in texts(batch, 0):
                all_keys += {k for k in keys_of(raw) if k}
            if all_keys:
                h, n = np.unique(hashes_of(all_keys), return_counts=True)
                twice.add(h[(n > 1) | once.has(h)])
                once.add(h)
        for i, (o, t) in enumerate(zip(np.split(once.words, n_blocks), np.split(twice.words, n_blocks), strict=True)):
            if o.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(o, 1)], pa.binary()), pa.array([zlib.compress(t, 1)], pa.binary())], ["block", "once", "twice"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint64) for x in (o, t))
                if i in blocks:
                    have, more = blocks[i]
                    blocks[i] = [have | o, more | t | (have & o)]
                else:
                    blocks[i] = [o, t]
        for i, (_, t) in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(t, 1)], pa.binary())], ["block", "twice"])

    rows = docs.select(text).mapInArrow(filled, "block int, once binary, twice binary").repartition(n_blocks, "block").mapInArrow(merged, "block int, twice binary").toArrow()
    words = np.zeros(1 << (log2_bits - 6), np.uint64)
    size = len(words) // n_blocks
    for i, t in zip(rows.column("block").to_pylist(), rows.column("twice").to_pylist(), strict=True):
        words[i * size : (i + 1) * size] = np.frombuffer(zlib.decompress(t), np.uint64)
    return words


def repeated_keys(docs: DataFrame, key: str, text: str, min_docs: int, keep_first: bool, log2_bits: int) -> DataFrame:
    """digest, first: the keys found in at least ``min_docs`` documents, counted exactly, and the smallest id that has them."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(twice_filter(docs, text, log2_bits), 1))
    kind = docs.schema[key].dataType

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(log2_bits, np.frombuffer(zlib.decompress(shared.value), np.uint64))
        for batch in batches:
            found: dict[bytes, list] = {}
            ids = batch.column(0)
            order = ids.to_pylist() if keep_first else [None] * batch.num_rows
            flat: list[bytes] = []
            owner: list = []
            for i, raw in zip(order, texts(batch, 1), strict=True):
                own = [k for k in set(keys_of(raw)) if k]
                flat += own
                owner += [i] * len(own)
            if not flat:
                continue
            for j in np.flatnonzero(bloom.has(hashes_of(flat))):
                k, i = flat[j], owner[j]
                entry = found.setdefault(k, [0, i])
                entry[0] += 1
                if i is not None and (entry[1] is None or i < entry[1]):
                    entry[1] = i
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([e[0] for e in found.values()], pa.int64()), pa.array([e[1] for e in found.values()], ids.type)], ["line", "n", "first"])

    schema = T.StructType([T.StructField("line", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("first", kind)])
    counted = docs.select(key, text).mapInArrow(suspects, schema).groupBy("line").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= min_docs)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in batch.column(0).to_pylist()], pa.binary()), batch.column(1)], ["digest", "first"])

    return counted.select("line", "first").mapInArrow(digests, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("first", kind)]))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 2, keep_first: bool = True, log2_bits: int = LOG2_BITS, slice_rows: int = SLICE) -> DataFrame:
    """``docs`` without lines whose key is in at least ``min_docs`` documents, and n_lines, n_dropped (replaced if they exist)."""
    repeated = settled(repeated_keys(docs, key, text, min_docs, keep_first, log2_bits))
    total = repeated.count()
    slices = max(1, -(-total // slice_rows))
    out = docs.drop("n_lines", "n_dropped").withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")})
    for i in range(slices):
        part = repeated if slices == 1 else repeated.filter(F.pmod(F.xxhash64("digest"), F.lit(slices)) == i)
        got = part.toArrow()
        digests = dict(zip(got.column("digest").to_pylist(), got.column("first").to_pylist() if keep_first else [False] * got.num_rows, strict=True))
        out = without(out, key, text, digests, keep_first, count=i == 0)
        if i % 4 == 3 and i + 1 < slices:
            out = settled(out)
    return out


def without(docs: DataFrame, key: str, text: str, digests: dict, keep_first: bool, count: bool) -> DataFrame:
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(digests)
    at, ident, lines, dropped = (names.index(n) for n in (text, key, "n_lines", "n_dropped"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = shared.value
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            ids = batch.column(ident).to_pylist() if keep_first else [None] * batch.num_rows
            for i, raw in zip(ids, batch.column(at).cast(pa.binary()).to_pylist(), strict=True):
                parts = (raw or b"").split(b"\n")
                seen: set[bytes] = set()
                stay = []
                for line, k in zip(parts, keys_of(raw or b""), strict=True):
                    if k and known:
                        d = digest(k)
                        if d in known:
                            if not keep_first or known[d] != i or d in seen:
                                continue
                            seen.add(d)
                    stay.append(line)
                n_lines.append(len(parts))
                n_dropped.append(len(parts) - len(stay))
                kept.append(raw if len(stay) == len(parts) else b"\n".join(stay))
            columns = list(batch.columns)
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
            if count:
                columns[lines] = pa.array(n_lines, pa.int64())
            columns[dropped] = pa.array([a + b for a, b in zip(n_dropped, batch.column(dropped).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(cut, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def summary(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return rows.select(key, "n_lines", "n_dropped", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
