"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document is contaminated by an item if a window of as many words as the item has a weighted similarity of at least
``threshold`` to it: the sum of the smaller over the sum of the larger weights of their shingles of five words, a shingle's weight
being its count.

1. A window over the threshold holds shingles of the benchmark, whichever, in at least ``2 t / (1 + t)`` of its places (t: the
   threshold). Windows of the items' lengths that hold fewer are not looked at. This loses nothing and names no item.
2. Every other window gets a SimHash of 64 bits, and so has every item. Fingerprints are cut into ``BLOCKS`` blocks of 16 bits; two within
   ``RADIUS`` bits agree in one block but for ``SPREAD`` bits at least. An index lists each item under all values of each block that
   near, so the four lookups of a window find every item of its length within the radius, and few others: an unrelated fingerprint is
   listed with a chance of 4 %.
3. The weighted similarity of what was found is computed exactly.

A window of similarity 0.8 is 9.7 bits from its item on the average and beyond the radius with a chance of 3 %; of 0.85, 1 %; exact
passages have no distance. README has the recall that was measured.

The benchmark is broadcast a part of bounded size at a time; a larger one takes more passes over the documents.

Words: ASCII white space and punctuation separate them, A-Z in lower case. Defined cases: null or empty texts and items
match nothing; items of under five words have one shingle, the whole; ids may repeat or be null; each row of
``documents`` is judged by itself; further columns are ignored by ``matches`` and kept by ``clean``; long texts are searched around
the places that hold shingles of the benchmark; of equally similar windows the first counts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import mix64, texts

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS = 4
SPREAD = 3
RADIUS = BLOCKS * (SPREAD + 1) - 1
#: Bytes of benchmark text in one broadcast index, about: an item takes 33 kB of a worker's memory.
PART_BYTES = 1 << 20
SEPARATORS = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
K = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(SEPARATORS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Of all runs of ``size`` word hashes; of the whole if there are fewer."""
    size = min(size, len(h))
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        out = mix64(out * K + h[i : len(h) - size + 1 + i])
    return out


def bits_of(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.int32) * 2 - 1


def packed(ones: np.ndarray) -> np.ndarray:
    """Fingerprints given as (n, 64) booleans, as 64-bit values."""
    return np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)


def near_masks(bits: int = 16, spread: int = SPREAD) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(spread + 1) for c in combinations(range(bits), k)], np.int64)


class Index:
    """Items with their shingles and fingerprints, listed by length and block values."""

    def __init__(self, rows: list[tuple[object, bytes]], threshold: float):
        self.items: list[tuple[object, int, Counter]] = []
        self.threshold = threshold
        shingles: set[int] = set()
        vocabulary: set[bytes] = set()
        fps = []
        for key, raw in rows:
            words = words_of(raw)
            if not words:
                continue
            h = shingle_hashes(word_hashes(words))
            counts = Counter(h.tolist())
            self.items.append((key, len(words), counts))
            vocabulary.update(words)
            shingles.update(counts)
            fps.append(bits_of(h).sum(axis=0) > 0)
        #: lengths of the items
        self.lengths = sorted({n for _, n, _ in self.items})
        self.short = {n for n in self.lengths if n < SHINGLE}
        self.sorted = np.array(sorted(shingles), np.uint64)
        self.vocabulary = {w: i for i, w in enumerate(sorted(vocabulary))}
        self.vocabulary_hashes = word_hashes(sorted(vocabulary))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.sorted >> np.uint64(44)] = True
        self.fp = packed(np.array(fps)) if fps else np.zeros(0, np.uint64)
        masks = near_masks()
        length = np.array([self.lengths.index(n) for _, n, _ in self.items], np.int64)
        listed = (self.places(length, self.fp)[:, :, None] ^ masks).reshape(-1)
        order = np.argsort(listed, kind="stable")
        #: a length and a block with its value; and the items that are listed there
        self.listed, self.owner = listed[order], (order // (BLOCKS * len(masks))).astype(np.int32)

    @staticmethod
    def places(length: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """(n, BLOCKS): where fingerprints are looked up."""
        blocks = np.arange(BLOCKS)
        value = (fp[:, None] >> (16 * blocks).astype(np.uint64)).astype(np.int64) & 0xFFFF
        return (length[:, None] * BLOCKS + blocks) << 16 | value

    def candidates(self, n: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the items of length n that share a list with a window's fingerprint, each pair once."""
        at = self.places(np.full(len(fp), self.lengths.index(n)), fp).ravel()
        lo, hi = np.searchsorted(self.listed, at, "left"), np.searchsorted(self.listed, at, "right")
        count = hi - lo
        window = np.repeat(np.arange(len(at)) // BLOCKS, count)
        item = self.owner[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        pair = np.unique(window * max(1, len(self.items)) + item)
        return pair // max(1, len(self.items)), pair % max(1, len(self.items))

    def within(self, n: int, fp: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
        """(window, item, distance) of the candidates within the radius."""
        w, i = self.candidates(n, fp)
        d = np.bitwise_count(fp[w] ^ self.fp[i])
        ok = d <= radius
        return list(zip(w[ok].tolist(), i[ok].tolist(), d[ok].tolist(), strict=True))


def hits_in_batch(index: Index, docs: list[list[bytes]]) -> list[int]:
    """Positions of documents that hold a shingle of an item; vectorised over the batch."""
    sizes = sorted({SHINGLE, *index.short})
    gap = [-1] * SHINGLE
    get = index.vocabulary.get
    flat: list[int] = []
    starts = np.zeros(len(docs) + 1, np.int64)
    for i, words in enumerate(docs):
        flat += [get(w, -1) for w in words]
        flat += gap
        starts[i + 1] = len(flat)
    ids = np.array(flat, np.int64)
    known = ids >= 0
    found: set[int] = set()
    for size in sizes:
        if len(ids) < size:
            continue
        ok = known[: len(ids) - size + 1].copy()
        for i in range(1, size):
            ok &= known[i : len(ids) - size + 1 + i]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        h = index.vocabulary_hashes[ids[at]]
        for i in range(1, size):
            h = mix64(h * K + index.vocabulary_hashes[ids[at + i]])
        maybe = index.filter[h >> np.uint64(44)]
        at, h = at[maybe], h[maybe]
        if len(at):
            j = np.minimum(np.searchsorted(index.sorted, h), len(index.sorted) - 1)
            at = at[index.sorted[j] == h]
            found.update((np.searchsorted(starts, at, "right") - 1).tolist())
    return sorted(found)


def similarity(a: Counter, b: Counter) -> float:
    smaller = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return smaller / (sum(a.values()) + sum(b.values()) - smaller)


def search(index: Index, words: list[bytes], radius: int) -> list[tuple[object, float, int, int, int]]:
    """(item, similarity, first word, words, Hamming distance) of the best window of each item that passes."""
    h = word_hashes(words)
    best: dict[int, tuple] = {}
    for size in sorted({SHINGLE, *index.short, *([len(h)] if len(h) < SHINGLE else [])}):
        if len(h) < size:
            continue
        s = shingle_hashes(h, size)
        known = np.isin(s, index.sorted)
        shared = np.flatnonzero(known)
        lengths = [n for n in index.lengths if min(SHINGLE, n) == size]
        if not len(shared) or not lengths:
            continue
        reach = lengths[-1] - size + 1
        # places that no window has in common are worked on apart, which bounds the sums of a long text
        for part in np.split(shared, np.flatnonzero(np.diff(shared) > reach) + 1):
            lo, hi = max(0, int(part[0]) - reach + 1), min(len(s), int(part[-1]) + reach)
            ones = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(bits_of(s[lo:hi]), axis=0, out=ones[1:])
            held = np.concatenate(([0], np.cumsum(known[lo:hi])))
            for n in lengths:
                per = n - size + 1  # shingles of an item and of a window, unless the text ends before
                wide = min(per, len(s))
                starts = np.arange(hi - lo - wide + 1)
                least = index.threshold * (per + wide) / (1 + index.threshold)
                starts = starts[held[starts + wide] - held[starts] >= least - 1e-9]
                if not len(starts):
                    continue
                fp = packed(ones[starts + wide] - ones[starts] > 0)
                for w, i, d in index.within(n, fp, radius):
                    a = lo + int(starts[w])
                    value = similarity(Counter(s[a : a + wide].tolist()), index.items[i][2])
                    if value >= index.threshold and (i not in best or (-value, a) < best[i][:2]):
                        best[i] = (-value, a, min(n, len(h) - a), d)
    return [(index.items[i][0], -v, a, length, d) for i, (v, a, length, d) in sorted(best.items())]


def parts_of(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's rows in parts of about PART_BYTES."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"].encode()) for r in part.collect()]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """key, item, similarity, start_word, n_words, distance: the best window of each contaminated document and item."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, benchmark.schema[item].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("distance", T.LongType())])
    out = None
    for rows in parts_of(benchmark, item, item_text):
        part = searched(docs, rows, key, text, schema, threshold, radius)
        out = part if out is None else out.unionByName(part)
    return out


_indexes: dict = {}


def indexed(tag: str, rows: list, threshold: float) -> Index:
    """The index of a part of the benchmark, made once by each worker, which holds one."""
    if tag not in _indexes:
        _indexes.clear()
        _indexes[tag] = Index(rows, threshold)
    return _indexes[tag]


def searched(docs: DataFrame, rows: list, key: str, text: str, schema: T.StructType, threshold: float, radius: int) -> DataFrame:
    shared, tag = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else None for f in schema]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = indexed(tag, shared.value, threshold)
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                docs = [words_of(x) for x in texts(batch, 1)]
                ids = batch.column(0)
                got = [(i, *m) for i in (hits_in_batch(index, docs) if index.items else []) for m in search(index, docs[i], radius)]
                columns = [ids.take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], kinds[1] or pa.int64()), pa.array([g[2] for g in got], pa.float64()), *(pa.array([g[k] for g in got], pa.int64()) for k in (3, 4, 5))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(key, text).mapInArrow(found, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``docs`` without contaminated rows; all columns."""
    names = docs.columns
    at = names.index(text)
    for rows in parts_of(benchmark, benchmark.columns[0], item_text):
        docs = filtered(docs, rows, at, names, threshold, radius)
    return docs


def filtered(docs: DataFrame, rows: list, at: int, names: list[str], threshold: float, radius: int) -> DataFrame:
    shared, tag = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = indexed(tag, shared.value, threshold)
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                docs = [words_of(x) for x in texts(batch, at)]
                bad = {i for i in (hits_in_batch(index, docs) if index.items else []) if search(index, docs[i], radius)}
                yield batch.filter(pa.array([i not in bad for i in range(len(docs))], pa.bool_()))

    return docs.select(*names).mapInArrow(kept, docs.schema)
