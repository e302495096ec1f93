"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits come from the XXH64 values of word shingles. Two fingerprints at most ``2 r`` bits apart have a
value in common that is at most r bits from each. So every distinct fingerprint emits the ball of radius r around it
(65 values for r = 1), the values are shuffled, and fingerprints that meet in a value are linked. Those that meet are
at most 2 r bits apart, all of them, so linking each to the smallest links the group without its pairs: a group has 65
fingerprints at most (r = 1), whatever the number of documents, as copies have been merged before. Linked pairs are made
distinct, verified by their Hamming distance, and joined into components.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; fewer words than a shingle make one
shingle; a null id is never a component's name unless all of its ids are null; repeated rows get a row each; further columns
are ignored by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Shared, hash_filter, settled, texts
from tidemark.llm.components import connected_components

#: Shingles whose bits are unpacked at once.
STEP = 1 << 15
FILTER_BITS = 25


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    h64 = xxhash.xxh64_intdigest
    w = raw.lower().split()
    if not w:
        return 0
    if len(w) < words:
        return h64(b" ".join(w), seed)
    hashes = np.array([h64(s, seed) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[i : i + STEP].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42, keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """The columns ``keep`` and the fingerprint as a signed long."""
    keep = docs.columns if keep is None else keep
    at = len(keep)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, words, seed) for x in texts(batch, at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(fp)], [*keep, name])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.LongType(), False)])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(hashed, schema)


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b), a < b, that join all distinct fingerprints ``fp`` within ``distance`` (even) bits, by balls of half of it."""
    r = distance // 2
    masks = [0, *(sum(1 << i for i in c) for k in range(1, r + 1) for c in combinations(range(64), k))]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    balls = distinct.select("fp", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in signed)), lambda m: m.bitwiseXOR(F.col("fp")))).alias("v"))
    met = balls.groupBy("v").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select(F.array_sort("fps").alias("fps"))
    pairs = met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 1 << 20)).alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def rooted(rows: DataFrame, key: str, distance: int, fp: str) -> DataFrame:
    """fp, __first (its smallest key) and __root, which names its component, for each distinct fingerprint of ``rows``."""
    firsts = settled(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("__first")))
    labels = connected_components(links(firsts.select("fp"), distance))
    return firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "__first", F.coalesce("root", "fp").alias("__root"))


def grouped(rows: DataFrame, key: str, distance: int = 2, fp: str = "fp") -> DataFrame:
    """``rows`` with ``component_id``: the smallest key that can be reached."""
    found = rooted(rows, key, distance, fp)
    smallest = found.groupBy("__root").agg(F.min("__first").alias("component_id"))
    named = found.join(smallest, "__root").select("fp", "component_id")
    return rows.join(named.withColumnRenamed("fp", fp), fp)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id for each row."""
    rows = settled(fingerprints(docs, text, words, seed, [key]))
    return grouped(rows, key, distance).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """One row of each component, all columns. ``named``: __key, __hash (``text_hash``) and __root of each row of ``docs``.

    Only rows of components of several rows are shuffled with their texts; a bit filter of those tells, and the others pass.
    """
    rank = F.struct(F.col("__key").isNull().alias("last"), F.col("__key").alias("k"), F.col("__hash").alias("h"))
    # equal ids and texts are in one component, so these two name one component each
    several = settled(named.groupBy("__root").agg(F.min(rank).alias("r"), F.count("*").alias("n")).filter("n > 1"))
    row = F.xxhash64("__key", "__hash")
    touched = Shared(docs.sparkSession, hash_filter(named.join(several, "__root").select(row.alias("h")).distinct(), FILTER_BITS))
    chosen = several.select(F.col("r.k").alias("__k"), F.col("r.h").alias("__h"))
    # of rows that are alone, what the filter passes by mistake must stay, too
    alone = named.join(several, "__root", "left_anti").select(F.col("__key").alias("__k"), F.col("__hash").alias("__h"))
    names = docs.columns
    hashed = docs.withColumn("__hash", text_hash(text)).withColumn("__row", F.xxhash64(key, "__hash"))
    suspects = hashed.filter(touched.column("__row"))
    first = suspects.join(chosen.union(alone), suspects[key].eqNullSafe(F.col("__k")) & (suspects["__hash"] == F.col("__h")), "left_semi").dropDuplicates([key, "__hash"])
    return first.select(*names).unionByName(hashed.filter(~touched.column("__row")).select(*names))


def text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """One row of each component, all columns: the one with the smallest key (null keys last; of equal keys, by a hash of the text; of equal rows, any one)."""
    keyed = docs.select(F.col(key).alias("__key"), text_hash(text).alias("__hash"), F.col(text).alias("__body"))
    slim = settled(fingerprints(keyed, "__body", words, seed, ["__key", "__hash"]))
    roots = rooted(slim, "__key", distance, "fp").select("fp", "__root")
    return first_of_each(docs, slim.join(roots, "fp"), key, text)
