"""Near-duplicates by the similarity of their sets of word shingles: SimHash fingerprints, met in the middle, propose pairs; the texts decide.

At a similarity (Jaccard) of 0.8, 15 % of the bits of two SimHashes differ: about ten of 64, for which balls of half that radius would
have millions of values. So there are ``TABLES`` independent fingerprints of ``BITS`` bits, and balls of radius 1 in each:

1. Rows with equal sets of shingles are merged: one node for each distinct set, named by a hash of it.
2. Every node emits, for each of its fingerprints, all values at most one bit away. Nodes are shuffled on these values; two that meet
   are at most two bits apart in that fingerprint, and any two that are do meet. A pair of similarity 0.8 meets with a chance of
   0.978, of 0.85 with 0.997, of 0.9 with 0.9999. 56 more bits and the size of the set travel along: pairs that differ in over ``FAR``
   of these bits (0.8: a chance of 0.0003) or too much in size are no candidates.
3. Verification, by the exact similarity of two texts, goes in two rounds, as groups are wanted, not all pairs. First a node is tried against
   ``TRIES`` nodes that it meets (neighbours on as many rings, whose orders change with the value), so there are no more pairs than
   ``TRIES`` times the nodes, and a large group is joined almost surely. What is left then, candidates that are still in different groups
   and untried, is verified without exception, so no link between groups is lost.

Defined cases: a null or empty text is the set of one empty shingle; fewer words than a shingle make one shingle; empty tables give
empty results; repeated rows and ids, and null ids, are treated by ``simhash.first_of_each``; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shared, hash_filter, mix64, settled, sliced, small_batches, stored, texts
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import FILTER_BITS, first_of_each, text_hash

TABLES = 12
BITS = 24
MORE = 56
FAR = 18
TRIES = 4
#: A step of the size code is a factor of so much: sizes that differ by a factor of 1.25 are three steps apart at most.
STEP = 1.12
WORDS = -(-(TABLES * BITS + MORE) // 64)
SEEDS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64))
LOW = np.uint64((1 << MORE) - 1)


def shingles(raw: bytes, words: int = 5) -> set[bytes]:
    w = raw.lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def described(raw: bytes, words: int = 5) -> tuple[int, list[int], int]:
    """Hash of the set; its fingerprints; further bits with the code of its size above them."""
    import xxhash

    h = np.sort(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(raw, words)], np.uint64))
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 255):  # sums that fit a byte
        part = mix64(h[i : i + 255, None] ^ SEEDS[None, :]).astype(">u8")
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8)).reshape(len(part), -1), axis=0, dtype=np.uint8)
    bits = 2 * ones > len(h)
    value = bits[: TABLES * BITS].reshape(TABLES, BITS) @ (1 << np.arange(BITS))
    more = int(bits[TABLES * BITS : TABLES * BITS + MORE] @ (1 << np.arange(MORE)))
    size = min(127, int(np.log(len(h)) / np.log(STEP)))
    return xxhash.xxh64_intdigest(h.tobytes(), 42), value.tolist(), size << MORE | more


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two nodes' further bits and sizes let them be candidates."""
    steps = (a >> np.uint64(MORE)).astype(np.int64) - (b >> np.uint64(MORE)).astype(np.int64)
    return (np.bitwise_count((a ^ b) & LOW) <= FAR) & (abs(steps) <= 3)


def by_value(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut where the first column changes only."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        own = [c.to_numpy() for c in batch.columns]
        rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
        if not len(rest[0]):
            continue
        end = int(np.searchsorted(rest[0], rest[0][-1]))
        if end:
            yield [c[:end] for c in rest]
            rest = [c[end:] for c in rest]
    if rest is not None and len(rest[0]):
        yield rest


def groups(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal values."""
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    return start, np.diff(np.append(start, len(v)))


def meetings(distinct: DataFrame, partitions: int) -> DataFrame:
    """(v, node, more) of the nodes that meet a candidate in the value v. ``distinct``: node, fps, more."""
    masks = F.array(*(F.lit(m).cast("long") for m in [0, *(1 << i for i in range(BITS))]))
    table = distinct.select("node", "more", F.posexplode("fps").alias("t", "fp"))
    balls = table.select(F.explode(F.transform(masks, lambda m: F.shiftleft(F.col("t").cast("long"), BITS).bitwiseOR(F.col("fp").bitwiseXOR(m)))).alias("v"), "node", "more")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, node, more in by_value(batches):
            more = more.view(np.uint64)
            start, size = groups(v)
            keep = np.zeros(len(v), bool)
            two = start[size == 2]
            two = two[alike(more[two], more[two + 1])]
            keep[two] = keep[two + 1] = True
            for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if n > 64:
                    keep[a : a + n] = True
                    continue
                own = more[a : a + n]
                pairs = alike(own[:, None], own[None, :])
                keep[a : a + n] = pairs.sum(axis=1) > 1
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(node[keep]), pa.array(more[keep].view(np.int64))], ["v", "node", "more"])

    return balls.repartition(partitions, "v").sortWithinPartitions("v").mapInArrow(met, "v long, node long, more long")


def candidates(members: DataFrame, partitions: int, tries: int | None) -> DataFrame:
    """(a, b) of nodes of different groups: so many for each node, or, with None, all. ``members``: v, node, more, root."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, node, more, root in by_value(batches):
            more = more.view(np.uint64)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, n in zip(*(x.tolist() for x in groups(v)), strict=True):
                at = slice(a, a + n)
                x, m, r = node[at], more[at], root[at]
                if n < 2 or (r == r[0]).all():
                    continue
                if tries is None:
                    for i in range(0, n, 128):  # in blocks
                        p, q = np.nonzero((r[i : i + 128, None] != r[None, :]) & alike(m[i : i + 128, None], m[None, :]))
                        p = p + i
                        out.append((x[p[p < q]], x[q[p < q]], np.zeros(int((p < q).sum()), np.int32)))
                        if len(out[-1][0]) > 100_000:
                            yield pairs(out)
                            out = []
                    continue
                for salt in range(tries):
                    order = np.argsort(mix64(x.view(np.uint64) ^ mix64(v[at].view(np.uint64) + np.uint64(salt))))
                    xs, ms, rs = (np.concatenate((c[order], c[order])) for c in (x, m, r))
                    # the next of another group on the ring
                    change = np.flatnonzero(rs[1:] != rs[:-1]) + 1
                    to = change[np.minimum(np.searchsorted(change, np.arange(n), "right"), len(change) - 1)]
                    ok = alike(ms[:n], ms[to]) & (rs[:n] != rs[to])
                    out.append((xs[:n][ok], xs[to][ok], np.full(int(ok.sum()), salt, np.int32)))
            yield pairs(out)

    def pairs(out: list) -> pa.RecordBatch:
        a, b, ring = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.int32)))
        if tries is None:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ring)], ["a", "b", "ring"])

    rows = members.select("v", "node", "more", "root").repartition(partitions, "v").sortWithinPartitions("v").mapInArrow(found, "a long, b long, ring int")
    if tries is None:
        return rows.select("a", "b").distinct()
    # on each ring, a node is tried against one
    one = rows.groupBy("a", "ring").agg(F.min(F.struct(F.xxhash64("b", "ring").alias("o"), "b")).alias("y")).select("a", F.col("y.b").alias("b"))
    return one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, bodies: DataFrame, words: int, least: float) -> DataFrame:
    """``pairs`` with whether they are similar enough."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ok = [similarity(shingles(x, words), shingles(y, words)) >= least for x, y in zip(texts(batch, 2), texts(batch, 3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    one = bodies.select(F.col("node").alias("a"), F.col("body").alias("x"))
    other = bodies.select(F.col("node").alias("b"), F.col("body").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(judged, "a long, b long, ok boolean")


def rooted(docs: DataFrame, key: str, text: str, words: int, least: float) -> DataFrame:
    """__key, __hash and __root for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [described(x, words) for x in texts(batch, 2)]
            nodes = np.array([g[0] for g in got], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.int64())], ["__key", "__hash", "node", "fps", "more"])

    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.col(key).alias("__key"), text_hash(text).alias("__hash"), F.col(text).alias("__body"))
    slim = stored(keyed.mapInArrow(run, f"__key {kind}, __hash long, node long, fps array<int>, more long"))
    distinct = slim.groupBy("node").agg(F.first("fps").alias("fps"), F.first("more").alias("more"), F.min("__hash").alias("h"))
    members = stored(meetings(distinct.repartition(partitions, "node").select("node", "fps", "more"), partitions))
    # one text for each set that meets another
    hashes = settled(distinct.select("node", "h").join(members.select("node").distinct(), "node"))
    wanted = Shared(spark, hash_filter(hashes.select("h"), FILTER_BITS))
    bodies = stored(docs.select(text_hash(text).alias("h"), F.col(text).alias("body")).filter(wanted.column("h")).join(hashes, "h").dropDuplicates(["node"]).select("node", "body"))
    labels = None
    tried = None
    for tries in (TRIES, None):
        named = members.withColumn("root", F.col("node"))
        if labels is not None:
            named = members.join(labels.withColumnRenamed("root", "r"), "node", "left").select("v", "node", "more", F.coalesce("r", "node").alias("root"))
        pairs = candidates(named, partitions, tries)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        new = stored(verified(pairs, bodies, words, least))
        tried = new if tried is None else tried.union(new)
        if new.filter("ok").limit(1).count():
            labels = connected_components(settled(tried.filter("ok").select("a", "b")))
    if labels is None:
        return slim.select("__key", "__hash", F.col("node").alias("__root"))
    return slim.join(labels.withColumnRenamed("node", "n"), slim["node"] == F.col("n"), "left").select("__key", "__hash", F.coalesce("root", "node").alias("__root"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component, all columns: the one with the smallest key, as ``simhash.first_of_each`` chooses."""
    return first_of_each(docs, rooted(docs, key, text, words, least), key, text)
