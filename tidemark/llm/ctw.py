"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, one at each node of a binary tree of its leading bits. For every node there is a context tree over
the preceding bytes, up to ``depth`` of them. Each (context, node) has the zeros and ones that the training texts show there and their
Krichevsky-Trofimov block probability; the weighted probability of a context is the mean of that and the product of its children's.
A decision's probability mixes the KT estimates of all depths along the context's path, each with the posterior weight that the tree
stops there. A text's score is the sum over its bytes and one end byte; minus log2 over the bytes is its code length.

How it runs:

1. Every task counts the (context, byte) strings of its texts, training and other texts apart, and one shuffle adds the counts up: all
   strings of all texts, whatever their number.
2. Strings are dealt by the two latest context bytes, so a task has all of a subtree below depth 2. It computes the subtree's block
   probabilities; depths 1 and 0 have at most 256 x 255 nodes and are finished on the driver.
3. The same tasks mix the estimates downwards and give the log-probability of every string.
4. Documents look up their strings. The table, and the one of token counts that the unigram base needs, are broadcast in slices of bounded size,
   one pass over the documents a slice: scores are sums, so each pass adds its slice's part.

Defined cases: a null text is empty, and an empty text has the end byte only; repeated rows are learned from and scored each; a null id counts as
the empty text for the fold; an empty table gives an empty result; without training texts all counts are 0; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_bucket, settled, sliced, texts

DEPTH = 5
FOLD, FOLDS = 1, 5
#: Rows of a table that are broadcast at once, about 16 bytes each.
SLICE = 8_000_000
#: Bytes of text whose strings are sorted at once.
CHUNK = 1 << 19
#: Distinct words that a task holds before it passes their counts on.
WORDS = 250_000
END = b""  # the end token; no word is empty
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def strings_of(raws: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all strings of ``depth`` context bytes and a byte, and where each text's begin. Texts are framed by NUL bytes."""
    joined = b"".join(b"\0" * depth + x + b"\0" for x in raws)
    b = np.frombuffer(joined, np.uint8).astype(np.int64)
    code = np.zeros(max(0, len(b) - depth), np.int64)
    for i in range(depth + 1):
        code <<= 8
        code |= b[i : len(b) - depth + i]
    sizes = np.array([len(x) + 1 for x in raws], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + depth)))[:-1]
    use = np.ones(len(code), bool)
    for s in starts[1:]:
        use[s - depth : s] = False  # their context lies in two texts
    return code[use], np.concatenate(([0], np.cumsum(sizes)))[:-1]


def chunks(raws: list[bytes], size: int = CHUNK) -> Iterator[list[int]]:
    """Positions of texts, together about ``size`` bytes."""
    held, n = [], 0
    for i, x in enumerate(raws):
        held.append(i)
        n += len(x)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    out, at = np.unique(codes, return_inverse=True)
    return out, np.bincount(at, counts, len(out)).astype(np.int64)


def counted_strings(docs: DataFrame, key: str, text: str, depth: int, fold: int, folds: int) -> DataFrame:
    """(code, n): all strings of all texts, with their number in training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        rows = 0
        for batch in sliced(batches):
            raws = [x.lower() for x in texts(batch, 1)]
            learn = [id_bucket(i, folds) != fold for i in batch.column(0).to_pylist()]
            for at in chunks(raws):
                for training in (True, False):
                    own = [raws[i] for i in at if learn[i] is training]
                    if own:
                        codes, n = tally(strings_of(own, depth)[0])
                        parts.append((codes, n if training else np.zeros_like(n)))
                        rows += len(codes)
            if rows > 1_200_000:
                parts = [added(parts)]
                rows = len(parts[0][0])
                if rows > 800_000:
                    yield as_batch(parts.pop())
                    rows = 0
        if parts:
            yield as_batch(added(parts))

    def as_batch(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1].astype(np.int64))], ["code", "n"])

    return docs.select(key, text).mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x > 0: Stirling's series from x + 8 on, and back down."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT block probability of the counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def stopped(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted block probability of nodes from their KT one and their children's product, and the posterior weight of stopping."""
    total = np.logaddexp(own, below) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


class Subtrees:
    """Depths ``depth`` to 2 of the context trees of some strings; all strings of a pair of latest context bytes must be there."""

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int):
        y, context = code & 255, code >> 8
        k = np.arange(8)
        node = (1 << k)[None, :] | (y[:, None] >> (8 - k)[None, :])
        self.bit = ((y[:, None] >> (7 - k)[None, :]) & 1).ravel()
        weight = np.repeat(n.astype(float), 8)
        self.levels = []
        below = None
        for d in range(depth, 1, -1):
            key = (((context & ((1 << (8 * d)) - 1))[:, None] << 8) | node).ravel()
            keys, at = np.unique(key, return_inverse=True)
            ones = np.bincount(at, weight * self.bit, len(keys))
            zeros = np.bincount(at, weight, len(keys)) - ones
            own = log_kt(zeros, ones)
            if below is None:
                total, w = own, np.ones(len(keys))
            else:
                parent_at = np.zeros(len(below), np.int64)
                parent_at[self.levels[-1]["at"]] = at
                total, w = stopped(own, np.bincount(parent_at, below, len(keys)))
            self.levels.append({"keys": keys, "at": at, "zeros": zeros, "ones": ones, "w": w})
            below = total
        self.total = below
        self.node = node.ravel()
        self.latest = np.repeat(context & 255, 8)

    def top(self) -> dict:
        """By (latest byte, node): counts and the product of the weighted probabilities of depth 2."""
        level = self.levels[-1]
        keys, at = np.unique(level["keys"] & 0xFFFF, return_inverse=True)
        return {"key": keys, **{k: np.bincount(at, v, len(keys)) for k, v in (("zeros", level["zeros"]), ("ones", level["ones"]), ("below", self.total))}}

    def log10(self, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Of each string's byte. The probability of a one is alpha + beta times what depth 2 and deeper say."""
        p = None
        for level in self.levels:
            kt = kt_one(level["zeros"], level["ones"])[level["at"]]
            w = level["w"][level["at"]]
            p = kt if p is None else w * kt + (1 - w) * p
        key = (self.latest << 8) | self.node
        p = alpha[key] + beta[key] * p
        return np.log10(np.where(self.bit == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)


def upper(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depths 1 and 0 from what came of depth 2: alpha and beta by (latest byte, node)."""
    z, o, b = (np.bincount(key, v, 1 << 16) for v in (zeros, ones, below))
    total, w1 = stopped(log_kt(z, o), b)
    node = np.arange(1 << 16) & 255
    z0, o0, b0 = (np.bincount(node, v, 256) for v in (z, o, total))
    _, w0 = stopped(log_kt(z0, o0), b0)
    k0, w0 = kt_one(z0, o0)[node], w0[node]
    return w0 * k0 + (1 - w0) * w1 * kt_one(z, o), (1 - w0) * (1 - w1)


def log_probabilities(counts: DataFrame, depth: int) -> DataFrame:
    """(code, logp): log10 of each string's byte given its context."""
    dealt = settled(counts.repartition(F.shiftright("code", 8).bitwiseAND(0xFFFF)))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            t = Subtrees(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), depth).top()
            yield pa.RecordBatch.from_arrays([pa.array(t[k]) for k in ("key", "zeros", "ones", "below")], ["key", "zeros", "ones", "below"])

    # at most 256 x 255 rows
    rows = dealt.mapInArrow(tops, "key long, zeros double, ones double, below double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
    ab = upper(*(rows.column(c).to_numpy() for c in ("key", "zeros", "ones", "below")))
    shared = counts.sparkSession.sparkContext.broadcast(ab)

    def downwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            code = np.concatenate([p[0] for p in parts])
            logp = Subtrees(code, np.concatenate([p[1] for p in parts]), depth).log10(*shared.value)
            for i in range(0, len(code), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(code[i : i + (1 << 18)]), pa.array(logp[i : i + (1 << 18)].astype(np.float32))], ["code", "logp"])

    return dealt.mapInArrow(downwards, "code long, logp float")


class Table:
    """Values by 64-bit key, found by buckets of the key's hash. Made on the driver, so that workers hold it once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length() - 1)
        h = keys.view(np.uint64) * MULTIPLIER
        order = np.argsort(h)
        self.hash, self.values = h[order], values[order]
        bucket = (self.hash >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(bucket, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(keys) else 0

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing, np.float64)
        if not len(self.hash):
            return out
        h = keys.view(np.uint64) * MULTIPLIER
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        open_ = None
        last = len(self.hash) - 1
        for step in range(self.longest):
            if open_ is None:
                where = np.minimum(at, last)
                hit = self.hash[where] == h
                out[hit] = self.values[where[hit]]
                open_ = np.flatnonzero(~hit)
            else:
                where = np.minimum(at[open_] + step, last)
                hit = self.hash[where] == h[open_]
                out[open_[hit]] = self.values[where[hit]]
                open_ = open_[~hit]
            if not len(open_):
                break
        return out


def word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)


def counted_words(docs: DataFrame, key: str, text: str, fold: int, folds: int) -> DataFrame:
    """(h, n): hashes of the training texts' tokens, the end token included, with their numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word_hash(list(seen))), pa.array(list(seen.values()), pa.int64())], ["h", "n"])

        for batch in sliced(batches):
            for i, raw in zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True):
                if id_bucket(i, folds) != fold:
                    seen.update(raw.lower().split())
                    seen[END] += 1
                    if len(seen) > WORDS:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return docs.select(key, text).mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Logs(dict):
    """log10(c + 0.5) by word, for words that have been looked up; bounded."""

    def __init__(self, table: Table, slices: int, own: int):
        super().__init__()
        self.table, self.slices, self.own = table, slices, own

    def learn(self, docs: list[list[bytes]]) -> None:
        if len(self) > WORDS:
            self.clear()
        new = [w for w in set().union(*docs, (END,)) if w not in self]
        if new:
            h = word_hash(new)
            n = self.table.get(h, 0.0)
            value = np.log10(n + 0.5)
            if self.slices > 1:
                value[h % self.slices != self.own] = math.nan  # another pass has it
            self.update(zip(new, value.tolist(), strict=True))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, fold: int = FOLD, folds: int = FOLDS, slice_rows: int = SLICE) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row."""
    words = settled(counted_words(docs, key, text, fold, folds))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    strings = settled(log_probabilities(counted_strings(docs, key, text, depth, fold, folds), depth))
    n_strings = strings.count()
    slices = max(1, -(-max(n_strings, total["V"]) // slice_rows))
    state = docs.select(F.col(key), F.col(text).alias("__text"), *(F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known")), *(F.lit(0.0).alias(c) for c in ("logs", "score")), F.lit(0).cast("long").alias("n_bytes"))
    for i in range(slices):
        part = [words, strings] if slices == 1 else [words.filter(F.pmod("h", F.lit(slices)) == i), strings.filter(F.pmod("code", F.lit(slices)) == i)]
        w, s = part[0].select("h", "n").toArrow(), part[1].select("code", "logp").toArrow()
        tables = Table(w.column("h").to_numpy(), w.column("n").to_numpy().astype(np.int32 if total["N"] < 1 << 31 else np.int64)), Table(s.column("code").to_numpy(), s.column("logp").to_numpy())
        del w, s
        state = with_slice(state, tables, depth, slices, i)
        if i % 2 and i + 1 < slices:
            state = settled(state)
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold
    scale = math.log10(total["N"] + 0.5 * (total["V"] + 1))
    return state.select(key, held.alias("held_out"), "n_tokens", "n_known", F.lit(total["N"]).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score", (-F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def with_slice(state: DataFrame, tables: tuple, depth: int, slices: int, own: int) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(tables)
    names = state.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, strings = shared.value
        logs = Logs(words, slices, own)
        nothing = math.log10(0.5)
        for batch in sliced(batches):
            raws = [x.lower() for x in texts(batch, 1)]
            n_tokens, n_known, sums, score = (c.to_pylist() for c in batch.columns[2:6])
            for at in chunks(raws):
                own_raws = [raws[i] for i in at]
                codes, starts = strings_of(own_raws, depth)
                values = strings.get(codes, 0.0)
                for i, value in zip(at, np.add.reduceat(values, starts).tolist(), strict=True):
                    score[i] += value
                docs = [x.split() for x in own_raws]
                logs.learn(docs)
                get = logs.__getitem__
                for i, tokens in zip(at, docs, strict=True):
                    found = [*map(get, tokens), logs[END]]
                    if slices > 1:
                        found = [x for x in found if x == x]
                    n_tokens[i] += len(found)
                    n_known[i] += len(found) - found.count(nothing)
                    sums[i] += math.fsum(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(score, pa.float64()), pa.array([len(x) for x in raws], pa.int64())], names)

    return state.mapInArrow(scored, state.schema)
