"""Removal of byte strings of ``length`` bytes that start in more than one place, by a common-prefix-aware distributed merge sort.

Sorting every suffix of a corpus would move its bytes many times over. So suffixes are sorted at anchors only, which any two equal
windows of ``length`` bytes share:

1. Texts that occur more than once are removed whole, and only one copy of each goes on. Copies are told by 128 bits of hashes.
2. The anchor of a window is the first of its substrings of ``GRAM`` bytes with the least hash. Equal windows have equal anchors at
   equal distances. Neighbouring windows with one anchor place make a chunk. Chunks whose anchor hash occurs once in the corpus hold
   no repeat; a bit filter of the other hashes lets the rest pass (and some more, which costs time but changes nothing).
   Short strings repeat by chance, more of them the larger the corpus. A window holds its anchor with ``half`` of its other bytes, either
   after or before the anchor; so of the chunks left, only those go on of which one of these two longer strings occurs again, too.
3. A chunk becomes one string: its bytes from the anchor on, then those before the anchor backwards. Each task sorts its strings into a
   run, front-coded: the length of the prefix shared with the one before, and the rest. Equal strings are one entry; the places stay
   behind in a written table, by entry, those of a run in one row. Runs are cut into key ranges (from a bounded sample), exchanged, and merged by a loser tree whose
   entries carry the length of the prefix they share with the last winner: a longer one wins without looking, and of equals only what
   follows that prefix is compared.
4. Shared lengths decide. Two chunks with ``l`` equal bytes before their anchors and ``r`` from there on share a window if and only if
   ``l + r >= length``; then all ``l + r`` bytes are repeated. Merged entries of one anchor form a tree of their common prefixes; in each
   of its classes (all share ``r`` bytes) neighbours in the order of what precedes the anchor give each member its greatest ``l``.
   So each entry gets its widest reach to both sides without a look at all pairs of its group.
5. An anchor that occurs more than ``HOT`` times has its chunks split into single windows, of which those with a repeated hash are
   sorted like the rest: there, strings that meet are repeated. A group of chunks thus never has more than ``HOT`` members, and an
   entry comes once from each run, however often the run saw it.
6. Reaches of all key ranges go back to the places of their run, as spans of bytes of texts. All strings of a text are in one run, so
   spans that meet or overlap are joined there: a row for each maximal repeated stretch of a text, however many chunks or single windows
   of hot anchors it is made of. Only documents whose hash is among those of texts with spans (a bit filter
   again) are joined to them; the others pass unshuffled.

A full filter sends more strings to the sort and changes no result. ``docs`` is read several times and must give the same rows each time.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; equal rows are repeats of each other; long texts are
worked on in pieces of ``PIECE`` windows; an empty table gives an empty result; the columns n_bytes, n_removed, n_spans, kept (binary:
the bytes that stay) are added, in place of others of these names; a null or repeated key is a column like any other.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Shared, hash_filter, merged_bits, mix64, released, sliced, small_batches, stored, texts

GRAM = 64
LOG2_BITS = 27
#: Occurrences of an anchor from which its chunks are split: a group of chunks that is held at once has at most so many, about 13 MB.
HOT = 1 << 15
#: Bytes of text that are hashed together: the arrays stay in the processor's cache.
TOGETHER = 1 << 18
#: Windows of a text that are worked on at once.
PIECE = 1 << 20
#: Texts of which key ranges are made; they decide balance only.
SAMPLE = 4_000
RANGES_A_PARTITION = 2
#: Bytes of strings, with their places, that make a run.
RUN = 32 << 20
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0x2545F4914F6CDD1D)]


def rolling(b: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of n bytes, by doubling."""
    powers = [(b.astype(np.uint64) + np.uint64(1)) * ODD[8]]
    while 2 << (len(powers) - 1) <= n:
        k, p = 1 << (len(powers) - 1), powers[-1]
        powers.append(p[:-k] * ODD[len(powers) - 1] + p[k:] if len(p) > k else p[:0])
    h, at, size = None, 0, max(0, len(b) - n + 1)
    for k in range(len(powers) - 1, -1, -1):
        if n >> k & 1:
            part = powers[k][at : at + size]
            h = part if h is None else h * ODD[7] + part
            at += 1 << k
    return mix64(h[:size])


def sliding(a: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        a = of(a[:-k], a[k:])
        k *= 2
    return of(a[: len(a) - (width - k)], a[width - k :]) if width > k else a


class Chunks:
    """Chunks of some pieces of texts: first window, number of windows, place and hash of the anchor, and the piece."""

    def __init__(self, raws: list[bytes], length: int):
        self.joined = b"".join(raws)
        b = np.frombuffer(self.joined, np.uint8)
        sizes = np.array([len(x) for x in raws], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        gram = rolling(b, GRAM)
        width = length - GRAM + 1
        low = sliding(gram, width)
        begins = np.zeros(len(low), bool)
        begins[0] = True
        begins[1:] = low[1:] != low[:-1]
        begins[self.starts] = True
        own = np.zeros(len(low) + 1, np.int8)  # 1 where windows that lie in one piece begin, -1 after the last of them
        own[self.starts] += 1
        np.add.at(own, np.minimum(self.starts + sizes - length + 1, len(low)), -1)
        begins |= own[:-1] != 0
        at = np.flatnonzero(begins)
        n = np.diff(np.append(at, len(low)))
        inside = np.cumsum(own[at], dtype=np.int64) > 0
        at, n = at[inside], n[inside]
        value = low[at]
        # where an anchor hash is found in its chunk
        edge = np.zeros(width - 1, np.uint64)
        places = np.flatnonzero(sliding(np.concatenate((edge, low, edge)), width, np.maximum) == gram)
        known, code = np.unique(gram[places], return_inverse=True)
        span = np.int64(len(b) + 1)
        found = np.sort(code.astype(np.int64) * span + places)
        base = np.searchsorted(known, value).astype(np.int64) * span
        lo, hi = np.searchsorted(found, base + at), np.searchsorted(found, base + at + n - 1 + width)
        one = hi - lo == 1
        parts = [(at[one], n[one], found[lo[one]] - base[one], value[one])]
        many = np.flatnonzero(~one)
        if len(many):  # the first place in each window
            row = np.repeat(many, n[many])
            window = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
            place = found[np.searchsorted(found, base[row] + window)] - base[row]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
            k = np.flatnonzero(new)
            parts.append((window[k], np.diff(np.append(k, len(row))), place[k], value[row[k]]))
        self.at, self.n, self.place, self.value = (np.concatenate(x) for x in zip(*parts, strict=True))

    def wider(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (in ``which``) and hashes of the anchors of some chunks with the ``half`` bytes after them and before them.

        An anchor at d bytes from its window's start has ``half`` bytes of the window after it if d <= half, and before it if d >= half.
        """
        half = (length - GRAM) // 2
        at, n, place = self.at[which], self.n[which], self.place[which]
        after, before = np.flatnonzero(at + n - 1 >= place - half), np.flatnonzero(at <= place - half)
        if not len(which):
            return which, np.zeros(0, np.uint64)
        view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.joined, np.uint8), GRAM + half)
        with np.errstate(over="ignore"):
            factors = np.cumprod(np.full(GRAM + half, ODD[0]))
            return np.concatenate((after, before)), np.concatenate([mix64((view[p].astype(np.uint64) + np.uint64(1)) @ factors + odd) for p, odd in ((place[after], ODD[1]), (place[before] - half, ODD[2]))])

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def windows(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of the windows of some chunks, and hashes of the windows."""
        n = self.n[which]
        first = np.repeat(self.at[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not len(first):
            return first, np.zeros(0, np.uint64)
        return first, mix64(rolling(np.frombuffer(self.joined, np.uint8), length)[first] + ODD[3])


def pieces(raws: list[bytes], length: int, most: int = PIECE) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Pieces of ``most`` windows of long enough texts, about TOGETHER bytes at a time, with their texts' numbers and their offsets in those."""
    held, of, offsets, size = [], [], [], 0
    for i, x in enumerate(raws):
        for o in range(0, len(x) - length + 1, most):
            held.append(x[o : o + most + length - 1])
            of.append(i)
            offsets.append(o)
            size += len(held[-1])
            if size >= TOGETHER:
                yield held, of, offsets
                held, of, offsets, size = [], [], [], 0
    if held:
        yield held, of, offsets


def tallied(hashes: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(hashes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


class Distinct:
    """Texts of at least ``length`` bytes, each distinct one once: those that occur once, straight from the source, and one copy of the others.

    What is a copy is told in the Python worker that works on the rows, as a second one for each task would take as much memory again.
    """

    def __init__(self, long: DataFrame, one_each: DataFrame, copied: Shared, number: int):
        self.rows = long.withColumn("own", F.lit(False)).unionByName(one_each.withColumn("own", F.lit(True))).select("body", "t1", "t2", "own")
        self.copied, self.number = copied, number

    def apply(self, of, schema: str, some=None) -> DataFrame:
        """mapInArrow of batches of (body, t1, t2), of some rows or all."""
        copied = self.copied

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return released(of(b.filter(pc.or_(b.column(3), pa.array(~copied.hit(b.column(1).to_numpy().view(np.uint64))))) for b in sliced(batches, 512)))

        return (self.rows if some is None else self.rows.filter(some)).mapInArrow(run, schema)


def counts(body: Distinct, length: int, piece: int, hashes) -> DataFrame:
    """(h, n): hashes that ``hashes`` makes of chunks, with how often each occurs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for raws, _, _ in pieces(texts(batch, 0), length, piece):
                held.append(hashes(Chunks(raws, length)))
                size += len(held[-1])
                if size > 2_000_000:  # counted together before the shuffle
                    yield tallied(held)
                    held, size = [], 0
        if size:
            yield tallied(held)

    return body.apply(found, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def anchor_filters(body: Distinct, length: int, piece: int, log2_bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Filters of the anchors that occur at least twice, and of those that occur more than ``hot`` times."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - log2_bits}) & 63 AS int))")
    again = counts(body, length, piece, lambda c: c.value).filter("n > 1").groupBy(F.shiftrightunsigned("h", 64 - log2_bits + 6).alias("w"))
    words = again.agg(F.bit_or(bit).alias("bits"), F.bit_or(F.when(F.col("n") > hot, bit).otherwise(F.lit(0).cast("long"))).alias("hot")).toArrow()
    return merged_bits(words.select(["w", "bits"]).to_batches(), log2_bits), merged_bits(words.select(["w", "hot"]).to_batches(), log2_bits)


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the prefix that a and b share; they share ``at`` bytes at least, which aren't read."""
    n = min(len(a), len(b))
    while at < n:
        m = min(n, at + 64)
        x = int.from_bytes(a[at:m], "big") ^ int.from_bytes(b[at:m], "big")
        if x:
            return m - (x.bit_length() + 7) // 8
        at = m
    return n


CHUNK, WINDOW = b"\0", b"\1"
END = b"\0\0"


def written(after: bytes, before: bytes) -> bytes:
    """A chunk as one string that sorts by what follows the anchor's first byte, a prefix first, then by what precedes it, backwards."""
    return CHUNK + after.replace(b"\0", b"\0\xff") + END + before[::-1]


def read(string: bytes) -> tuple[bytes, bytes]:
    """What follows the anchor's first byte, and what precedes it, backwards."""
    k = string.index(END, 1)
    return string[1:k].replace(b"\0\xff", b"\0"), string[k + 2 :]


def group_of(string: bytes) -> bytes:
    """Strings that must meet in one task: those of one anchor, or equal windows."""
    return string[: GRAM + 1] if string[:1] == CHUNK and END[:1] not in string[1 : GRAM + 1] else string if string[:1] == WINDOW else CHUNK + read(string)[0][:GRAM].replace(b"\0", b"\0\xff")


def packed_run(strings: list[bytes], many: np.ndarray | None = None) -> bytes:
    """A sorted run, front-coded: shared lengths, lengths, whether an entry has several places, rests."""
    before = b""
    shared, rests = [], []
    for s in strings:
        k = common(before, s, 0)
        shared.append(k)
        rests.append(s[k:])
        before = s
    return zlib.compress(np.array([len(strings)], "<u4").tobytes() + np.array(shared, "<u4").tobytes() + np.array([len(s) for s in strings], "<u4").tobytes() + (np.zeros(len(strings), bool) if many is None else many).tobytes() + b"".join(rests), 1)


class Run:
    """Reads a front-coded run; holds one string at a time."""

    def __init__(self, blob: bytes, name: tuple[int, int] = (0, 0)):
        raw = zlib.decompress(blob)
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        self.shared = np.frombuffer(raw, "<u4", n, 4).tolist()
        self.size = np.frombuffer(raw, "<u4", n, 4 + 4 * n).tolist()
        self.many = np.frombuffer(raw, bool, n, 4 + 8 * n).tolist()
        self.at, self.raw, self.name = 4 + 9 * n, raw, name
        self.i, self.n, self.string, self.lcp = -1, n, b"", 0
        self.next()

    def next(self) -> None:
        """The following string; ``lcp`` is what it shares with the one before."""
        self.i += 1
        if self.i >= self.n:
            self.string = None
            return
        self.lcp = self.shared[self.i]
        more = self.size[self.i] - self.lcp
        self.string = self.string[: self.lcp] + self.raw[self.at : self.at + more]
        self.at += more


class LoserTree:
    """Merges runs. Each waiting entry keeps the length of the prefix it shares with the entry that beat it."""

    def __init__(self, runs: list[Run]):
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.runs = runs + [None] * (self.size - len(runs))
        self.lost: list[Run | None] = [None] * self.size
        for r in runs:
            r.lcp = 0
        level = list(self.runs)
        first = self.size // 2
        while len(level) > 1:
            winners = []
            for k in range(0, len(level), 2):
                winner, loser = self.play(level[k], level[k + 1])
                self.lost[first + k // 2] = loser
                winners.append(winner)
            level, first = winners, first // 2
        self.winner = level[0]
        self.leaf = {id(r): self.size + k for k, r in enumerate(self.runs) if r}
        self.compared = 0

    @staticmethod
    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """Winner and loser. Both carry what they share with the last output; the loser's changes to what it shares with the winner."""
        if a is None or a.string is None:
            return b, a
        if b is None or b.string is None:
            return a, b
        if a.lcp != b.lcp:
            return (a, b) if a.lcp > b.lcp else (b, a)
        k = common(a.string, b.string, a.lcp)
        if k == len(a.string) or (k < len(b.string) and a.string[k] < b.string[k]):
            b.lcp = k
            return a, b
        a.lcp = k
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, Run, int]]:
        """(prefix shared with the output before, string, run, index in the run) in order."""
        r = self.winner
        while r is not None and r.string is not None:
            yield r.lcp, r.string, r, r.i
            r.next()
            k = self.leaf[id(r)] // 2
            while k:
                r, self.lost[k] = self.play(r, self.lost[k])
                k //= 2


def entries(runs: list[Run]) -> Iterator[tuple[int, bytes, list[tuple[Run, int]]]]:
    """Distinct strings of all runs in order: the prefix shared with the one before, the string, and where it is."""
    held, first, where = None, 0, []
    for shared, string, run, i in LoserTree(runs):
        if held is not None and shared == len(string) == len(held):
            where.append((run, i))
            continue
        if where:
            yield first, held, where
        held, first, where = string, shared, [(run, i)]
    if where:
        yield first, held, where


def reaches(after: list[bytes], before: list[bytes], shared: list[int], length: int) -> list[tuple[int, int]]:
    """For each chunk of one anchor, in order, the greatest numbers of bytes before and after the anchor's first byte that are repeated.

    ``shared[i]`` is the length of the prefix that ``after[i]`` shares with ``after[i - 1]``. Only reaches of ``length`` bytes
    or more in all count; (0, 0): none.
    """
    out = [(0, 0)] * len(after)
    classes = [(0, len(after))] if len(after) > 1 else []
    while classes:
        lo, hi = classes.pop()
        r = min(shared[lo + 1 : hi])
        order = sorted(range(lo, hi), key=before.__getitem__)
        left = 0
        for j, x in enumerate(order):
            right = common(before[x], before[order[j + 1]], 0) if j + 1 < len(order) else 0
            most = left if left > right else right
            if most + r >= length:
                a, b = out[x]
                out[x] = (most if most > a else a, r if r > b else b)
            left = right
        # classes that share more
        start = lo
        for i in range(lo + 1, hi + 1):
            if i == hi or shared[i] == r:
                if i - start > 1:
                    classes.append((start, i))
                start = i
    return out


def several(where: list[tuple[Run, int]]) -> bool:
    """Whether an entry has more than one place."""
    return len(where) > 1 or where[0][0].many[where[0][1]]


def decided(runs: list[Run], length: int) -> Iterator[tuple[Run, int, int, int]]:
    """(run, entry, bytes before, bytes after) of each entry of which something is repeated."""
    held: list[tuple[int, bytes, list]] = []
    group = None

    def settle() -> Iterator[tuple[Run, int, int, int]]:
        if not held or len(held) == 1 and not several(held[0][2]):
            return
        parts = [read(s) for _, s, _ in held]
        after, before = [p[0] for p in parts], [p[1] for p in parts]
        shared = [0]
        for i in range(1, len(held)):
            k = held[i][0] - 1  # without the first byte, which tells chunks from windows
            whole = min(len(after[i - 1]), len(after[i]))
            shared.append(common(after[i - 1], after[i], 0) if b"\0" in held[i][1][1 : k + 2] else min(k, whole))
        for j, (a, b) in enumerate(reaches(after, before, shared, length)):
            where = held[j][2]
            if several(where):
                a, b = len(before[j]), len(after[j])
            if b:
                yield from ((run, i, a, b) for run, i in where)

    for shared, string, where in entries(runs):
        if string[:1] == WINDOW:
            yield from settle()
            held, group = [], None
            if several(where):
                yield from ((run, i, 0, length) for run, i in where)
            continue
        if group is None or shared < len(group):
            yield from settle()
            held, group = [], group_of(string)
        held.append((shared, string, where))
    yield from settle()


#: Written runs: rows of strings have no places, rows of places no range.
RUNS = pa.schema({"run": pa.int64(), "range": pa.int32(), "first": pa.int32(), "strings": pa.binary(), "places": pa.binary()})


class Builder:
    """The distinct strings of some texts, with their places (text, anchor)."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.entry: list[int] = []
        self.t: list[tuple[int, int]] = []
        self.at: list[int] = []
        self.size = 0

    def add(self, string: bytes, t: tuple[int, int], at: int) -> None:
        k = self.number.setdefault(string, len(self.number))
        if k + 1 == len(self.number):
            self.size += len(string) + 120
        self.size += 60
        self.entry.append(k)
        self.t.append(t)
        self.at.append(at)

    def rows(self, cuts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """A run, cut at the ranges: (run, range, number of the first entry, strings), then the places of all of it: (run, places)."""
        name = uuid.uuid4().int >> 65
        strings = sorted(self.number)
        rank = np.empty(len(strings), np.int64)
        rank[[self.number[s] for s in strings]] = np.arange(len(strings))
        where = rank[np.array(self.entry, np.int64)]
        order = np.argsort(where, kind="stable")
        where, t, at = where[order], np.array(self.t, "<i8").reshape(-1, 2)[order], np.array(self.at, "<i8")[order]
        begin, edges = 0, []
        for i, s in enumerate(strings):
            k = bisect_right(cuts, group_of(s))
            if not edges or edges[-1][0] != k:
                edges.append((k, i))
        many = np.bincount(where, minlength=len(strings)) > 1
        for j, (k, begin) in enumerate(edges):
            end = edges[j + 1][1] if j + 1 < len(edges) else len(strings)
            yield pa.RecordBatch.from_pylist([{"run": name, "range": k, "first": begin, "strings": packed_run(strings[begin:end], many[begin:end])}], RUNS)
        places = zlib.compress(b"".join(x.tobytes() for x in (np.array([len(where)], "<i8"), where.astype("<i4"), t[:, 0].copy(), t[:, 1].copy(), at)), 1)
        yield pa.RecordBatch.from_pylist([{"run": name, "places": places}], RUNS)


def unpacked_places(blob: bytes) -> tuple[np.ndarray, ...]:
    """Entry, both hashes of the text, anchor."""
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.frombuffer(raw, "<i4", n, 8), *(np.frombuffer(raw, "<i8", n, 8 + 4 * n + 8 * n * k) for k in range(3))


def stretches(t1: np.ndarray, t2: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The spans [a, b) of texts, those of a text joined where they meet or overlap."""
    if not len(a):
        return t1, t2, a, b
    order = np.lexsort((a, t2, t1))
    t1, t2, a, b = (x[order] for x in (t1, t2, a, b))
    other = np.zeros(len(a), bool)
    other[1:] = (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
    base = np.cumsum(other, dtype=np.int64) << 40  # ends of a text before it don't reach into the next
    end = np.maximum.accumulate(base + b)
    new = np.ones(len(a), bool)
    new[1:] = (base + a)[1:] > end[:-1]
    k = np.flatnonzero(new)
    last = np.append(k[1:], len(a)) - 1
    return t1[k], t2[k], a[k], (end - base)[last]


class Sorter:
    """What a task needs to turn texts into strings to sort."""

    def __init__(self, length: int, piece: int, again: Shared):
        self.length, self.piece, self.again = length, piece, again
        self.hot: Shared | None = None
        self.windows: Shared | None = None
        self.wide: Shared | None = None

    def plain(self, c: Chunks) -> np.ndarray:
        """Chunks whose anchor occurs again, but isn't split."""
        which = np.flatnonzero(self.again.hit(c.value))
        return which if self.hot is None else which[~self.hot.hit(c.value[which])]

    def wider(self, c: Chunks) -> np.ndarray:
        return c.wider(self.plain(c), self.length)[1]

    def strings(self, raws: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
        """(string, text, anchor in the text)"""
        for held, of, offsets in pieces(raws, self.length, self.piece):
            c = Chunks(held, self.length)
            which = self.plain(c)
            number, h = c.wider(which, self.length)
            which = which[np.unique(number[self.wide.hit(h)])]
            if self.hot is not None:
                split = np.flatnonzero(self.hot.hit(c.value))
                if len(split):
                    first, h = c.windows(split, self.length)
                    first = first[self.windows.hit(h)]
                    k = c.piece(first)
                    for a, i, s in zip(first.tolist(), k.tolist(), c.starts[k].tolist(), strict=True):
                        yield WINDOW + c.joined[a : a + self.length], of[i], offsets[i] + a - s
            k = c.piece(c.at[which])
            for a, n, p, i, s in zip(c.at[which].tolist(), c.n[which].tolist(), c.place[which].tolist(), k.tolist(), c.starts[k].tolist(), strict=True):
                yield written(c.joined[p : a + n - 1 + self.length], c.joined[a:p]), of[i], offsets[i] + p - s


def spans(body: Distinct, length: int, piece: int, log2_bits: int, hot: int) -> DataFrame:
    """(t1, t2, a, b): bytes [a, b) of the text with these hashes are repeated."""
    spark = body.rows.sparkSession
    again, often = anchor_filters(body, length, piece, log2_bits, hot)
    sorter = Sorter(length, piece, Shared(spark, again))
    if often.any():
        held = Shared(spark, often)
        windows = counts(body, length, piece, lambda c: c.windows(np.flatnonzero(held.hit(c.value)), length)[1]).filter("n > 1").select("h")
        sorter.hot, sorter.windows = held, Shared(spark, hash_filter(windows, log2_bits))
    sorter.wide = Shared(spark, hash_filter(counts(body, length, piece, sorter.wider).filter("n > 1").select("h"), log2_bits))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({group_of(s) for s, _, _ in sorter.strings(texts(batch, 0))})[::4], pa.binary())], ["s"])

    keep = max(1, body.number // SAMPLE)
    sample = sorted(body.apply(sampled, "s binary", F.pmod("t2", F.lit(keep)) == 0).limit(16 * SAMPLE).toArrow().column("s").to_pylist())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES_A_PARTITION * partitions
    shared = spark.sparkContext.broadcast(sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else [])

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Builder()
        for batch in batches:
            t = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for string, i, at in sorter.strings(texts(batch, 0)):
                held.add(string, t[i], at)
            if held.size > RUN:
                yield from held.rows(shared.value)
                held = Builder()
        if held.number:
            yield from held.rows(shared.value)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, of_range in groupby(rows, lambda r: r[0]):
            runs = [Run(blob, (name, first)) for _, name, first, blob in of_range]
            found = {id(r): np.zeros((2, r.n), "<u2") for r in runs}
            for run, i, a, b in decided(runs, length):
                found[id(run)][:, i] = a, b
            some = [r for r in runs if found[id(r)].any()]
            yield pa.RecordBatch.from_arrays([pa.array([r.name[0] for r in some], pa.int64()), pa.array([r.name[1] for r in some], pa.int32()), pa.array([zlib.compress(found[id(r)].tobytes(), 1) for r in some], pa.binary())], ["run", "first", "reach"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            entry, t1, t2, at = unpacked_places(batch.column(0)[0].as_py())
            reach = np.zeros((2, int(entry.max()) + 1), np.int64)
            for part in batch.column(1)[0].as_py():
                found = np.frombuffer(zlib.decompress(part["reach"]), "<u2").reshape(2, -1)
                reach[:, part["first"] : part["first"] + found.shape[1]] = found
            some = np.flatnonzero(reach[1][entry])
            before, after = reach[:, entry[some]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stretches(t1[some], t2[some], at[some] - before, at[some] + after)], ["t1", "t2", "a", "b"])

    table = stored(body.apply(sorted_runs, "run long, range int, first int, strings binary, places binary"))
    # runs go by their key range, places wait
    strings = table.filter("range IS NOT NULL").select("range", "run", "first", "strings").repartition(partitions, "range").sortWithinPartitions("range")
    reach = strings.mapInArrow(lambda batches: released(merged(batches)), "run long, first int, reach binary").groupBy("run").agg(F.collect_list(F.struct("first", "reach")).alias("reaches"))
    return table.filter("range IS NULL").select("run", "places").join(reach, "run").select("places", "reaches").mapInArrow(lambda batches: released(placed(batches)), "t1 long, t2 long, a long, b long")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, log2_bits: int = LOG2_BITS, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept."""
    if length < GRAM + 24 or length > 60_000:
        raise ValueError(f"length must be from {GRAM + 24} to 60000")
    spark = docs.sparkSession
    small_batches(spark)
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    body = F.coalesce(F.col(text), F.lit(""))
    hashes = {"__t1": F.xxhash64(body), "__t2": F.xxhash64(F.lit(1), body)}
    slim = docs.select(body.alias("body")).select("body", F.xxhash64("body").alias("t1"), F.xxhash64(F.lit(1), "body").alias("t2"))
    long = slim.filter(F.octet_length("body") >= length)
    # texts that occur more than once: a row each
    size = long.select("t1", "t2", F.octet_length("body").cast("long").alias("b"))
    copies = stored(size.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("b").alias("b")).groupBy((F.col("n") > 1).alias("again"), F.when(F.col("n") > 1, F.col("t1")).alias("t1"), F.when(F.col("n") > 1, F.col("t2")).alias("t2")).agg(F.count("*").alias("texts"), F.max("b").alias("b")))
    distinct = copies.agg(F.sum("texts")).first()[0] or 0
    copies = copies.filter("again").select("t1", "t2", F.lit(0).cast("long").alias("a"), "b")
    copied = Shared(spark, hash_filter(copies.select(F.col("t1").alias("h")), log2_bits - 2))
    one_each = stored(long.filter(copied.column("t1")).dropDuplicates(["t1", "t2"]))
    found = spans(Distinct(long, one_each, copied, distinct), length, piece, log2_bits, hot)
    by_text = stored(found.unionByName(copies).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("__spans")))
    touched = Shared(spark, hash_filter(by_text.select(F.col("t1").alias("h")), log2_bits - 2))
    keyed = docs.select(*names).withColumns(hashes)
    joined = keyed.filter(touched.column("__t1")).join(by_text.withColumnsRenamed({"t1": "__t1", "t2": "__t2"}), ["__t1", "__t2"], "left").select(*names, "__spans")
    at = names.index(text)
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns: list[list] = [[], [], [], []]
            for raw, spans in zip(texts(batch, at), batch.column(len(names)).to_pylist(), strict=True):
                kept, last, runs = [], 0, 0
                end = -1
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if s[0] > end:
                        kept.append(raw[last : s[0]])
                        runs += 1
                    end = max(end, s[1])
                    last = end
                kept.append(raw[last:])
                out = b"".join(kept)
                for column, value in zip(columns, (len(raw), len(raw) - len(out), runs, out), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], schema.names)

    none = F.lit(0).cast("long")
    whole = keyed.filter(~touched.column("__t1")).select(*names, F.octet_length(body).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), body.cast("binary").alias("kept"))
    return joined.mapInArrow(lambda batches: released(cut(batches)), schema).unionByName(whole)


def summary(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
