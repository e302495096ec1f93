"""Token counts, and SentencePiece encoding and decoding.

Both cut a text into pre-tokens where no piece of the vocabulary can lie across the cut: before a run of spaces that follows
another character, and, if no piece holds a line feed, around line feeds. Encoding the pre-tokens one by one then gives what
encoding the whole text gives.

``count_tokens``: map-side two-tier lookup. A broadcast table holds the token counts of frequent pre-tokens; the others are
encoded once by each Python worker and kept in a bounded cache. There is no shuffle of pre-tokens.

``encode`` and ``decode``: a streaming Viterbi pass over a pre-token's characters, in ``Lattice``.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts, thinned

SPACE = "▁"
#: Documents, about, whose pre-tokens are counted for the frequent table. It decides speed only.
SAMPLE_DOCS = 4000
#: Rows of the frequent table: a proven bound of what is broadcast.
FREQUENT = 1 << 16
#: Pre-tokens that a worker's cache holds besides.
CACHED = 400_000
#: Pre-tokens whose ids a worker keeps.
CACHED_IDS = 900_000
#: Longer pre-tokens are not cached, which bounds the cache's bytes.
LONGEST_CACHED = 64


def pretokens(text: str, cut_lines: bool) -> list[str]:
    """Keys of the pre-tokens of a non-empty text.

    A key w stands for the space mark and w; one that begins with a line feed stands for itself, without a mark. In both
    cases further leading spaces are in the key.
    """
    if SPACE in text:
        text = text.replace(SPACE, " ")  # the model doesn't tell them apart
    if cut_lines and "\n" in text:
        first, *lines = text.split("\n")
        out = first.split(" ") if first else [""]
        if "" in out:
            out = spaced(out)
        for line in lines:
            words = line.split(" ")
            words[0] = "\n" + words[0]
            out += spaced(words) if "" in words else words
        return out
    words = text.split(" ")
    return spaced(words) if "" in words else words


def spaced(words: list[str]) -> list[str]:
    """Empty words are spaces before the next one; a run at the end is a pre-token of its own."""
    out, run = [], 0
    for w in words:
        if w:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    return [*out, " " * (run - 1)] if run else out


class Library:
    """The model in the library, and what is known of its pieces."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.proto = proto
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [p for i, p in enumerate(self.pieces) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece holds a space after another character: pre-tokens can't be cut at spaces")
        if self.sp.encode(" a  b ") != [*self.sp.encode(" a"), *self.sp.encode(" b"), *self.sp.encode("")] and self.sp.decode(self.sp.encode(" a  b ")) != " a  b ":
            raise ValueError("the model's normalizer changes white space")
        self.cut_lines = not any("\n" in p for p in plain)
        #: tokens of the space mark alone, which the empty key stands for
        self.mark = 2 * len(self.sp.encode("\n")) - len(self.sp.encode("\n\n"))

    def count(self, key: str) -> int:
        if not key:
            return self.mark
        return len(self.sp.encode(key)) - (1 if key[:1] == "\n" else 0)


class Lengths(dict):
    """Token counts by pre-token: frequent ones for good, others until the cache is full."""

    def __init__(self, library: Library, frequent: dict[str, int]):
        super().__init__(frequent)
        self.library, self.frequent = library, frequent

    def __missing__(self, key: str) -> int:
        n = self.library.count(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= len(self.frequent) + CACHED:
                self.clear()
                self.update(self.frequent)
            self[key] = n
        return n


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def frequent_pretokens(docs: DataFrame, text: str, cut_lines: bool, sample_docs: int, size: int) -> list[str]:
    """The most frequent pre-tokens of about ``sample_docs`` documents, counted where they are; at most ``size`` rows come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in texts(batch, 0):
                if x:
                    total.update(k for k in pretokens(x.decode(errors="replace"), cut_lines) if len(k) <= LONGEST_CACHED)
        top = total.most_common(2 * size)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["key", "n"])

    rows = thinned(docs.select(text), sample_docs).mapInArrow(counted, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(size)
    return rows.toArrow().column("key").to_pylist()


_workers: dict = {}


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096, sample_docs: int = SAMPLE_DOCS, frequent: int = FREQUENT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row.

    Defined cases: null and empty texts have 0 bytes and 0 tokens; equal rows are counted each; further columns are ignored.
    """
    proto = read_model(model)
    library = Library(proto)
    keys = frequent_pretokens(docs, text, library.cut_lines, sample_docs, frequent)
    tag = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((proto, keys, [library.count(k) for k in keys]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _workers.get("lengths", (None,))[0] != tag:
            proto, keys, counts = shared.value
            _workers["lengths"] = tag, Lengths(Library(proto), dict(zip(keys, counts, strict=True)))
        lengths = _workers["lengths"][1]
        get, cut = lengths.__getitem__, lengths.library.cut_lines
        for batch in batches:
            n_bytes, n_tokens = [], []
            for x in texts(batch, 1):
                n_bytes.append(len(x))
                n_tokens.append(sum(map(get, pretokens(x.decode(errors="replace"), cut))) if x else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    shape = docs.select(F.col(key), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit"))
    return docs.select(key, text).mapInArrow(counted, shape.schema)


class Lattice:
    """Streaming Viterbi over the characters of a pre-token.

    Step i finds the best way to end a piece after character i and keeps one backpointer. A unigram model keeps the largest sum
    of scores. For a BPE model, the way is what merging in the order of the scores gives for the text so far: a piece t may
    follow the piece a that ends the best path before it if merging the text of a and t leaves just these two, and exactly one
    piece passes. Either way a piece has ``longest`` characters at most, so only the last ``longest`` positions can be left by a
    later piece. When the paths of all of these pass one boundary, the ids before it are committed and forgotten.

    A character that no piece holds gives its bytes' ids (or the unknown id) and ends all paths, too.
    """

    def __init__(self, library: Library):
        sp = library.sp
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(library.proto)
        self.bpe = proto.trainer_spec.model_type == 2
        normal = [i for i in range(len(library.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.library, self.unk = library, sp.unk_id()
        self.ids = {library.pieces[i]: i for i in normal}
        self.score = {library.pieces[i]: sp.get_score(i) for i in normal}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(sp.is_byte(i) for i in self.byte)
        self.known = {c for p in self.ids for c in p}
        #: by character: (id of the piece so far or -1, what may follow)
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p[:-1]:
                node = node.setdefault(c, (-1, {}))[1]
            node[p[-1]] = (i, node[p[-1]][1] if p[-1] in node else {})
        self.size = [len(p) for p in library.pieces]
        self.scores = [sp.get_score(i) for i in range(len(library.pieces))]
        self.longest = max(map(len, self.ids))
        #: by the piece before (-1: none, at the end), whether a piece may follow it, as far as it has been asked
        self.pairs: list[dict[int, bool]] = [{} for _ in range(len(library.pieces) + 1)]
        self.asked = 0
        self.most_held = 0

    def merged(self, text: str) -> list[str]:
        """BPE by definition: merge the neighbours whose joint piece has the best score, leftmost first, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: int, t: int) -> bool:
        """Whether piece t may follow piece a (-1: the start); kept by the caller."""
        self.asked += 1
        if self.asked > 1_000_000:
            self.asked = 0
            for row in self.pairs:
                row.clear()
        pieces = self.library.pieces
        ok = self.merged(pieces[a] + pieces[t]) == [pieces[a], pieces[t]] if a >= 0 else self.merged(pieces[t]) == [pieces[t]]
        self.pairs[a][t] = ok
        return ok

    def fallback(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.has_bytes else [self.unk]

    def encode(self, chars: str) -> list[int]:
        """The ids of a pre-token, spaces written as the space mark."""
        if self.known.issuperset(chars):
            return self.run(chars)
        out: list[int] = []
        at = 0
        for i, c in enumerate(chars):
            if c not in self.known:
                out += self.run(chars[at:i])
                out += self.fallback(c)
                at = i + 1
        return out + self.run(chars[at:])

    def run(self, chars: str) -> list[int]:
        """The ids of characters that all are in some piece."""
        out: list[int] = []
        n, longest, base = len(chars), self.longest, 0  # what is before base is committed
        trie, pairs, bpe = self.trie, self.pairs, self.bpe
        # ends[k]: the piece that ends the best path to base + k; None: not reached. ends[0] is what went before, -1 at the start
        ends: list[int | None] = [-1] + [None] * min(n, 5 * longest)
        best = [0.0] * len(ends)
        for i in range(n):
            k = i - base
            a = ends[k]
            if a is not None:
                after = pairs[a]
                e, below = k, trie
                for c in chars[i : i + longest]:
                    node = below.get(c)
                    if node is None:
                        break
                    t, below = node
                    e += 1
                    if t >= 0:
                        if bpe:
                            if ends[e] is None:
                                ok = after.get(t)
                                if ok or (ok is None and self.follows(a, t)):
                                    ends[e] = t
                        elif ends[e] is None or best[k] + self.scores[t] > best[e]:
                            ends[e], best[e] = t, best[k] + self.scores[t]
            k += 1
            if k >= 4 * longest and i + 1 < n:
                # positions from here to the last that a piece can reach are open; boundaries before are settled
                b = self.converged(ends, k)
                if b:
                    out += self.path(ends, b)
                    ends, best, base = ends[b:], [x - best[b] for x in best[b:]], base + b
                more = max(i + 1 - base, 4 * longest) + longest + 1 - len(ends)
                if more > 0:
                    ends += [None] * more
                    best += [0.0] * more
                self.most_held = max(self.most_held, len(ends))
        return out + self.path(ends, n - base)

    def converged(self, ends: list[int | None], upto: int) -> int:
        """The last boundary that the paths to all positions from ``upto`` - longest + 1 on pass; 0 if none."""
        live = {k for k in range(max(0, upto - self.longest + 1), len(ends)) if ends[k] is not None}
        while len(live) > 1:
            k = max(live)
            live.discard(k)
            live.add(k - self.size[ends[k]] if k else 0)
        return live.pop() if live else 0

    def path(self, ends: list[int | None], k: int) -> list[int]:
        out = []
        while k > 0:
            out.append(ends[k])
            k -= self.size[ends[k]]
        return out[::-1]

    def ids_of(self, key: str) -> list[int]:
        """The ids of a pre-token by its key."""
        return self.encode(key.replace(" ", SPACE) if key[:1] == "\n" else SPACE + key.replace(" ", SPACE))


class Ids(dict):
    """Packed ids by pre-token, in a bounded cache."""

    def __init__(self, lattice: Lattice):
        super().__init__()
        self.lattice = lattice

    def __missing__(self, key: str) -> bytes:
        out = np.array(self.lattice.ids_of(key), np.int32).tobytes()
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHED_IDS:
                self.clear()
            self[key] = out
        return out


class Decoder:
    def __init__(self, library: Library):
        sp = library.sp
        self.parts = [None if sp.is_byte(i) else "" if sp.is_control(i) else " ⁇ " if sp.is_unknown(i) else p.replace(SPACE, " ") for i, p in enumerate(library.pieces)]
        self.bytes = {i: bytes([int(p[3:5], 16)]) for i, p in enumerate(library.pieces) if sp.is_byte(i)}
        self.raw = [self.bytes.get(i, (p or "").encode()) for i, p in enumerate(self.parts)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the space of the first piece is the mark that encoding added."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " and ids and self.parts[ids[0]] else text


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``docs`` and, last, ``ids`` array<int>; with ``decoded`` also the text decoded from the ids again.

    Defined cases: null and empty texts have no ids and decode to the empty text; existing columns of these names are
    replaced; equal rows are encoded each.
    """
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c not in (ids, decoded)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else []))
    shared, tag = docs.sparkSession.sparkContext.broadcast(read_model(model)), uuid.uuid4().hex
    at = kept.index(text)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _workers.get("ids", (None,))[0] != tag:
            library = Library(shared.value)
            _workers["ids"] = tag, Ids(Lattice(library)), Decoder(library)
        _, cache, decoder = _workers["ids"]
        get, cut = cache.__getitem__, cache.lattice.library.cut_lines
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                blobs = [b"".join(map(get, pretokens(x.decode(errors="replace"), cut))) if x else b"" for x in texts(batch, at)]
                offsets = np.zeros(len(blobs) + 1, np.int32)
                np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
                flat = np.frombuffer(b"".join(blobs), np.int32)
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([decoder.decode(np.frombuffer(b, np.int32).tolist()) for b in blobs], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, ids, *([decoded] if decoded else [])])

    return docs.select(*kept).mapInArrow(encoded, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of ``rows`` and, last, the text of ``ids``; null ids give the empty text."""
    from pyspark.sql import types as T

    kept = [c for c in rows.columns if c != text]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(text, T.StringType(), False)])
    shared = rows.sparkSession.sparkContext.broadcast(read_model(model))
    at = kept.index(ids)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Library(shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([decoder.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())], [*kept, text])

    return rows.select(*kept).mapInArrow(decoded, schema)


def encoded_summary(rows: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """key, n_tokens, ids and whether the decoded text is the text again."""
    return rows.select(key, F.size(ids).cast("long").alias("n_tokens"), ids, (F.coalesce(text, F.lit("")) == F.col(decoded)).alias("round_trip"))
