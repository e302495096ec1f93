"""Toxicity by weak supervision.

1. Voters: fixed lexicons, text patterns, and lexicons mined from a sample of labelled rows: words and word beginnings that
   are far more frequent in toxic ones, each kind mined on several parts of the rows, so that voters differ. A voter
   votes toxic, votes clean, or abstains.
2. Label model: a generative model of the votes given the unknown class, fitted by EM to the votes of all documents that aren't held
   out, copies once. Executors cast the votes and count equal ballots; the driver sees one row for each ballot, whose number depends on
   the voters, not on the documents. Each voter has its own rates of each vote in each class. Rows with a label show the voters' rates
   (their class is known in the M step, with as much weight in all as the other rows), but no label enters a posterior: that comes from
   the votes alone. Each pair of voters has a correlation given the class; a voter's log-odds are divided by the sum of its own, so
   that voters that say the same thing count as one.
3. A linear classifier, logistic regression on words and word beginnings, is trained on the posterior labels of a sample. It alone scores.

Mining and the classifier read bounded samples, chosen by hash of the id: ``MAX_LABELLED`` labelled rows and ``MAX_UNLABELLED`` others,
none of them held out. Everything else covers all rows; scoring is one pass without a shuffle.

Words: ASCII white space and punctuation separate them, A-Z in lower case. Labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts get the score of a text without known features; without labels of both classes there are no
mined voters and the fixed ones start with documented accuracies; rows with an id that occurs more than once in ``labels`` are toxic if any
label says so; null ids and null labels are not learned from; further columns are ignored by ``score`` and kept by ``clean``; a text of any length is scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_bucket, id_bucket_column, sliced, texts

MAX_LABELLED = 8_000
MAX_UNLABELLED = 2_000
#: Features of the classifier, at most.
MAX_FEATURES = 6_000
BEGINNINGS = (4, 5, 6)
PARTS = 3
#: What makes a feature telling enough for a mined voter: standard errors, and times as frequent.
MINED_Z, MINED_TIMES = 5.0, 8.0
SATURATION = 4
SEPARATORS = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))

#: Fixed lexicons.
LEXICONS = {
    "en_insults": "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb jerk fool fools garbage imbecile",
    "en_hate": "hate kill die vermin subhuman filthy filth shut disgrace",
    "en_vulgar": "damn crap bastard bitch shit fuck fucking asshole ass",
    "de_insults": "idiot dumm blöd trottel arschloch depp abschaum wertlos widerlich erbärmlich müll",
    "fr_insults": "idiot idiote imbécile connard stupide ordure pathétique dégoûtant crétin",
    "es_insults": "idiota imbécil estúpido basura escoria patético asqueroso payaso inútil",
}
LEXICON_SETS = {k: set(v.split()) for k, v in LEXICONS.items()}
#: Fixed patterns over the raw text.
PATTERNS = {
    "you_are": re.compile(rb"(?i)\byou(?:'re| are)? (?:such )?an? [a-z]{3,}"),
    "shouts": re.compile(rb"[A-Z]{4,} [A-Z]{4,}!"),
    "bangs": re.compile(rb"!{3,}"),
    "starred": re.compile(rb"\b[a-z]\*{2,}[a-z]?\b"),
}


def words_of(raw: bytes) -> set[str]:
    return set(raw.lower().translate(SEPARATORS).decode(errors="replace").split())


def features_of(word: str) -> list[int]:
    """32-bit hashes of the word and, if it is longer, of its beginnings; the last two bits tell the kind: 0 the word, then each beginning."""
    import xxhash

    h = xxhash.xxh32_intdigest
    return [h(word) & ~3, *(h(word[:n], k) & ~3 | k for k, n in enumerate(BEGINNINGS, 1) if len(word) > n)]


@dataclass
class Model:
    bias: float
    weights: dict[int, float]  # by feature
    voters: dict[str, tuple[float, float]] = field(default_factory=dict)  # true and false positive rate
    #: sum of a voter's correlations with all voters given the class, its own of 1 included
    correlated: dict[str, float] = field(default_factory=dict)


@dataclass
class Row:
    """A training text: its label or None, features with counts, fixed voters' votes, and a signature that copies share."""

    y: int | None
    features: np.ndarray
    counts: np.ndarray
    votes: list[int]
    signature: int


class Features(dict):
    """Features by word, kept while they are many texts' words."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = features_of(word)
        return out


def described(raw: bytes, cache: Features) -> tuple[np.ndarray, np.ndarray, list[int], int]:
    import xxhash

    words = words_of(raw)
    features, counts = np.unique(np.array([f for w in words for f in cache[w]], np.uint32), return_counts=True)
    votes = [int(not own.isdisjoint(words)) for own in LEXICON_SETS.values()] + [int(bool(p.search(raw))) for p in PATTERNS.values()]
    # near copies share their four least word hashes
    least = sorted(map(xxhash.xxh3_64_intdigest, words))[:4] if len(words) > 8 else [xxhash.xxh3_64_intdigest(" ".join(sorted(words)))]
    return features, np.minimum(counts, SATURATION).astype(np.uint8), votes, xxhash.xxh3_64_intdigest(repr(least)) >> 1


def trainable():
    return F.col("i").isNotNull() & (id_bucket_column(F.col("i")) != 0)


def known_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(i, y) of the labelled rows that aren't held out."""
    known = labels.select(F.col(key).alias("i"), F.col(label).cast("int").alias("y")).filter(trainable() & F.col("y").isNotNull())
    return known.groupBy("i").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> list[Row]:
    """At most MAX_LABELLED + MAX_UNLABELLED training rows. Texts become feature hashes where they are; the driver sees no text."""
    known = known_labels(labels, key, label).orderBy(F.xxhash64("i"), "i").limit(MAX_LABELLED)
    others = docs.select(F.col(key).alias("i")).filter(trainable()).orderBy(F.xxhash64(F.col("i"), F.lit(1)), "i").limit(MAX_UNLABELLED).select("i", F.lit(None).cast("int").alias("y"))
    chosen = known.unionByName(others).groupBy("i").agg(F.max("y").alias("y"))
    # at most MAX_LABELLED + MAX_UNLABELLED rows, by the limits above
    found = docs.select(F.col(key).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Features()
        for batch in batches:
            rows = [described(x, cache) for x in texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.int64())], ["i", "y", "features", "counts", "votes", "signature"])

    kind = docs.schema[key].dataType.simpleString()
    got = found.mapInArrow(features, f"i {kind}, y int, features binary, counts binary, votes array<int>, signature long").toArrow()
    order = np.argsort(np.array(got.column("signature").to_pylist(), np.int64), kind="stable")
    columns = [got.column(c).to_pylist() for c in ("y", "features", "counts", "votes", "signature")]
    return [Row(columns[0][k], np.frombuffer(columns[1][k], np.uint32), np.frombuffer(columns[2][k], np.uint8), columns[3][k], columns[4][k]) for k in order.tolist()]


def rows_of(texts_: list[tuple[bytes, int | None]]) -> list[Row]:
    """Training rows of texts and labels that are at hand."""
    cache = Features()
    return [Row(y, *described(x, cache)) for x, y in texts_]


class Matrix:
    """Rows of features with counts. Features of fewer than three rows are left out."""

    def __init__(self, rows: list[Row], least: int = 3):
        at = np.concatenate([r.features for r in rows]) if rows else np.zeros(0, np.uint32)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r.features) for r in rows]) if rows else np.zeros(0, np.int32)
        values = np.concatenate([r.counts for r in rows]) if rows else np.zeros(0, np.uint8)
        names, n = np.unique(at, return_counts=True)
        self.names = names[n >= least]
        keep = np.isin(at, self.names)
        self.at = np.searchsorted(self.names, at[keep])
        self.row, self.values, self.n = row[keep], values[keep].astype(float), len(rows)
        self.kind = (self.names & 3).astype(np.int64)

    def telling(self, pos: np.ndarray, neg: np.ndarray, z: float, times: float, least: int = 3) -> np.ndarray:
        """Features, the most telling first, that rows of weight ``pos`` have significantly and ``times`` more often than those of ``neg``."""
        n1, n0 = pos.sum(), neg.sum()
        if n1 < 5 or n0 < 5:
            return np.zeros(0, np.int64)
        c1 = np.bincount(self.at, pos[self.row], len(self.names))
        c0 = np.bincount(self.at, neg[self.row], len(self.names))
        pooled = np.clip((c1 + c0) / (n1 + n0), 1e-12, 1 - 1e-12)
        score = (c1 / n1 - c0 / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
        ok = np.flatnonzero((c1 >= least) & (score > z) & (c1 / n1 > times * c0 / n0))
        return ok[np.argsort(-score[ok], kind="stable")]

    def hits(self, features: np.ndarray) -> np.ndarray:
        """How many of the features each row has."""
        chosen = np.zeros(len(self.names), bool)
        chosen[features] = True
        return np.bincount(self.row[chosen[self.at]], minlength=self.n)


class Voters:
    """The fixed voters and the mined ones, cast as a ballot: one bit for each that finds something."""

    def __init__(self, mined: dict[str, np.ndarray]):
        self.names = [*LEXICONS, *PATTERNS, *mined]
        self.fixed = len(LEXICONS) + len(PATTERNS)
        self.by_feature: dict[int, int] = {}
        for k, features in enumerate(mined.values(), self.fixed):
            for f in features.tolist():
                self.by_feature[f] = self.by_feature.get(f, 0) | 1 << k
        self.by_word: dict[bytes, int] = {}

    def of_word(self, word: bytes) -> int:
        out = self.by_word.get(word)
        if out is None:
            text = word.decode(errors="replace")
            out = 0
            for k, own in enumerate(LEXICON_SETS.values()):
                out |= (text in own) << k
            for f in features_of(text):
                out |= self.by_feature.get(f, 0)
            if len(self.by_word) >= 400_000:
                self.by_word.clear()
            if len(word) <= 64:
                self.by_word[word] = out
        return out

    def ballot(self, raw: bytes) -> int:
        out = 0
        for k, p in enumerate(PATTERNS.values(), len(LEXICONS)):
            out |= bool(p.search(raw)) << k
        for x in map(self.of_word, set(raw.lower().translate(SEPARATORS).split())):
            out |= x
        return out

    def votes(self, ballots: np.ndarray) -> np.ndarray:
        """1 toxic, 0 abstains, -1 clean: mined words vote clean where they find nothing, the others abstain."""
        hit = (ballots[:, None] >> np.arange(len(self.names))) & 1
        return np.where(hit > 0, 1, np.where([x.startswith("words_") for x in self.names], -1, 0))


@dataclass
class LabelModel:
    """Class prior, vote rates [voter, class, vote + 1], and correlations [voter, voter] given the class."""

    prior: float
    rates: np.ndarray
    correlations: np.ndarray

    def weights(self) -> np.ndarray:
        return 1 / np.clip(self.correlations, 0, 1).sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of class 1, from the votes alone."""
        odds = (np.log(self.rates[:, 1, :]) - np.log(self.rates[:, 0, :])) * self.weights()[:, None] * [1, 0, 1]  # who abstains says nothing
        logit = math.log(self.prior / (1 - self.prior)) + sum((odds[k, votes[:, k] + 1] for k in range(votes.shape[1])), np.zeros(len(votes)))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def label_model(votes: np.ndarray, start: np.ndarray, gold: np.ndarray, n: np.ndarray | None = None, rounds: int = 40) -> LabelModel:
    """Fitted by EM to ballots: votes [ballot, voter] of -1 clean, 0 abstains, 1 toxic; n: how often each was cast; start: the first
    posterior; gold: 1 or -1 where the class is known, else 0."""
    n = np.ones(len(votes)) if n is None else n.astype(float)
    known = gold != 0
    # the rows of known class weigh as much as the others, in all, and no more than ten times what they are
    weight = np.where(known, n * np.clip(n[~known].sum() / max(1.0, n[known].sum()), 1, 10), n)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    truth = np.where(gold > 0, 1.0, 0.0)
    out = LabelModel(0.1, np.full((votes.shape[1], 2, 3), 1 / 3), np.eye(votes.shape[1]))
    post = start.astype(float)
    for _ in range(rounds):
        post = np.where(known, truth, post)
        total = np.zeros((votes.shape[1],) * 2)
        for c, w in ((0, weight * (1 - post)), (1, weight * post)):
            rates = (np.einsum("n,nmv->mv", w, onehot) + 0.5) / (w.sum() + 1.5)
            out.rates[:, c, :] = rates
            x = (votes - (rates[:, 2] - rates[:, 0])) * np.sqrt(w / max(w.sum(), 1e-9))[:, None]
            total += x.T @ x
        scale = np.sqrt(np.clip(np.diag(total), 1e-9, None))
        out.correlations = np.clip(total / scale[:, None] / scale[None, :], -1, 1)
        np.fill_diagonal(out.correlations, 1.0)
        out.prior = float(np.clip((n * post).sum() / n.sum(), 0.001, 0.5))
        post = out.posterior(votes)
    return out


def mined_voters(rows: list[Row], m: Matrix) -> dict[str, np.ndarray]:
    """Features by voter, from the labels of the sample."""
    gold = np.array([0 if r.y is None else 1 if r.y > 0 else -1 for r in rows])
    part = np.arange(len(rows)) % PARTS
    out = {}
    for k in range(PARTS):
        features = m.telling(((gold > 0) & (part != k)).astype(float), ((gold < 0) & (part != k)).astype(float), MINED_Z, MINED_TIMES)
        for kind in range(len(BEGINNINGS) + 1):
            own = features[m.kind[features] == kind]
            if len(own):
                out[f"{'words' if not kind else f'beginnings_{BEGINNINGS[kind - 1]}'}_{k}"] = m.names[own]
    return out


Cast = tuple[np.ndarray, np.ndarray, np.ndarray]


def cast(docs: DataFrame, labels: DataFrame, voters: Voters, key: str, text: str, label: str) -> Cast:
    """Ballots of all documents that aren't held out, their known class or 0, and how often each comes; equal texts vote once."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in sliced(batches, 1024):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([voters.ballot(x) for x in texts(batch, 2)], pa.int64())], ["i", "h", "ballot"])

    kind = docs.schema[key].dataType.simpleString()
    body = docs.select(F.col(key).alias("i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t")).filter(trainable())
    one = body.mapInArrow(run, f"i {kind}, h long, ballot long").join(known_labels(labels, key, label), "i", "left").groupBy("h").agg(F.max("ballot").alias("ballot"), F.max("y").alias("y"))
    rows = one.groupBy("ballot", F.coalesce(F.signum(F.col("y") - 0.5).cast("int"), F.lit(0)).alias("gold")).count().toArrow()
    return tuple(rows.column(c).to_numpy() for c in ("ballot", "gold", "count"))


def train(rows: list[Row], cast_votes=None) -> Model:
    """``cast_votes`` gives the ballots of all documents to given voters; without it, the rows themselves vote."""
    rows = without_copies(rows)
    m = Matrix(rows)
    if not len(m.names):
        return Model(-2.0, lexicon_weights())
    voters = Voters(mined_voters(rows, m))
    own = np.zeros(len(rows), np.int64)
    for k in range(voters.fixed):
        own |= np.array([r.votes[k] for r in rows], np.int64) << k
    of_feature = np.array([voters.by_feature.get(int(f), 0) for f in m.names], np.int64)
    np.bitwise_or.at(own, m.row, of_feature[m.at])
    if cast_votes is None:
        gold = np.array([0 if r.y is None else 1 if r.y > 0 else -1 for r in rows])
        ballots, n = own, np.ones(len(rows))
    else:
        ballots, gold, n = cast_votes(voters)
    votes = voters.votes(ballots)
    if len(voters.names) > voters.fixed:
        start = np.where(votes[:, voters.fixed :].max(axis=1) > 0, 0.9, 0.02)
    else:
        start = np.where(votes.max(axis=1) > 0, 0.9, 0.05)
    fitted = label_model(votes, start, gold, n)
    bias, weights = classifier(m, fitted.posterior(voters.votes(own)))
    if not weights:
        bias, weights = -2.0, lexicon_weights()
    together = 1 / fitted.weights()
    return Model(bias, weights, {x: (float(fitted.rates[i, 1, 2]), float(fitted.rates[i, 0, 2])) for i, x in enumerate(voters.names)}, {x: float(together[i]) for i, x in enumerate(voters.names)})


def without_copies(rows: list[Row]) -> list[Row]:
    """One row of each group of copies, a labelled one if there is one."""
    seen: dict[int, Row] = {}
    for row in rows:
        have = seen.get(row.signature)
        if have is None or (have.y is None and row.y is not None):
            seen[row.signature] = row
    return list(seen.values())


def lexicon_weights() -> dict[int, float]:
    return {features_of(w)[0]: 3.0 for own in LEXICON_SETS.values() for w in own}


def classifier(m: Matrix, post: np.ndarray, rounds: int = 300, l2: float = 0.0002) -> tuple[float, dict[int, float]]:
    """Logistic regression on soft labels over the features that tell the classes apart; full gradient steps with momentum."""
    chosen = m.telling((post >= 0.5).astype(float), (post < 0.5).astype(float), 5.0, 5.0)[:MAX_FEATURES]
    if not len(chosen):
        return -2.0, {}
    place = np.full(len(m.names), -1)
    place[chosen] = np.arange(len(chosen))
    used = place[m.at] >= 0
    row, column, value = m.row[used], place[m.at[used]], m.values[used]
    w, vw, vb = np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0
    share = float(np.clip(post.mean(), 0.001, 0.5))
    b = math.log(share / (1 - share))
    for k in range(rounds):
        step = 3.0 / (1 + k / 100)
        logit = b + np.bincount(row, value * w[column], minlength=m.n)
        err = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - post
        gradient = np.bincount(column, value * err[row], minlength=len(chosen)) / m.n + l2 * w
        vw, vb = 0.8 * vw - step * gradient, 0.8 * vb - step * err.mean()
        w, b = np.clip(w + vw, 0, None), b + vb
    scale, shift = calibrated(b + np.bincount(row, value * w[column], minlength=m.n), post)
    w, b = w * scale, b * scale + shift
    return float(b), {int(m.names[f]): float(w[i]) for i, f in enumerate(chosen) if w[i] > 1e-6}


def calibrated(logit: np.ndarray, post: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logits that fit the posterior best, by Newton steps; the slope stays positive."""
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * logit + c, -30, 30)))
        err, h = p - post, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(err * logit).mean() + 0.001 * (a - 1), err.mean()])
        hessian = np.array([[(h * logit * logit).mean() + 0.001, (h * logit).mean()], [(h * logit).mean(), h.mean() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        a, c = float(np.clip(a - np.clip(step[0], -0.5, 0.5), 0.1, 20)), float(c - np.clip(step[1], -1, 1))
    return a, c


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    return train(sample(docs, labels, key, text, label), lambda voters: cast(docs, labels, voters, key, text, label))


class Scores(dict):
    """By word, the classifier's weights of its features: a list of (feature, weight), mostly empty."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes):
        out = tuple((f, self.weights[f]) for f in features_of(word.decode(errors="replace")) if f in self.weights)
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def score_text(raw: bytes, model: Model, scores: Scores) -> float:
    """Probability of class 1; a feature counts once a distinct word, up to SATURATION times."""
    seen: dict[int, int] = {}
    logit = model.bias
    for hit in filter(None, map(scores.__getitem__, set(raw.lower().translate(SEPARATORS).split()))):
        for f, w in hit:
            k = seen.get(f, 0)
            if k < SATURATION:
                seen[f] = k + 1
                logit += w
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = Scores(model.weights)
        for batch in batches:
            p = [score_text(x, model, scores) for x in texts(batch, 1)]
            held = [id_bucket(i) == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], [key, "held_out", "score", "predicted"])

    shape = docs.select(F.col(key), F.lit(True).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return docs.select(key, text).mapInArrow(scored, shape.schema)


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns."""
    names = docs.columns
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = Scores(model.weights)
        for batch in batches:
            yield batch.filter(pa.array([score_text(x, model, scores) < threshold for x in texts(batch, at)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
