import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ctw, decontaminate, quality, sharding, toxicity

DATA = "/root/testdata/sf0.01"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i, x, 0.5) for i, x in enumerate(texts, start)], "doc_id long, text string, score double")


def tree_probability(counts, context, bits, depth):
    """CTW by its definition: blocks from the root down, then the prediction along the context's path."""

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def block(suffix, node):
        z, o = counts[suffix, node]
        if len(suffix) == depth:
            return kt(z, o)
        below = sum(block(bytes([c]) + suffix, node) for c in range(256) if (bytes([c]) + suffix, node) in counts)
        return np.logaddexp(kt(z, o), below) - math.log(2)

    total, node = 0.0, 1
    for bit in bits:
        p = None
        for d in range(depth, -1, -1):
            suffix = context[len(context) - d :]
            z, o = counts.get((suffix, node), (0, 0))
            one = (o + 0.5) / (z + o + 1)
            if d == depth:
                p = one
                continue
            whole = block(suffix, node) if (suffix, node) in counts else 0.0
            stop = math.exp(kt(z, o) - math.log(2) - whole)
            p = stop * one + (1 - stop) * p
        total += math.log10(p if bit else 1 - p)
        node = node * 2 + bit
    return total


def test_ctw_against_its_definition(spark):
    random.seed(1)
    texts = ["".join(random.choice("abA ") for _ in range(random.randint(0, 25))) for _ in range(30)] + [None, "zé"]
    depth = 2
    counts: dict = collections.defaultdict(lambda: [0, 0])
    bits_of = lambda y: [y >> (7 - k) & 1 for k in range(8)]
    train = [x for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    for x in train:
        b = b"\0" * depth + (x or "").encode().lower() + b"\0"
        for i in range(depth, len(b)):
            node = 1
            for bit in bits_of(b[i]):
                for d in range(depth + 1):
                    counts[b[i - d : i], node][bit] += 1
                node = node * 2 + bit
    counts = {k: tuple(v) for k, v in counts.items()}
    c = collections.Counter(w for x in train for w in [*(x or "").encode().lower().split(), b""])
    N, V = sum(c.values()), len(c)
    for slice_rows in (ctw.SLICE, 20):
        for r in ctw.score_documents(frame(spark, texts), depth=depth, slice_rows=slice_rows).collect():
            raw = (texts[r["doc_id"]] or "").encode().lower()
            b = b"\0" * depth + raw + b"\0"
            want = sum(tree_probability(counts, b[i - depth : i], bits_of(b[i]), depth) for i in range(depth, len(b)))
            tokens = [*raw.split(), b""]
            assert r["score"] == pytest.approx(want, rel=1e-4, abs=1e-4)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), N)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (N + 0.5 * (V + 1))) for w in tokens))
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    assert ctw.score_documents(frame(spark, ["a"]).filter("false")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count()
    both = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert (both["predicted"] == both["toxic"]).mean() > 0.95
    assert both[both["toxic"] == 0]["predicted"].mean() < 0.02
    assert sorted(model.weights) != [] and model.voters["words_0"][0] > model.voters["words_0"][1]
    assert toxicity.clean(docs, model).columns == docs.columns


def test_label_model_finds_what_simulated_voters_are_like():
    rng = np.random.default_rng(5)
    n, true, false = 20_000, np.array([0.9, 0.8, 0.7, 0.85, 0.75]), np.array([0.05, 0.1, 0.02, 0.08, 0.03])
    y = rng.random(n) < 0.2
    votes = np.where(rng.random((n, 5)) < np.where(y[:, None], true, false), 1, -1)
    votes = np.hstack([votes, votes[:, 4:], votes[:, 4:]])  # two voters that copy another
    gold = np.where(rng.random(n) < 0.02, np.where(y, 1, -1), 0)
    for known in (gold, np.zeros(n, int)):  # with some labels, and without any
        m = toxicity.label_model(votes, np.where(votes.sum(axis=1) > 0, 0.9, 0.05), known)
        assert abs(m.rates[:5, 1, 2] - true).max() < 0.05 and abs(m.rates[:5, 0, 2] - false).max() < 0.03 and abs(m.prior - 0.2) < 0.03
        assert m.correlations[4, 5] > 0.95 and abs(m.correlations[:4, :4] - np.eye(4)).max() < 0.15
        assert abs(m.weights()[4:] - 1 / 3).max() < 0.06
        assert ((m.posterior(votes) > 0.5) == y).mean() > 0.97
    counted, times = np.unique(np.hstack([votes, gold[:, None]]), axis=0, return_counts=True)
    again = toxicity.label_model(counted[:, :-1], np.where(counted[:, :-1].sum(axis=1) > 0, 0.9, 0.05), counted[:, -1], times)
    assert np.allclose(again.rates, toxicity.label_model(votes, np.where(votes.sum(axis=1) > 0, 0.9, 0.05), gold).rates, atol=1e-6)


def test_votes_overrule_a_wrong_label():
    random.seed(2)
    bad, plain = [f"slur{i}" for i in range(6)], [f"word{i}" for i in range(300)]
    rows, wrong = [], []
    for i in range(600):
        toxic = i % 4 == 0
        x = " ".join([*random.choices(plain, k=30), *(random.sample(bad, 3) if toxic else [])]).encode()
        wrong += [x] if toxic and i % 60 == 0 else []
        rows.append((x, int(toxic and i % 60 != 0)))
    model = toxicity.train(toxicity.rows_of(rows))
    scores = toxicity.Scores(model.weights)
    assert len(wrong) == 10 and all(toxicity.score_text(x, model, scores) > 0.9 for x in wrong)


def test_toxicity_of_odd_rows(spark):
    rows = [(i % 40 if i % 9 else None, f"you are a fine w{i} person" if i % 3 else f"you worthless idiot w{i}", 0.1) for i in range(300)] + [(7, None, 0.2), (8, "", 0.3), (9, "idiot " * 40_000, 0.4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0) if i % 5 else None) for i in range(40)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert toxicity.clean(docs, toxicity.fit(docs, labels)).columns == docs.columns


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["you idiot", "a fine day", None, ""])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert out == {0: 1, 1: 0, 2: 0, 3: 0}
    assert toxicity.score(docs.filter("false"), toxicity.fit(docs.filter("false"), labels)).count() == 0


def repeat_words(w):
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_quality(spark):
    random.seed(3)
    texts = [" ".join(random.choice("abcd") for _ in range(n)) for n in (0, 7, 8, 9, 30, 200)] + [None, "", "x\n\nx\n x\nx", "A!! " * 40, "of%%% the&&& " * 20, " ".join(f"word{i}" for i in range(50)), "é" * 10]
    order = list(quality.RULES)
    for o in (order, order[::-1], None):
        for r in quality.judge(frame(spark, texts), order=o).collect():
            x = texts[r["doc_id"]] or ""
            w = x.encode().split()
            lines = [y for y in x.split("\n") if y.strip(" \t\n\x0b\x0c\r")]
            repeats = repeat_words(w)
            assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(len(y.decode()) for y in w), sum(x.count(c) for c in "#*$%&|<>"))
            assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), repeats)
            assert r["base_failed"] == (len(w) < 20 or 100 * repeats > 30 * len(w))
            assert r["kept"] == (not r["base_failed"] and not any(rule(quality.Text(x.encode())) for rule in quality.RULES.values()))
    assert quality.cascade_order({"a": (1.0, 0.1), "b": (0.1, 0.05)}, {"a": None, "b": None}) == ["b", "a"]
    assert quality.judge(frame(spark, ["a"]).filter("false")).count() == 0


def contaminated(texts, items, threshold=0.8):
    """(document, item) of all windows of all documents, by counting tuples of words."""

    def shingles(w, size):
        return collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))

    split = lambda x: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (x or "").lower())
    found = set()
    for d, x in enumerate(texts):
        w = split(x)
        for name, y in items:
            item = split(y)
            size = min(5, len(item))
            if not item or len(w) < size:
                continue
            own = shingles(item, size)
            for a in range(max(1, len(w) - len(item) + 1)):
                have = shingles(w[a : a + len(item)], size)
                both = sum((have & own).values())
                if both >= threshold * (sum(have.values()) + sum(own.values()) - both) - 1e-9:
                    found.add((d, name))
                    break
    return found


def test_decontamination_recall(spark):
    random.seed(12)
    words = [f"u{i}" for i in range(400)]
    items = [[random.choice(words) for _ in range(random.randint(12, 70))] for _ in range(60)]
    texts = []
    for _ in range(400):  # passages with changes, on both sides of the threshold, and some that repeat words
        w = list(random.choice(items))
        for _ in range(random.randint(0, max(1, len(w) // 12))):
            w[random.randrange(len(w))] = random.choice(words)
        texts.append(" ".join([*random.choices(words, k=random.randint(0, 40)), *w, *random.choices(words, k=random.randint(0, 40))]))
    texts += [" ".join(x) for x in items[:5]] + ["u1 " * 300, " ".join(items[7]) + " " + "u2 " * 50]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(99, "u1 " * 40)]
    want = contaminated(texts, bench)
    out = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert out <= want and len(want) > 150 and len(out) >= 0.97 * len(want)


def test_decontamination_blocks_are_selective():
    rng = np.random.default_rng(3)
    index = decontaminate.Index([(i, " ".join(f"{i}x{k}" for k in range(30)).encode()) for i in range(300)], 0.8)
    windows = rng.integers(0, 1 << 63, 2000, np.int64).view(np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000).astype(np.uint64)
    found, _ = index.candidates(30, windows)
    assert len(found) < 0.05 * 2000 * 300
    for flips in range(decontaminate.RADIUS + 1):  # all within the radius are found
        masks = np.array([sum(1 << int(b) for b in rng.choice(64, flips, replace=False)) for _ in range(300)], np.uint64)
        assert {(w, i) for w, i, _ in index.within(30, index.fp ^ masks, decontaminate.RADIUS)} >= {(i, i) for i in range(300)}


def test_decontamination_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    bench = spark.createDataFrame([(None, "a b c d e f g"), (3, "h i j k l m n"), (3, "h i j k l m n")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x a b c d e f g", 1), (None, "x a b c d e f g", 1), (5, long + " h i j k l m n " + long, 2), (6, long, 3)], "doc_id long, text string, item_id int")
    out = sorted(map(str, (tuple(r) for r in decontaminate.matches(docs, bench).select("doc_id", "item_id", "similarity", "start_word").collect())))
    assert out == sorted(map(str, [(None, None, 1.0, 1)] * 2 + [(5, 3, 1.0, 60_000)] * 2))
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [6]


def test_decontamination(spark):
    random.seed(6)
    words = [f"v{i}" for i in range(300)]
    some = lambda n: [random.choice(words) for _ in range(n)]
    items = [some(n) for n in (3, 5, 12, 40, 60, 60)]
    docs = [some(200) for _ in range(20)]
    docs += [[*some(50), *items[2], *some(9)], [*items[3]], [*some(30), *items[4][:30], "other", *items[4][31:], *some(5)], [*some(20), *items[5][:25], *some(20)], [*some(4), *items[0], *some(4)], [*some(8), *items[1]]]
    texts = [" ".join(d) for d in docs] + [None, "", " ".join(items[3]).upper().replace(" ", ", ")]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    want = contaminated(texts, [(i, " ".join(x)) for i, x in enumerate(items)])
    out = decontaminate.matches(frame(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == want and len(want) >= 6
    kept = decontaminate.clean(frame(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.matches(frame(spark, texts).filter("false"), bench).count() == 0
    assert decontaminate.matches(frame(spark, texts), bench.filter("false")) is not None


def test_sharding(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None) for i in range(500)] + [(None, "x")] * 3 + [(1, "t1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shards(docs, 8).toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {8}
    assert out.groupby("doc_id")["shard"].nunique().max() == 1
    weights = sharding.assign(docs, sharding.topology(4, weights={0: 3.0})).groupBy("shard").agg(F.count("*").alias("n")).toPandas().set_index("shard")["n"]
    assert weights[0] > 2 * weights[3] * 0.7
    assert sharding.shards(docs.filter("false"), 8).count() == 0
