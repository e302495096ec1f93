import collections
import hashlib
import itertools
import random

import numpy as np

from tidemark.llm import lines, similar, simhash, suffix
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, n_lines string, kept string"


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, x, "clash", "clash") for i, x in enumerate(texts)], SCHEMA).repartition(parts)


def key(line):
    return line.encode().lower().strip(b" \t\n\x0b\x0c\r")


def test_line_dedup(spark):
    random.seed(1)
    texts = ["\n".join(random.choice(["Common line", " common LINE\t", "é", "É", "", "  ", f"own {i}", "pair"]) for _ in range(6)) for i in range(40)] + [None, "", "common line", "x" * 50_000]
    count = collections.Counter(k for x in texts for k in {key(y) for y in (x or "").split("\n")})
    for log2_bits in (7, 24):  # a full filter gives the same
        out = lines.summary(lines.dedup_lines(frame(spark, texts), min_docs=10, keep_first=False, log2_bits=log2_bits)).collect()
        assert len(out) == len(texts)
        for r in out:
            own = (texts[r["doc_id"]] or "").split("\n")
            kept = [y for y in own if not key(y) or count[key(y)] < 10]
            assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    sliced = lines.dedup_lines(frame(spark, texts), min_docs=2, keep_first=False, slice_rows=1)
    whole = lines.dedup_lines(frame(spark, texts), min_docs=2, keep_first=False)
    assert sorted(map(str, lines.summary(sliced).collect())) == sorted(map(str, lines.summary(whole).collect()))


def test_first_occurrence_stays(spark):
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(spark, ["a\nb\nA", "b\na", "c", None])).collect()}
    assert out == {0: "a\nb", 1: "", 2: "c", 3: None}
    assert lines.dedup_lines(frame(spark, ["a"]).filter("false")).count() == 0


def brute(texts, n=200):
    raws = [(x or "").encode() for x in texts]
    seen = collections.Counter(x[i : i + n] for x in raws for i in range(len(x) - n + 1))
    for x in raws:
        mask = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                mask[i : i + n] = b"\1" * n
        yield len(x), sum(mask), sum(k for k, _ in itertools.groupby(mask)), hashlib.sha256(bytes(b for b, m in zip(x, mask, strict=True) if not m)).hexdigest()


def test_suffix_dedup(spark):
    random.seed(5)
    some = lambda n: "".join(random.choice("abcdefghij ") for _ in range(n))
    p, q, e = some(420), some(260), some(1500)
    texts = [some(500) + p + some(300), some(20) + p + some(600), p[:250], some(150) + q + some(90) + p[100:330], q + q, "a" * 1500, "ab" * 700, some(199), "", None, "xyz " * 300, some(77) + "a" * 230, "é" * 150, *[some(900)] * 3]
    texts += [e[:k] + "#" + e[k + 1 :] for k in (10, 300, 310, 700, 1400)]
    want = list(brute(texts))
    out = suffix.summary(suffix.remove_repeats(frame(spark, texts))).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_suffix_dedup_with_small_filters(spark):
    random.seed(6)
    some = lambda n: "".join(random.choice("abcdefghij ") for _ in range(n))
    shared = [some(k) for k in (201, 205, 230, 300, 420)]
    texts = [some(300) + x + some(250) for x in shared * 2] + [some(700) for _ in range(6)] + [some(900)] * 2 + ["ab" * 300, "", None]
    want = list(brute(texts))
    for log2_bits in (8, 11, 14):  # hashes that collide in full and half-full filters lose no repeat
        for hot in (1, 3, 4096):  # all, some or no anchors have their chunks split into windows
            for r in suffix.summary(suffix.remove_repeats(frame(spark, texts), log2_bits=log2_bits, hot=hot)).collect():
                assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], (log2_bits, r["doc_id"])


def test_suffix_dedup_has_one_row_for_each_repeated_stretch(spark, monkeypatch):
    random.seed(12)
    some = lambda n: "".join(random.choice("abcdefghij ") for _ in range(n))
    near, p = some(1200), some(260)
    texts = [near[:k] + f"#{k}#" + near[k + 3 :] for k in range(30, 1170, 40)] + [some(60) + "Is onhe. " * k + some(60) for k in range(25, 60)]
    texts += [some(40) + p + some(250) + p + some(k) for k in range(9)] + [some(500), "short", "", None]
    want = list(brute(texts))
    found, real = [], suffix.spans
    monkeypatch.setattr(suffix, "spans", lambda *a: found.append(suffix.stored(real(*a))) or found[-1])
    for hot, piece in ((3, 1 << 20), (20, 150), (4096, 1 << 20)):  # all, some or no anchors split into windows, which made a row each
        for r in suffix.summary(suffix.remove_repeats(frame(spark, texts), hot=hot, piece=piece)).collect():
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], (hot, r["doc_id"])
        assert found[-1].count() == sum(w[2] for w in want), hot


def test_stretches_of_spans():
    random.seed(13)
    for n in (0, 1, 2, 40, 400):
        spans = [(random.randint(-1, 1), random.randint(-1, 1), a, a + random.randint(1, 9)) for a in (random.randint(0, 150) for _ in range(n))]
        want = []
        for text, own in itertools.groupby(sorted(spans), lambda s: s[:2]):
            merged = []
            for _, _, a, b in own:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            want += [(*text, a, b) for a, b in merged]
        columns = np.array(spans, np.int64).reshape(-1, 4).T
        assert list(zip(*(x.tolist() for x in suffix.stretches(*columns)), strict=True)) == want


def test_reaches_of_chunks():
    random.seed(3)
    for _ in range(300):
        n, length = random.randint(1, 9), random.randint(2, 9)
        chunks = sorted({("".join(random.choice("ab") for _ in range(random.randint(1, 7))).encode(), "".join(random.choice("ab") for _ in range(random.randint(0, 6))).encode()) for _ in range(n)})
        after, before = [c[0] for c in chunks], [c[1] for c in chunks]
        shared = [0, *(suffix.common(a, b, 0) for a, b in itertools.pairwise(after))]
        want = []
        for i, (a, b) in enumerate(chunks):
            found = [(suffix.common(b, y, 0), suffix.common(a, x, 0)) for j, (x, y) in enumerate(chunks) if j != i]
            found = [f for f in found if sum(f) >= length]
            want.append((max(f[0] for f in found), max(f[1] for f in found)) if found else (0, 0))
        assert suffix.reaches(after, before, shared, length) == want


def test_suffix_dedup_of_long_texts_and_odd_bytes(spark):
    random.seed(11)
    some = lambda n: "".join(random.choice("abc\0\x01 é") for _ in range(n))
    p = some(700)
    texts = [some(200) + p + some(900), p[:300] + some(40) + p[250:], "\0" * 700, some(100) + "\0" * 260, p * 3, "z" * 6000, some(4000)]
    want = list(brute(texts))
    for r in suffix.summary(suffix.remove_repeats(frame(spark, texts, 2), piece=333)).collect():  # pieces that cut chunks
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_suffix_dedup_of_nothing(spark):
    assert suffix.remove_repeats(frame(spark, ["a"]).filter("false")).count() == 0


def test_loser_tree():
    random.seed(2)
    runs, everything = [], []
    for _ in range(7):
        strings = sorted({"".join(random.choice("ab") for _ in range(random.randint(0, 90))).encode() for _ in range(60)})
        everything += strings
        runs.append(suffix.Run(suffix.packed_run(strings)))
    out = list(suffix.LoserTree(runs))
    assert [s for _, s, _, _ in out] == sorted(everything)
    for (_, a, _, _), (shared, b, _, _) in itertools.pairwise(out):
        assert shared == suffix.common(a, b, 0)


def test_simhash(spark):
    import xxhash

    random.seed(4)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [random.choice(vocabulary) for _ in range(400)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join([*base[:200], "new", *base[201:]]), "one two", "One\ttwo", "", None, " \n", *(" ".join(random.choice(vocabulary) for _ in range(60)) for _ in range(20))]

    def fingerprint(x):
        w = (x or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    fps = [fingerprint(x) for x in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    out = simhash.near_duplicates(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {i: (f"{f:016x}", r) for i, (f, r) in enumerate(zip(fps, root, strict=True))}
    kept = simhash.one_of_each(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and kept.columns == ["doc_id", "text", "n_lines", "kept"]


def test_one_of_each_with_null_and_repeated_ids(spark):
    random.seed(8)
    a, b, c, d, e = (" ".join(random.choice("abcdefghijklmnop") + str(random.randint(0, 99)) for _ in range(80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (7, a), (3, d), (None, e), (5, e), (None, None), (None, "")]
    want = [(7, a), (None, b), (7, c), (3, d), (5, e), (None, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted((i or 0, x) for i, x in want)


def test_pipeline_joins_similar_documents_only(spark):
    import corpus_pipeline

    random.seed(9)
    text = lambda n: [f"w{random.randint(0, 999)}" for _ in range(n)]
    rows = []
    for n in (40, 60, 90, 150, 300):
        base = text(n)
        for edits in range(n // 12 + 1):  # at distances on both sides of 0.8
            w = list(base)
            for k in random.sample(range(n), edits):
                w[k] = f"x{len(rows)}"
            rows.append(" ".join(w))
    hub = text(200)
    rows += [" ".join([*hub[:k], f"y{k}", *hub[k + 1 :]]) for k in range(0, 200, 3)]  # a group that meets in many values
    rows += ["one two", "One\ttwo", "", None, rows[3].upper()]
    sets = [similar.shingles((x or "").encode()) for x in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and kept.columns == ["doc_id", "text", "n_lines", "kept"]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
