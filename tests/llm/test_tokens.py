import random

import numpy as np
import pytest

from tidemark.llm import tokens

public = pytest.importorskip("public_tokenizers")
MODEL = public.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "a b", "  a  b ", "a\nb\n\n c", "\n", "x" * 300, "▁ ▁a", "é一あ🙂 <s> </s>", "the " * 200, "=" * 99, "\t\x0b", "word." * 40]


@pytest.fixture(scope="module")
def library():
    return tokens.Library(tokens.read_model(MODEL))


def random_texts(n=400):
    random.seed(3)
    return ["".join(random.choice(list("abcdeth  \n\n\tあé一<s>▁ö01!!..")) for _ in range(random.randint(0, 80))) for _ in range(n)]


def test_lattice_and_counts_equal_the_library(library):
    lengths, ids, decoder = tokens.Lengths(library, {}), tokens.Ids(tokens.Lattice(library)), tokens.Decoder(library)
    for x in TEXTS + random_texts():
        want = library.sp.encode(x)
        keys = tokens.pretokens(x, library.cut_lines) if x else []
        assert sum(map(lengths.__getitem__, keys)) == len(want)
        assert np.frombuffer(b"".join(map(ids.__getitem__, keys)), np.int32).tolist() == want
        assert decoder.decode(want) == library.sp.decode(want)


def test_the_window_stays_bounded(library):
    lattice = tokens.Lattice(library)
    x = "".join(random.choice("etaoin") for _ in range(5000))
    assert lattice.encode("▁" + x) == library.sp.encode(x)
    assert lattice.most_held <= 8 * lattice.longest


def test_operators(spark):
    rows = [(i, x, "extra") for i, x in enumerate([*TEXTS, None])] + [(3, "a b", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    sp = tokens.Library(tokens.read_model(MODEL)).sp
    for r in tokens.count_tokens(docs, MODEL, limit=3).collect():
        x = ([*TEXTS, None])[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(x.encode()), len(sp.encode(x)), len(sp.encode(x)) > 3)
    encoded = tokens.encode(docs, MODEL, decoded="back")
    for r in encoded.collect():
        x = r["text"] or ""
        assert r["ids"] == sp.encode(x) and r["back"] == sp.decode(r["ids"])
    assert {r["doc_id"]: r["text"] for r in tokens.decode(encoded.select("doc_id", "ids"), MODEL).collect()}[9] == sp.decode(sp.encode(TEXTS[9]))
    empty = docs.filter("false")
    assert tokens.count_tokens(empty, MODEL).count() == 0 and tokens.encode(empty, MODEL).count() == 0
