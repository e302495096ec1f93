import pytest
from conftest import DATA
from oracle import same
from test_models import contaminated

from tidemark.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    same(queries()[name](spark, DATA), oracle_sql()[name], DATA)


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline as p
    from tidemark.llm import toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {r["doc_id"]: r for r in p.run(spark, DATA).collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = toxicity.Scores(model.weights)
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if toxicity.score_text((r["text"] or "").encode(), model, scores) < 0.5}
    norm = lambda y: y.encode().lower().strip(b" \t\n\x0b\x0c\r")
    where: dict = {}
    for i in sorted(rows):
        for k in {norm(y) for y in (rows[i] or "").split("\n")}:
            where.setdefault(k, []).append(i)
    for i, x in rows.items():
        seen, kept = set(), []
        for y in (x or "").split("\n"):
            k = norm(y)
            if k and len(where[k]) >= 10:
                if where[k][0] != i or k in seen:
                    continue
                seen.add(k)
            kept.append(y)
        rows[i] = "\n".join(kept)
    # near-duplicates: a similarity of five-word shingles of 0.8 or more
    sets = {i: set(zip(*(w[k:] for k in range(5)))) if len(w := (x or "").encode().lower().split()) >= 5 else {tuple(w)} for i, x in rows.items()}
    root = {i: i for i in rows}
    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    rows = {i: x for i, x in rows.items() if root[i] == i}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    ids = sorted(rows)
    bad = {ids[d] for d, _ in contaminated([rows[i] for i in ids], bench)}
    clean = set(rows) - bad
    assert set(out) == clean
    assert all(r["round_trip"] for r in out.values())
