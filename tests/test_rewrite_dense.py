import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import dense, rewrite


def test_rewriting(spark):
    long = " ".join(f"Sentence number {i} speaks of {'river' if i % 3 else 'mill'}." for i in range(40))
    df = spark.createDataFrame([("a", long), ("b", "short text"), ("c", None), ("d", "the of and")], "qid string, text string")
    for name in rewrite.STRATEGIES:
        got = {r.qid: r.text for r in rewrite.rewrite(df, name).collect()}
        assert set(got) == {"a", "b", "c", "d"} and got["c"] == ""
    kept = {r.qid: r.text for r in rewrite.tfidf_sentences(df).collect()}["a"]
    numbers = [int(x.split()[2]) for x in kept.split(".") if x.strip()]
    assert len(numbers) == 20 and numbers == sorted(numbers)
    words = {r.qid: r.text for r in rewrite.tfidf_keywords(df).collect()}
    assert words["d"] == "the of and" and words["b"] == "short text"


def test_structured_names_sections(spark):
    text = "A long enough title line\n\nAbstract\nThis is what it is about.\n\n1. Introduction\n" + "z" * 200 + "\nRelated Work\n" + "y" * 100
    got = spark.createDataFrame([(text,)], "t string").select(rewrite.structured(F.col("t"))).first()[0]
    assert got.startswith("A long enough title line Abstract: This is what it is about.") or got == text[:3000]


def test_exact_search_equals_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    docs = spark.createDataFrame([(i, int(i % 4), m[i].tolist()) for i in range(60)], "doc_id bigint, grp int, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in (0, 50)], "qid bigint, embedding array<double>")
    got = dense.dense_search(q, docs.drop("grp"), 5).where("qid = 50").orderBy("rank").collect()
    s = m @ m[50]
    s[50] = -np.inf
    assert [r.doc_id for r in got] == np.argsort(-s)[:5].tolist()
    best = {r.doc_id: r.score for r in dense.chunk_max_pool(q, docs).where("qid = 50").collect()}
    assert best == {g: round(max(s[i] for i in range(60) if i % 4 == g), 6) for g in range(4)}
    assert dense.dense_search(q.where("false"), docs.drop("grp")).count() == 0


def test_encoder_and_pair_scorer(spark):
    df = spark.createDataFrame([("d", "a b a"), ("e", None)], "doc_id string, text string")
    rows = {r.doc_id: r.embedding for r in dense.encode(df).collect()}
    assert abs(sum(x * x for x in rows["d"]) - 1) < 1e-9 and sum(rows["e"]) == 0
    pairs = spark.createDataFrame([("q", "x", "a b", "a c"), ("q", "y", "a b", "a b")], "qid string, doc_id string, query_text string, text string")
    assert [(r.doc_id, r.score) for r in dense.rerank_pairs(pairs).orderBy("rank").collect()] == [("y", 1.0), ("x", 0.5)]
