import duckdb
import pytest

import __spark_entry__ as entry
from spanloom.plans import oracles

NAMES = ["bm25_segmented_coverage", "paragraph_chunks", "sentence_spans_v2", "ndcg_at_k", "bm25_bag_top10", "dense_composite"]


def test_every_sql_has_its_query():
    assert set(oracles.SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_in_both_engines(spark, small, name):
    con = duckdb.connect()
    for t in "corpus queries qrels run embeddings documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    sql = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in sql.description)
    order = [[d[0] for d in sql.description].index(c) for c in cols]
    want = sorted(tuple(r[i] for i in order) for r in sql.fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in entry.queries()[name](spark, small).collect())
    assert got == want


def test_flagship(spark, small):
    assert entry.entry(spark).count() > 0


def test_all_windows_of_a_long_text_ask(spark, tmp_path):
    docs = [("d1", "fox"), ("d2", "tea cup"), ("d3", "fox cup")]
    spark.createDataFrame([(d, t, None, None) for d, t in docs], "doc_id string, default_text string, qid string, query string").write.parquet(str(tmp_path / "corpus.parquet"))
    texts = [("q", "fox " * 6000 + "tea"), ("s", "cup")]
    spark.createDataFrame([(q, t, None, None) for q, t in texts], "qid string, query string, query_id string, default_text string").write.parquet(str(tmp_path / "queries.parquet"))
    con = duckdb.connect()
    for t in ("corpus", "queries"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT qid, doc_id, score, rank FROM ({entry.oracle_sql()['bm25_segmented_max']})").fetchall())
    got = sorted((r.qid, r.doc_id, r.score, r.rank) for r in entry.queries()["bm25_segmented_max"](spark, str(tmp_path)).collect())
    assert got == want and {d for q, d, *_ in got if q == "q"} == {"d1", "d2", "d3"}
