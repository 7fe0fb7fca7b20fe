import gzip
import json

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import convert
from spanloom.sources import readers, sinks


def test_jsonl_fallbacks_and_gzip(spark, tmp_path):
    rows = [{"doc_id": "a", "default_text": "x"}, {"qid": "b", "query": "y"}, {"doc_id": "", "qid": "c", "default_text": ""}]
    (tmp_path / "c.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    for name in ("c.jsonl", "c.jsonl.gz"):
        assert {tuple(r) for r in readers.read_jsonl(spark, str(tmp_path / name)).collect()} == {("a", "x"), ("b", "y"), ("c", "")}
    assert {tuple(r) for r in readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), "corpus_strict").collect()} == {("a", "x"), ("b", ""), ("c", "")}


def test_run_and_qrels_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q", "a", 1, 2.5), ("q", "b", 2, 1.25)], "qid string, doc_id string, rank int, score double")
    sinks.write_run(run, str(tmp_path / "run"), "tag")
    back = readers.read_run(spark, str(tmp_path / "run")).orderBy("rank").collect()
    assert [(r.qid, r.doc_id, r.rank, r.score, r.tag) for r in back] == [("q", "a", 1, 2.5, "tag"), ("q", "b", 2, 1.25, "tag")]
    assert readers.first_in_file(readers.read_run(spark, str(tmp_path / "run")), 1).count() == 1
    (tmp_path / "qrels").write_text("q 0 a 1\nq 0 a 2\nbad line\nq 0 b 1\nq 0 c 0\n")
    assert {(r.doc_id, r.rel) for r in readers.read_qrels(spark, str(tmp_path / "qrels")).collect()} == {("a", 2), ("b", 1), ("c", 0)}
    assert readers.last_relevant(spark, str(tmp_path / "qrels")).first().doc_id == "b"


def test_candidates_round_trip(spark, tmp_path):
    rows = [("q", "text", [("a", 1.5, "t")])]
    df = spark.createDataFrame(rows, readers.CANDIDATES)
    sinks.write_candidates(df, str(tmp_path / "c"))
    assert [tuple(r) for r in readers.read_candidates(spark, str(tmp_path / "c")).collect()] == [("q", "text", "a", 1.5, "t")]


def test_truth_xml_and_detections(spark, tmp_path):
    (tmp_path / "t.xml").write_text(
        '<document reference="s1.txt"><feature name="plagiarism" source_reference="a.txt" this_offset="5" this_length="10" source_offset="2" source_length="9"/>'
        '<feature name="altered" source_reference="b.txt"/><feature name="plagiarism" source_reference="c.txt"/></document>'
    )
    truth = readers.read_truth(spark, str(tmp_path / "t.xml"))
    assert {(r.source_reference, r.start, r.end) for r in readers.truth_spans(truth).collect()} == {("a.txt", 5, 15), ("c.txt", 0, 0)}
    assert {r.source for r in convert.source_names(truth).collect()} == {"a.txt", "c.txt"}
    found = spark.createDataFrame([("q", "d", 0, 10, 5, 15, 0.9)], "qid string, src string, susp_start int, susp_end int, src_start int, src_end int, score double")
    sinks.write_detections(found, str(tmp_path / "out"))
    assert spark.read.format("xml").option("rowTag", "document").load(str(tmp_path / "out")).count() == 1


def test_loose_json_and_tables(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.txt").write_text('{"language": "en", "n": [1, 2, ], }')
    (tmp_path / "j" / "b.txt").write_text("{broken")
    assert [tuple(r) for r in readers.read_loose_json(spark, str(tmp_path / "j"), "language string").collect()] == [("a.txt", "en")]
    df = spark.createDataFrame([("a", "b")], "kind string, filename string")
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert readers.read_tsv(spark, str(tmp_path / "t")).collect() == df.collect()
    path = sinks.write_cache(df, str(tmp_path), "model-corpus")
    assert spark.read.parquet(path).count() == 1


def test_missing_sources(spark):
    missing = spark.createDataFrame([("k1", "source_url", "u1", "d1"), ("k1", "source_url", "u1", "d1"), ("k2", "clueweb_id", "u2", "d2")], "source_key string, type string, value string, source_doc_id string")
    pages = spark.createDataFrame([("u1", "<p>" + "word " * 20 + "</p>"), ("u2", "<p>short</p>")], "value string, html string")
    docs, errors = convert.resolve_missing(missing, pages)
    assert [r.doc_id for r in docs.collect()] == ["d1"]
    assert [(r.source_doc_id, r.method, r.error) for r in errors.collect()] == [("d2", "search", "empty body")]
    assert convert.register_sources(missing, "c").count() == 2


def test_missing_plain_file_gives_way_to_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"doc_id": "a", "default_text": "x"}\n\n{"qid": "b", "query": "y"}\n')
    assert sorted(map(tuple, readers.read_jsonl(spark, str(tmp_path / "c.jsonl")).collect())) == [("a", "x"), ("b", "y")]


def test_cache_is_read_by_fingerprint(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert sinks.read_cache(spark, str(tmp_path), "m1") is None
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path), "m1", make).count() == 3
    sinks.cached(spark, str(tmp_path), "m2", make)
    assert len(made) == 2


def test_text_name(spark):
    df = spark.createDataFrame([("x.html",), ("y.htm",), ("a.html.html",)], "n string")
    assert [r[0] for r in df.select(text.text_name(F.col("n"))).collect()] == ["x.txt", "y.htm.txt", "a.html.txt"]
