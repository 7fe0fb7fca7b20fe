import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.functions import text as fn


def one(spark, value, make):
    return spark.createDataFrame([Row(x=value)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


def test_tokens_follow_lowercase_ascii_runs(spark):
    for t in ["", "Ab-c 12 É2 x", "été 2x", "A" * 50, "日本 abc"]:
        assert one(spark, t, fn.tokens) == re.findall("[a-z0-9]+", t.lower())
    assert one(spark, None, fn.tokens) == []


def test_strip_is_unicode_aware(spark):
    for t in ["  a b\t\n", " x ", "　y　z ", "\x1cq\x1f", ""]:
        assert one(spark, t, fn.strip) == t.strip()


def test_char_ngrams_guard_short_texts(spark):
    for t in ["", "a", "ab", "abc", "aAaa", "日本語だ", "x😀yz"]:
        low = t.lower()
        assert sorted(one(spark, t, fn.char_ngrams)) == sorted({low[i : i + 3] for i in range(len(low) - 2)})


def test_jaccard_of_empty_sets_is_zero(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(fn.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def test_clean_html_decodes_ampersand_first(spark):
    html = "<script>x</script><p>a &amp;lt; b&nbsp;c &eacute; &Eacute;</p><style>\nz</style>"
    assert one(spark, html, fn.clean_html) == "a < b c &Eacute;"


def test_source_urls(spark):
    got = lambda u: tuple(one(spark, u, fn.parse_source_url))
    assert got("http://a.example/x?id=wc-12") == ("clueweb_id", "wc-12")
    assert got("http://a.example/x?href=http%253A%252F%252Fb.example%252Fc") == ("source_url", "http://b.example/c")
    assert got("http://a.example/x?q=1&id=2")[0] == "unknown"


def test_span_iou_is_strict_at_the_threshold(spark):
    df = spark.createDataFrame([(0, 10, 5, 15), (0, 10, 10, 20), (0, 10, 0, 10)], "a int, b int, c int, d int")
    assert [round(r[0], 6) for r in df.select(fn.span_iou(*map(F.col, "abcd"))).collect()] == [0.333333, 0.0, 1.0]


def test_repair_json_and_numbers(spark):
    assert one(spark, '{"a": [1, 2, ], }', fn.repair_json) == '{"a": [1, 2]}'
    assert one(spark, "suspicious-document00042-batch3.txt", fn.document_number) == 42
    assert one(spark, "other.txt", fn.document_number) is None


def test_sets_of_ngrams_are_not_shuffled(spark):
    pairs = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q2", "d2"), ("q2", "none")], "qid string, doc_id string")
    asked = spark.createDataFrame([("q1", "abcd"), ("q2", "xy")], "qid string, text string").dropDuplicates(["qid"])
    docs = spark.createDataFrame([("d1", "ABCDE"), ("d2", "zzz")], "doc_id string, text string").dropDuplicates(["doc_id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fn.pair_jaccard(pairs, asked, docs)
        assert {tuple(r) for r in out.collect()} == {("q1", "d1", round(2 / 3, 9)), ("q1", "d2", 0.0), ("q2", "d2", 0.0)}
        # a set of n-grams is an array: none goes through an exchange
        todo, moved = [out._jdf.queryExecution().executedPlan().initialPlan()], []
        while todo:
            node = todo.pop()
            if "Exchange" in node.nodeName():
                moved.append(node.schema().simpleString())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        assert moved and not [x for x in moved if "array" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
