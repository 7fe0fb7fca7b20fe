import math

from spanloom.operators import evaluate

RUN = [("q1", "a", 3.0), ("q1", "b", 2.0), ("q1", "c", 1.0), ("q2", "x", 1.0), ("q9", "z", 1.0)]
QRELS = [("q1", "a", 0), ("q1", "b", 2), ("q1", "c", 1), ("q2", "y", 1), ("q3", "w", 0)]


def frames(spark):
    return spark.createDataFrame(RUN, "qid string, doc_id string, score double"), spark.createDataFrame(QRELS, "qid string, doc_id string, rel int")


def test_metrics_on_a_tiny_run(spark):
    run, qrels = frames(spark)
    dcg, idcg = 3 / math.log2(3) + 1 / math.log2(4), 3 / math.log2(2) + 1 / math.log2(3)
    assert {r.k: r.ndcg for r in evaluate.ndcg(run, qrels).collect()}[3] == round(dcg / idcg / 3, 6)
    assert {r.k: r.recall for r in evaluate.recall(run, qrels).collect()} == {1: 0.0, 3: 0.5, 5: 0.5, 10: 0.5, 20: 0.5}
    assert evaluate.mrr(run, qrels).first().mrr == round(0.5 / 3, 6)
    assert evaluate.mean_average_precision(run, qrels).first().map == round((1 / 2 + 2 / 3) / 2 / 2, 6)


def test_single_relevant_denominators(spark):
    run, qrels = frames(spark)
    assert evaluate.single_relevant_metrics(run, qrels).first().n_queries == 2
    assert evaluate.single_relevant_metrics(run.where("qid = 'q1'"), qrels, "both").first().n_queries == 1


def test_repeated_judgements_are_one(spark):
    assert evaluate.last_judgement(spark.createDataFrame(QRELS + QRELS, "qid string, doc_id string, rel int")).count() == len(QRELS)


def test_span_scores(spark):
    spans = lambda rows: spark.createDataFrame(rows, "qid string, start int, end int")
    got = evaluate.span_scores(spans([("q", 0, 10), ("q", 50, 60), ("r", 0, 10)]), spans([("q", 0, 9), ("q", 100, 110)])).first()
    assert (got.n_truth, got.n_found, got.n_hit, got.precision, got.recall) == (3, 2, 1, 0.5, 0.333333)
    empty = evaluate.span_scores(spans([]), spans([])).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_span_scores_anywhere_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    make = lambda n: [(f"q{rng.randint(0, 5)}", a, a + rng.randint(1, 1500)) for a in (rng.randint(0, 4000) for _ in range(n))]
    truth, found = make(40), make(25)
    iou = lambda a, b: max(0, min(a[2], b[2]) - max(a[1], b[1])) / ((a[2] - a[1]) + (b[2] - b[1]) - max(0, min(a[2], b[2]) - max(a[1], b[1])))
    want = sum(any(iou(t, f) > 0.3 for f in found) for t in truth)
    frame = lambda rows: spark.createDataFrame(rows, "qid string, start int, end int")
    assert evaluate.span_scores_anywhere(frame(truth), frame(found)).first().n_hit == want


def test_recovered_hits(spark):
    run = lambda rows: spark.createDataFrame(rows, "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("c", "z", 2), ("d", "w", 0)], "qid string, doc_id string, rel int")
    got = evaluate.recovered(run([("a", "x", 2.0), ("b", "q", 1.0)]), run([("b", "y", 1.0)]), qrels).first()
    assert (got.n_queries, got.n_baseline, got.n_run, got.n_recovered, got.n_lost, got.n_union) == (3, 1, 1, 1, 1, 2)
