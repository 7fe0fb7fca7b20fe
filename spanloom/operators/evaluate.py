"""Retrieval metrics over (qid, doc_id, rel) and (qid, doc_id, score) relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20)


def rerank_by_score(run: DataFrame) -> DataFrame:
    """Ranks by descending score within a query; a stored rank column is ignored. Ties by document id."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return run.select("qid", "doc_id", "score").withColumn("rank", F.row_number().over(w))


def last_judgement(qrels: DataFrame) -> DataFrame:
    """(qid, doc_id, rel), one row a pair; of repeated judgements the highest counts (rows carry no order)."""
    return qrels.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))


def _judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return rerank_by_score(run).join(qrels, ["qid", "doc_id"])


def _exact_mean(df: DataFrame, value, out: str) -> DataFrame:
    return df.agg(F.round(F.avg(value.cast("decimal(20,12)")).cast("double"), 6).alias(out))


def ndcg(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, ndcg): mean over all judged queries; a query without run or without relevant documents gives 0."""
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col(rank) + 1)
    cut = F.explode(F.array(*map(F.lit, ks))).alias("k")
    dcg = _judged(run, qrels).select("qid", "rank", gain("rank").alias("g"), cut).where("rank <= k").groupBy("qid", "k").agg(F.sum("g").alias("dcg"))
    w = W.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    best = qrels.withColumn("at", F.row_number().over(w)).select("qid", "at", gain("at").alias("g"), cut)
    ideal = best.groupBy("qid", "k").agg(F.sum(F.when(F.col("at") <= F.col("k"), F.col("g")).otherwise(0.0)).alias("idcg"))
    joined = ideal.join(dcg, ["qid", "k"], "left")
    value = F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0)
    return joined.groupBy("k").agg(F.round(F.avg(value.cast("decimal(20,12)")).cast("double"), 6).alias("ndcg"))


def recall(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, recall): mean over queries with at least one relevant document."""
    good = qrels.where("rel > 0")
    total = good.groupBy("qid").agg(F.count("*").alias("n"))
    cut = F.explode(F.array(*map(F.lit, ks))).alias("k")
    hits = _judged(run, good).select("qid", "rank", cut).where("rank <= k").groupBy("qid", "k").agg(F.count("*").alias("h"))
    joined = total.select("qid", "n", cut).join(hits, ["qid", "k"], "left")
    value = (F.coalesce("h", F.lit(0)) / F.col("n")).cast("decimal(20,12)")
    return joined.groupBy("k").agg(F.round(F.avg(value).cast("double"), 6).alias("recall"))


def mrr(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(mrr): over all judged queries, to full depth."""
    first = _judged(run, qrels.where("rel > 0")).groupBy("qid").agg(F.min("rank").alias("r"))
    joined = qrels.select("qid").distinct().join(first, "qid", "left")
    return _exact_mean(joined, F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0)), "mrr")


def mean_average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(map): over queries with relevant documents, to full depth, divided by all relevant ones."""
    good = qrels.where("rel > 0")
    total = good.groupBy("qid").agg(F.count("*").alias("n"))
    w = W.partitionBy("qid").orderBy("rank")
    hits = _judged(run, good).withColumn("i", F.row_number().over(w)).groupBy("qid").agg(F.sum((F.col("i") / F.col("rank")).cast("decimal(20,12)")).cast("double").alias("s"))
    joined = total.join(hits, "qid", "left")
    return _exact_mean(joined, F.coalesce("s", F.lit(0.0)) / F.col("n"), "map")


def single_relevant(qrels: DataFrame) -> DataFrame:
    """(qid, doc_id): one relevant document a query; of several the largest id (rows carry no order)."""
    return qrels.where("rel > 0").groupBy("qid").agg(F.max("doc_id").alias("doc_id"))


def single_relevant_metrics(run: DataFrame, qrels: DataFrame, denominator: str = "qrels") -> DataFrame:
    """(n_queries, recall_10, recall_100, ndcg_10, mrr_10) with one relevant document a query (ideal gain 1).

    ``denominator``: all judged queries (``qrels``), or those that the run has too (``both``).
    """
    truth = single_relevant(qrels)
    if denominator == "both":
        truth = truth.join(run.select("qid").distinct(), "qid", "left_semi")
    joined = truth.join(rerank_by_score(run), ["qid", "doc_id"], "left")
    mean = lambda x: F.round(F.avg(x.cast("decimal(20,12)")).cast("double"), 6)
    r = F.col("rank")
    return joined.agg(
        F.count("*").alias("n_queries"),
        mean(F.when(r <= 10, 1.0).otherwise(0.0)).alias("recall_10"),
        mean(F.when(r <= 100, 1.0).otherwise(0.0)).alias("recall_100"),
        mean(F.when(r <= 10, 1 / F.log2(r + 1)).otherwise(0.0)).alias("ndcg_10"),
        mean(F.when(r <= 10, 1 / r).otherwise(0.0)).alias("mrr_10"),
    )


def metric_table(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(metric, k, value): the usual report in long form."""
    parts = [ndcg(run, qrels).selectExpr("'ndcg' metric", "k", "ndcg value"), recall(run, qrels).selectExpr("'recall' metric", "k", "recall value")]
    parts += [mrr(run, qrels).selectExpr("'mrr' metric", "0 k", "mrr value"), mean_average_precision(run, qrels).selectExpr("'map' metric", "0 k", "map value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_delta(run: DataFrame, baseline: DataFrame, qrels: DataFrame) -> DataFrame:
    """(metric, k, value, baseline, delta) of two runs over the same judgements."""
    a, b = metric_table(run, qrels), metric_table(baseline, qrels).withColumnRenamed("value", "baseline")
    return a.join(b, ["metric", "k"]).withColumn("delta", F.round(F.col("value") - F.col("baseline"), 6))


def run_table(runs: dict[str, DataFrame], qrels: DataFrame) -> DataFrame:
    """(metric, k, and one column for each named run) over the same judgements."""
    out = None
    for name, run in runs.items():
        part = metric_table(run, qrels).withColumnRenamed("value", name)
        out = part if out is None else out.join(part, ["metric", "k"])
    return out


def recovered(run: DataFrame, baseline: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries with one relevant document, those that the baseline and the run find in their first ``k``, those
    that only the run (recovered), only the baseline (lost) or either (union) finds, and the share of the union."""
    truth = single_relevant(qrels)
    hit = lambda r, name: rerank_by_score(r).where(F.col("rank") <= k).select("qid", "doc_id", F.lit(1).alias(name))
    joined = truth.join(hit(run, "a"), ["qid", "doc_id"], "left").join(hit(baseline, "b"), ["qid", "doc_id"], "left")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    counts = {"n_baseline": b, "n_run": a, "n_recovered": a & ~b, "n_lost": b & ~a, "n_union": a | b}
    out = joined.agg(F.count("*").alias("n_queries"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    return out.withColumn("union_recall", F.round(F.col("n_union") / F.greatest(F.col("n_queries"), F.lit(1)), 6))


#: Code points of a bin of the corpus-wide span comparison.
BIN = 500


def span_scores_anywhere(truth: DataFrame, found: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(n_truth, n_found, n_hit, precision, recall, f1) where a found span of any document may hit a truth.

    Only whether some found span overlaps counts, so equal spans are one, and spans meet in bins of their places: no cross join.
    """
    from spanloom.functions.text import span_iou

    bins = F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / BIN))).alias("bin")
    places = truth.select("start", "end").distinct().select(F.col("start").alias("ts"), F.col("end").alias("te"), bins)
    others = found.select("start", "end").distinct().select(F.col("start").alias("fs"), F.col("end").alias("fe"), bins)
    met = places.join(others, "bin").where(span_iou(F.col("ts"), F.col("te"), F.col("fs"), F.col("fe")) > threshold).select(F.col("ts").alias("start"), F.col("te").alias("end")).distinct()
    return _span_report(truth, found, truth.join(met, ["start", "end"], "left_semi"))


def span_scores(truth: DataFrame, found: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(n_truth, n_found, n_hit, precision, recall, f1) of spans (qid, start, end).

    A truth is hit if any found span of its document overlaps it by more than ``threshold`` of their union; one found
    span may hit several truths.
    """
    from spanloom.functions.text import span_iou

    t, f = truth.alias("t"), found.alias("f")
    near = span_iou(F.col("t.start"), F.col("t.end"), F.col("f.start"), F.col("f.end")) > threshold
    hits = t.join(f, (F.col("t.qid") == F.col("f.qid")) & (F.col("f.start") < F.col("t.end")) & (F.col("t.start") < F.col("f.end")) & near, "left_semi")
    return _span_report(truth, found, hits)


def _span_report(truth: DataFrame, found: DataFrame, hits: DataFrame) -> DataFrame:
    n_truth, n_found, n_hit = (d.agg(F.count("*").alias("n")).scalar() for d in (truth, found, hits))
    one = truth.sparkSession.range(1).select(n_truth.alias("n_truth"), n_found.alias("n_found"), n_hit.alias("n_hit"))
    p = F.when(F.col("n_found") > 0, F.col("n_hit") / F.col("n_found")).otherwise(0.0)
    r = F.when(F.col("n_truth") > 0, F.col("n_hit") / F.col("n_truth")).otherwise(0.0)
    return one.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(0.001)), 6).alias("f1"))
