"""Queries of the retrieval and alignment operators over the driver tables; each takes (spark, sf_dir).

All run over whole tables. Vector queries are the rows of ``embeddings`` (and document queries the rows of ``documents``)
whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as fn
from spanloom.operators import align, convert, dense, evaluate, fuse, index, retrieve, rewrite, segment
from spanloom.operators.ranking import ranked
from spanloom.plans import oracles
from spanloom.sources import sinks
from spanloom.sources.readers import table_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_records(spark, sf_dir, "corpus", "doc_id")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_records(spark, sf_dir, "queries", "qid")


def run_of(spark: SparkSession, sf_dir: str, tag: str | None = None) -> DataFrame:
    """(qid, doc_id, score) of the stored run, the best score of a pair."""
    run = table(spark, sf_dir, "run")
    run = run.where(F.col("tag") == tag) if tag else run
    return run.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.last_judgement(table(spark, sf_dir, "qrels"))


def corpus_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return index.build_index(corpus(spark, sf_dir))


# Text functions


@query
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = corpus(spark, sf_dir).select("doc_id", fn.tokens(F.col("text")).alias("t"))
    return tok.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def token_set_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.size(fn.token_set(F.col("text"))).cast("bigint").alias("n_terms"))


@query
def char_trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.pair_jaccard(run_of(spark, sf_dir).select("qid", "doc_id"), asked(spark, sf_dir), corpus(spark, sf_dir))


@query
def clean_html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id", fn.clean_html(F.coalesce("text", F.lit(""))).alias("t"))
    return out.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query
def parse_source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "missing_sources").select("value", "type").distinct()
    wrapped = urls.withColumn("url", F.when(F.col("type") == "clueweb_id", F.concat(F.lit("http://archive.example/page?id="), "value")).otherwise(F.concat(F.lit("http://archive.example/go?href="), F.url_encode(F.url_encode("value")))))
    return convert.source_references(wrapped.select("url")).select("url", "type", "value", "source_key")


@query
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = asked(spark, sf_dir).select(F.lit("query").alias("kind"), F.lit("train").alias("split"), F.concat("qid", F.lit(".txt")).alias("filename"))
    files = files.unionByName(corpus(spark, sf_dir).select(F.lit("corpus").alias("kind"), F.lit("train").alias("split"), F.concat("doc_id", F.lit(".txt")).alias("filename")))
    return convert.collection_ids(files, "books")


@query
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = table(spark, sf_dir, "events").select("event_id", F.replace("props", F.lit("}"), F.lit(", }")).alias("props"))
    parsed = loose.select("event_id", F.from_json(fn.repair_json(F.col("props")), "k int").alias("j"))
    return parsed.select("event_id", F.col("j.k").cast("bigint").alias("k"))


@query
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.format_string("suspicious-document%05d-batch%d.txt", "doc_id", F.col("doc_id") % 7).alias("name"))
    return d.select("doc_id", fn.document_number(F.col("name")).cast("bigint").alias("number"))


# Segmenters


def _chunk_rows(df: DataFrame, segments: Column) -> DataFrame:
    rows = segment.segment_rows(df, segments)
    return rows.select("qid", F.col("n_chunks").cast("bigint").alias("n_chunks"), F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("chunk").cast("bigint").alias("n"), F.md5("chunk").alias("digest"))


@query
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(asked(spark, sf_dir), segment.pack_paragraphs(F.col("text")))


@query
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(asked(spark, sf_dir), segment.pack_paragraphs(F.col("text"), min_chars=500))


@query
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(asked(spark, sf_dir), segment.fixed_windows(F.col("text")))


@query
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(asked(spark, sf_dir), segment.token_windows(F.col("text")))


@query
def semantic_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(asked(spark, sf_dir), segment.sections(F.col("text")))


@query
def length_gated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(asked(spark, sf_dir), segment.length_gated(F.col("text"), 6000))


@query
def length_gated_20000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(asked(spark, sf_dir), segment.length_gated(F.col("text")))


def _span_rows(df: DataFrame, breaks: str) -> DataFrame:
    spans = df.select("doc_id", F.posexplode(segment.sentence_spans(F.col("text"), breaks)).alias("no", "s"))
    return spans.select("doc_id", F.col("no").cast("bigint").alias("no"), F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), F.md5("s.text").alias("digest"))


@query
def sentence_spans_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(corpus(spark, sf_dir), segment.SENTENCE_BREAK_V1)


@query
def sentence_spans_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(corpus(spark, sf_dir), segment.SENTENCE_BREAK_V2)


@query
def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = corpus(spark, sf_dir).select("doc_id", F.posexplode(segment.paragraph_spans(F.col("text"))).alias("no", "s"))
    return spans.select("doc_id", F.col("no").cast("bigint").alias("no"), F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"))


# Index


@query
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = index.collection_stats(index.document_lengths(corpus(spark, sf_dir)))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_index(spark, sf_dir).postings.select("doc_id", "term", "tf", F.col("dl").cast("bigint").alias("dl"))


@query
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_index(spark, sf_dir).terms.select("term", "df")


@query
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_index(spark, sf_dir).terms.select("term", F.round("idf", 9).alias("idf"))


@query
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_summary(corpus_index(spark, sf_dir))


@query
def prune_df_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.prune_by_ratio(corpus_index(spark, sf_dir)).select("term", "df")


@query
def prune_max_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.prune_by_df(corpus_index(spark, sf_dir), 500).select("term", "df")


@query
def prune_max_df_5000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.prune_by_df(corpus_index(spark, sf_dir)).select("term", "df")


@query
def posting_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = corpus_index(spark, sf_dir)
    return index.weighted_postings(ix, ix.terms).select("term", "doc_id", F.round(F.col("w") * index.UNIT, 6).alias("w"))


# Retrieval


def _run_columns(df: DataFrame) -> DataFrame:
    return df.select("qid", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def query_top_idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = corpus_index(spark, sf_dir)
    terms = retrieve.query_terms(asked(spark, sf_dir), ix.terms, ["qid"], False, 100)
    return terms.select("qid", "term", "df", F.col("term_rank").cast("bigint").alias("term_rank"))


@query
def bm25_set_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_columns(retrieve.bm25_search(asked(spark, sf_dir), corpus_index(spark, sf_dir), retrieve.CONFIGS["indexed"]))


@query
def bm25_bag_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_columns(retrieve.bm25_search(asked(spark, sf_dir), corpus_index(spark, sf_dir), retrieve.CONFIGS["baseline"]))


@query
def bm25_top100_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries_ = corpus(spark, sf_dir), asked(spark, sf_dir)
    run = retrieve.bm25_search(queries_, index.build_index(docs), retrieve.CONFIGS["top100"])
    lists = retrieve.candidate_lists(run, docs, queries_)
    return lists.selectExpr("qid", "length(query_text) query_chars", "posexplode(candidates) as (no, c)").selectExpr(
        "qid", "cast(query_chars as bigint) query_chars", "cast(no as bigint) no", "c.doc_id doc_id", "c.bm25_score bm25_score", "md5(c.text) digest"
    )


def _segmented(spark: SparkSession, sf_dir: str, name: str, vote: str, segments=segment.pack_paragraphs) -> DataFrame:
    return _run_columns(retrieve.segmented_search(asked(spark, sf_dir), corpus_index(spark, sf_dir), retrieve.CONFIGS[name], segments, vote))


def _gated(text: Column) -> Column:
    return segment.length_gated(text)


@query
def bm25_export100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_columns(retrieve.bm25_search(asked(spark, sf_dir), corpus_index(spark, sf_dir), retrieve.CONFIGS["export100"]))


@query
def bm25_segment_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "segment_full", "coverage", _gated)


@query
def bm25_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "compare", "coverage")


@query
def bm25_segment_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "segment_eval", "rrf")


@query
def own_run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmented search against whole-text search, both by this engine, over the judgements."""
    docs, queries_ = corpus_index(spark, sf_dir), asked(spark, sf_dir)
    whole = retrieve.bm25_search(queries_, docs, retrieve.CONFIGS["indexed"]).select("qid", "doc_id", "score")
    parts = retrieve.segmented_search(queries_, docs, retrieve.CONFIGS["submit"], segment.pack_paragraphs).select("qid", "doc_id", "score")
    return evaluate.run_delta(parts, whole, judgements(spark, sf_dir))


@query
def bm25_segmented_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "submit", "coverage")


@query
def bm25_segmented_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "segment", "rrf")


@query
def bm25_segmented_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "segment", "max", lambda t: segment.fixed_windows(t, at_most=0))


@query
def decompose_max_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "decompose", "max_rr", lambda t: segment.pack_paragraphs(t, min_chars=500))


# Dense retrieval and fusion


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("grp"), "embedding")


@query
def dense_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_columns(dense.dense_search(*_vectors(spark, sf_dir)))


@query
def dense_chunk_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dense.chunk_max_pool(*_vectors(spark, sf_dir))
    return _run_columns(out.withColumn("doc_id", F.col("doc_id").cast("bigint")))


@query
def dense_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dense.chunk_composite(*_vectors(spark, sf_dir))
    return _run_columns(out.withColumn("doc_id", F.col("doc_id").cast("bigint")))


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "text"), d


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queries, documents, query vectors, document vectors) of one population of texts."""
    queries_, docs = _documents(spark, sf_dir)
    vectors = lambda df, key, prefix: dense.encode(df, prefix=prefix).select(key, "embedding")
    return queries_, docs, vectors(queries_, "qid", "query: "), vectors(docs, "doc_id", "passage: ")


@query
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries_, docs, q, d = _encoded(spark, sf_dir)
    sparse = retrieve.bm25_search(queries_, index.build_index(docs), retrieve.CONFIGS["top100"])
    return _run_columns(fuse.fuse_rrf(sparse, dense.dense_search(q, d, top_k=100)))


@query
def dense_jaccard_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries_, docs, q, d = _encoded(spark, sf_dir)
    return _run_columns(dense.rerank_dense_jaccard(dense.dense_search(q, d, top_k=100), q, d, queries_, docs))


@query
def dense_window_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries_, docs, q, _ = _encoded(spark, sf_dir)
    return _run_columns(dense.chunk_max_pool(q, dense.windowed_vectors(docs)))


@query
def pair_scorer_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    run = run_of(spark, sf_dir).join(asked(spark, sf_dir).withColumnRenamed("text", "query_text"), "qid").join(docs, "doc_id")
    return _run_columns(dense.rerank_pairs(run))


@query
def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.encode(corpus(spark, sf_dir), prefix="passage: ").select("doc_id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(F.array_max("embedding"), 6).alias("most"))


# Filters, joins, overrides


@query
def blind_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = evaluate.single_relevant(judgements(spark, sf_dir))
    top = evaluate.rerank_by_score(run_of(spark, sf_dir)).where("rank <= 10")
    return truth.join(top, ["qid", "doc_id"], "left_anti")


@query
def needed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = run_of(spark, sf_dir).select("doc_id").distinct()
    return corpus(spark, sf_dir).join(needed, "doc_id", "left_semi").select("doc_id", F.length("text").cast("bigint").alias("n"))


@query
def override_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = lambda tag: _run_columns(evaluate.rerank_by_score(run_of(spark, sf_dir, tag)))
    return fuse.override(ranks("seg"), ranks("bm25"))


# Evaluation


@query
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ndcg(run_of(spark, sf_dir), judgements(spark, sf_dir))


@query
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(run_of(spark, sf_dir), judgements(spark, sf_dir))


@query
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mrr(run_of(spark, sf_dir), judgements(spark, sf_dir))


@query
def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mean_average_precision(run_of(spark, sf_dir), judgements(spark, sf_dir))


@query
def single_rel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.single_relevant_metrics(run_of(spark, sf_dir), judgements(spark, sf_dir))


@query
def single_rel_metrics_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.single_relevant_metrics(run_of(spark, sf_dir, "seg"), judgements(spark, sf_dir), "both")


@query
def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.run_delta(run_of(spark, sf_dir, "seg"), run_of(spark, sf_dir, "bm25"), judgements(spark, sf_dir))


@query
def three_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = {"seg": run_of(spark, sf_dir, "seg"), "bm25": run_of(spark, sf_dir, "bm25"), "both": run_of(spark, sf_dir)}
    return evaluate.run_table(tags, judgements(spark, sf_dir))


@query
def recovered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recovered(run_of(spark, sf_dir, "seg"), run_of(spark, sf_dir, "bm25"), judgements(spark, sf_dir))


@query
def union_recall_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.recovered(run_of(spark, sf_dir, "seg"), run_of(spark, sf_dir, "bm25"), judgements(spark, sf_dir), 100)
    return out.select("n_queries", "n_union", "union_recall")


@query
def targeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind queries against the windows of their relevant documents."""
    pairs = blind_queries(spark, sf_dir)
    docs = corpus(spark, sf_dir).join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    vectors = dense.encode(asked(spark, sf_dir).join(pairs.select("qid"), "qid", "left_semi"), prefix="query: ")
    return dense.targeted_windows(pairs, vectors, dense.windowed_vectors(docs))


# Alignment


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, src): every query with each source that the run has for it."""
    return run_of(spark, sf_dir).select("qid", F.col("doc_id").alias("src"))


@query
def align_marked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.marked_pairs(_pairs(spark, sf_dir), asked(spark, sf_dir), corpus(spark, sf_dir))
    return out.select("qid", "src", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.round("score", 6).alias("score"))


@query
def align_blocks_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_pairs(_pairs(spark, sf_dir), asked(spark, sf_dir), corpus(spark, sf_dir), align.V2)


@query
def align_blocks_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_pairs(_pairs(spark, sf_dir), asked(spark, sf_dir), corpus(spark, sf_dir), align.V1)


@query
def align_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best document of BM25 for each query, and the blocks that it shares with it."""
    docs, queries_ = corpus(spark, sf_dir), asked(spark, sf_dir)
    run = retrieve.bm25_search(queries_, index.build_index(docs), retrieve.CONFIGS["indexed"])
    return align.retrieve_and_align(run, queries_, docs)


def _windows(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("n_chars >= 400").select(F.col("doc_id").alias("qid"), "n_chars")
    at = (F.col("qid") * 37) % (F.col("n_chars") - 300)
    return d.select("qid", (at + shift * (F.col("qid") % 5)).alias("start"), (at + shift * (F.col("qid") % 5) + 200).alias("end"))


@query
def span_iou_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = _windows(spark, sf_dir, 0), _windows(spark, sf_dir, 25).select("qid", F.col("start").alias("s"), F.col("end").alias("e"))
    iou = fn.span_iou(F.col("start"), F.col("end"), F.col("s"), F.col("e"))
    return t.join(f, "qid").select("qid", F.round(iou, 9).alias("iou")).where("iou > 0.3")


@query
def alignment_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.span_scores(_windows(spark, sf_dir, 0), _windows(spark, sf_dir, 45))


@query
def alignment_prf_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.span_scores_anywhere(_windows(spark, sf_dir, 0), _windows(spark, sf_dir, 45))


# Rewriting


def _rewritten(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    out = rewrite.rewrite(asked(spark, sf_dir), strategy)
    return out.select("qid", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query
def rewrite_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, "truncate")


@query
def rewrite_tfidf_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, "tfidf_sentences")


@query
def rewrite_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, "structured")


@query
def rewrite_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, "keywords")


# Conversion and sinks


@query
def collection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.collection_statistics(corpus(spark, sf_dir), asked(spark, sf_dir), table(spark, sf_dir, "qrels"), table(spark, sf_dir, "missing_sources"))


@query
def referenced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.referenced_documents(table(spark, sf_dir, "qrels"), corpus(spark, sf_dir))


@query
def registered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.register_sources(table(spark, sf_dir, "missing_sources"), "pages")


@query
def resolved_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = table(spark, sf_dir, "missing_sources")
    failed = table(spark, sf_dir, "fetch_errors").select("source_doc_id").distinct()
    pages = missing.join(failed, "source_doc_id", "left_anti").join(corpus(spark, sf_dir).withColumnRenamed("doc_id", "source_doc_id"), "source_doc_id")
    docs, errors = convert.resolve_missing(missing, pages.select("value", F.col("text").alias("html")).dropDuplicates(["value"]))
    good = docs.select(F.col("doc_id").alias("source_doc_id"), F.lit("ok").alias("state"), F.length("default_text").cast("bigint").alias("n"))
    return good.unionByName(errors.select("source_doc_id", F.col("error").alias("state"), F.lit(0).cast("bigint").alias("n")))


@query
def trec_run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.run_lines(evaluate.rerank_by_score(run_of(spark, sf_dir)), "bm25").select("value")


@query
def trec_qrels_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.qrels_lines(judgements(spark, sf_dir)).select("value")


@query
def run_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_columns(ranked(run_of(spark, sf_dir), ["qid"], 2))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in QUERIES}
