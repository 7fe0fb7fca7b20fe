"""Conversion of collections: ids, source references, statistics, cleaning of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import clean_html, parse_source_url, source_key, stable_id


def collection_ids(files: DataFrame, corpus: str) -> DataFrame:
    """(kind, split, opaque_id, filename) of (kind, split, filename): ids that depend on the name alone."""
    letter = F.when(F.col("kind") == "corpus", stable_id("d", corpus, F.col("split"), F.col("filename"))).otherwise(stable_id("q", corpus, F.col("split"), F.col("filename")))
    return files.select("kind", "split", letter.alias("opaque_id"), "filename")


def source_names(truth: DataFrame) -> DataFrame:
    """(filename, source) pairs, each once, of truth spans (filename, name, source_reference) that name a source."""
    return truth.where("name = 'plagiarism' and source_reference <> ''").select("filename", F.col("source_reference").alias("source")).distinct()


def source_references(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with type, value and source_key of the reference."""
    parsed = urls.withColumn("_p", parse_source_url(F.col(url)))
    return parsed.select(*urls.columns, F.col("_p.type").alias("type"), F.col("_p.value").alias("value"), source_key(F.col("_p.type"), F.col("_p.value")).alias("source_key"))


def register_sources(references: DataFrame, corpus: str) -> DataFrame:
    """(source_key, type, value, source_doc_id): one id for each source key, however many queries cite it."""
    return references.select("source_key", "type", "value").distinct().withColumn("source_doc_id", stable_id("d", corpus, F.lit("source"), F.col("source_key")))


def resolve_missing(missing: DataFrame, pages: DataFrame, min_chars: int = 50) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): missing sources joined with fetched pages (value, html).

    A page is kept if its cleaned text has more than ``min_chars``; the method of fetching goes by the type.
    """
    wanted = missing.select("source_doc_id", "type", "value").distinct()
    method = F.when(F.col("type") == "clueweb_id", "search").when(F.col("type") == "source_url", "direct").otherwise("none")
    joined = wanted.join(pages.select("value", "html"), "value", "left").withColumn("text", clean_html(F.coalesce("html", F.lit("")))).withColumn("method", method)
    good = F.length("text") > min_chars
    error = F.when(F.col("html").isNull(), "not fetched").otherwise("empty body")
    return joined.where(good).select(F.col("source_doc_id").alias("doc_id"), F.col("text").alias("default_text")), joined.where(~good).select("source_doc_id", "type", "value", "method", error.alias("error"))


def collection_statistics(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, missing: DataFrame) -> DataFrame:
    """(statistic, n): documents, queries, judgements, missing sources, and the latter by type."""
    parts = [
        corpus.agg(F.countDistinct("doc_id").alias("n")).select(F.lit("documents").alias("statistic"), "n"),
        queries.agg(F.countDistinct("qid").alias("n")).select(F.lit("queries").alias("statistic"), "n"),
        qrels.select("qid", "doc_id").distinct().agg(F.count("*").alias("n")).select(F.lit("qrels").alias("statistic"), "n"),
        missing.agg(F.countDistinct("source_key").alias("n")).select(F.lit("missing").alias("statistic"), "n"),
        missing.groupBy(F.concat(F.lit("missing_"), "type").alias("statistic")).agg(F.countDistinct("source_key").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def referenced_documents(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(n_cited, n_present, n_absent): cited documents that the corpus has and has not."""
    cited = qrels.select("doc_id").distinct()
    marked = cited.join(corpus.select("doc_id").distinct().withColumn("here", F.lit(1)), "doc_id", "left")
    return marked.agg(F.count("*").alias("n_cited"), F.count("here").alias("n_present"), F.count_if(F.col("here").isNull()).alias("n_absent"))
