"""Inverted index as relations: postings, terms and collection statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import bm25_weight, idf, tokens


#: Weights of terms are counted in this unit.
UNIT = 1e-12


@dataclass
class Index:
    """postings(term, doc_id, tf, dl), terms(term, df, idf), stats(n_docs, avgdl); ``lengths`` is (doc_id, dl), ``words``
    (doc_id, dl, words) with the tokens of a document in order, parted by single blanks."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    lengths: DataFrame
    words: DataFrame


def document_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl): token counts; documents without tokens count with 0."""
    return docs.select("doc_id", F.size(tokens(F.col("text"))).alias("dl"))


def collection_stats(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl) over all documents; the mean length of no documents is 1."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def scalar(stats: DataFrame, name: str) -> Column:
    """A value of the one-row statistics as a scalar subquery: no join, no action."""
    return stats.select(name).scalar()


def build_index(docs: DataFrame) -> Index:
    """Index of (doc_id, text), one row a document. Documents are counted by term without postings, which are made only
    where they are asked for."""
    lengths = document_lengths(docs)
    stats = collection_stats(lengths)
    tok = docs.select("doc_id", tokens(F.col("text")).alias("tok"))
    tf = tok.select("doc_id", F.size("tok").alias("dl"), F.explode("tok").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tok.select(F.explode(F.array_distinct("tok")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = df.withColumn("idf", idf(F.col("df"), scalar(stats, "n_docs")))
    words = tok.select("doc_id", F.size("tok").alias("dl"), F.array_join("tok", " ").alias("words"))
    return Index(tf.select("term", "doc_id", "tf", "dl"), terms, stats, lengths, words)


def prune_by_ratio(index: Index, ratio: float = 0.3) -> DataFrame:
    """Terms in at most ``floor(n_docs * ratio)`` documents."""
    return index.terms.where(F.col("df") <= F.floor(scalar(index.stats, "n_docs") * F.lit(ratio)))


def prune_by_df(index: Index, max_df: int = 5000) -> DataFrame:
    """Terms in at most ``max_df`` documents."""
    return index.terms.where(F.col("df") <= max_df)


def weighted_postings(index: Index, terms: DataFrame) -> DataFrame:
    """(term, doc_id, w) of the kept terms: the part of a score that a term gives a document, made once.

    ``w`` is a whole number of ``UNIT``: sums of it are exact and don't depend on their order, and stay primitive longs.
    """
    joined = index.postings.join(terms, "term")
    w = bm25_weight(F.col("tf"), F.col("dl"), scalar(index.stats, "avgdl"), F.col("idf"))
    return joined.select("term", "doc_id", F.floor(w / UNIT + 0.5).alias("w"))


def index_summary(index: Index, ratio: float = 0.3) -> DataFrame:
    """One row: documents, terms, mean length, postings, and terms that the ratio prune keeps and drops."""
    limit = F.floor(scalar(index.stats, "n_docs") * F.lit(ratio))
    return index.terms.agg(
        F.count("*").alias("n_terms"),
        F.sum("df").alias("n_postings"),
        F.count_if(F.col("df") <= limit).alias("kept_terms"),
        F.count_if(F.col("df") > limit).alias("pruned_terms"),
    ).select(scalar(index.stats, "n_docs").alias("n_docs"), F.round(scalar(index.stats, "avgdl"), 6).alias("avgdl"), "n_terms", "n_postings", "kept_terms", "pruned_terms")
