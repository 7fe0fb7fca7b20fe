"""Queries of the training-data operators; each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, bpe, nearcopies, packing, residue, sentences, sharedspans, splitting, truncation
from .common import corpus_records, query_records


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no): lines of corpus texts that do not belong to the article."""
    found = boilerplate.furniture(corpus_records(spark, sf_dir, "site"), residue.evidence, residue.judge)
    return found.select(F.col("id").alias("doc_id"), "line_no")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, start_char, end_char): sentence units of all records of corpus and queries."""
    return sentences.sentence_units(corpus_records(spark, sf_dir).unionByName(query_records(spark, sf_dir)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): corpus records with residue in the place of content."""
    return residue.residue_records(corpus_records(spark, sf_dir, "site")).select(F.col("id").alias("doc_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of corpus records of at least 400 code points with similarity above 0.6."""
    return nearcopies.record_pairs(corpus_records(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, start_char, end_char): stretches of 300 code points and more that stand in another record too."""
    return sharedspans.shared_spans(corpus_records(spark, sf_dir).unionByName(query_records(spark, sf_dir)))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, n_chars, shared_chars, share): for each record how much of its text stands elsewhere."""
    return sharedspans.shared_shares(corpus_records(spark, sf_dir).unionByName(query_records(spark, sf_dir)))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, piece_no, start_char, end_char): all query texts in pieces of at most 3,000 code points, 200 shared."""
    return splitting.split_records(query_records(spark, sf_dir)).withColumnRenamed("id", "qid")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid): records of queries that had to be cut."""
    return p6_pieces(spark, sf_dir).where("piece_no = 1").select("qid")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): every document encoded by byte_bpe_50k."""
    return bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_id, doc_id, part, start_token, n_tokens): documents in containers of 2,048 tokens."""
    sizes = bpe.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"))
    packed = packing.pack(sizes, 2048)
    return packed.select(F.col("container").alias("container_id"), F.col("item").alias("doc_id"), "part", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents whose text breaks off inside a word, a sentence or markup."""
    return truncation.cut_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_docs, n_cut, share): how often each source truncates."""
    return truncation.cut_shares(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p5_shares, p6_found, p6_pieces, p7_ids, p8_containers, p9_found, p9_shares)}


def oracle_sql() -> dict[str, str]:
    return {}
