"""Writers: TREC runs and judgements, JSON lines, tab-separated tables, span XML, caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.readers import path_exists


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    """(value): ``qid Q0 doc_id rank score tag`` with six decimals, by query and rank."""
    line = F.format_string("%s Q0 %s %d %.6f %s", "qid", "doc_id", "rank", "score", F.lit(tag))
    return run.select("qid", "rank", line.alias("value"))


def write_run(run: DataFrame, path: str, tag: str, mode: str = "errorifexists") -> None:
    """TREC run; a range partitioning by query keeps the files in order without one task sorting all."""
    run_lines(run, tag).repartitionByRange("qid").sortWithinPartitions("qid", "rank").select("value").write.mode(mode).text(path)


def qrels_lines(qrels: DataFrame) -> DataFrame:
    """(value): ``qid 0 doc_id rel``."""
    return qrels.select("qid", F.format_string("%s 0 %s %d", "qid", "doc_id", "rel").alias("value"))


def write_qrels(qrels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    qrels_lines(qrels).select("value").write.mode(mode).text(path)


def write_jsonl(df: DataFrame, path: str, compressed: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines with text as it is; ``compressed`` writes gzip."""
    writer = df.write.mode(mode)
    (writer.option("compression", "gzip") if compressed else writer).json(path)


def write_candidates(lists: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_jsonl(lists.select("qid", "query_text", "candidates"), path, mode=mode)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True)


def write_detections(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Span XML: one ``document`` element a query with its detected passages as ``feature`` elements."""
    feature = F.struct(
        F.lit("detected-plagiarism").alias("_name"),
        F.col("susp_start").alias("_this_offset"),
        (F.col("susp_end") - F.col("susp_start")).alias("_this_length"),
        F.col("src").alias("_source_reference"),
        F.col("src_start").alias("_source_offset"),
        (F.col("src_end") - F.col("src_start")).alias("_source_length"),
    )
    rows = blocks.groupBy(F.col("qid").alias("_reference")).agg(F.array_sort(F.collect_list(feature)).alias("feature"))
    rows.write.mode(mode).format("xml").option("rootTag", "documents").option("rowTag", "document").save(path)


def write_cache(df: DataFrame, folder: str, fingerprint: str, mode: str = "overwrite") -> str:
    """Parquet under a folder named by what made it (model and corpus), so that a stale cache is never read."""
    path = f"{folder}/{fingerprint}"
    df.write.mode(mode).parquet(path)
    return path


def read_cache(spark: SparkSession, folder: str, fingerprint: str) -> DataFrame | None:
    """What ``write_cache`` left for this fingerprint, if it was finished."""
    path = f"{folder}/{fingerprint}"
    return spark.read.parquet(path) if path_exists(spark, f"{path}/_SUCCESS") else None


def cached(spark: SparkSession, folder: str, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The cached table, made and written first where there is none."""
    found = read_cache(spark, folder, fingerprint)
    if found is None:
        write_cache(make(), folder, fingerprint)
        found = read_cache(spark, folder, fingerprint)
    return found
