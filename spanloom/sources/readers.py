"""Readers: JSON lines, TREC files, tables of ids, truth XML, text directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import first_filled, repair_json

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "qid", "query_id", "default_text", "query")])
CANDIDATES = "qid string, query_text string, candidates array<struct<doc_id:string,bm25_score:double,text:string>>"
#: Fallback chains of the known layouts: where ids and texts are looked for, in order.
CHAINS = {
    "corpus": (("doc_id", "qid"), ("default_text", "query")),
    "corpus_strict": (("doc_id", "qid"), ("default_text",)),
    "queries": (("qid", "query_id"), ("query", "default_text")),
    "queries_strict": (("qid", "query_id"), ("query",)),
    "any": (("doc_id", "qid", "query_id"), ("default_text", "query")),
}


def choose_fields(raw: DataFrame, chain: str, id_name: str = "doc_id") -> DataFrame:
    """(id, text): first filled field of each chain; a missing text is empty."""
    ids, texts = CHAINS[chain]
    return raw.select(first_filled(*ids).alias(id_name), F.coalesce(first_filled(*texts), F.lit("")).alias("text"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, chain: str = "corpus", id_name: str = "doc_id") -> DataFrame:
    """JSON lines, plain or compressed by extension; blank lines are skipped.

    A missing plain file gives way to the one with ``.gz``. Compressed files can't be split: what was read is spread again
    before anything heavy.
    """
    if not path_exists(spark, path) and path_exists(spark, f"{path}.gz"):
        path = f"{path}.gz"
    df = choose_fields(spark.read.schema(RECORD).json(path), chain, id_name)
    return df.repartition(spark.sparkContext.defaultParallelism) if str(path).endswith(".gz") else df


def one_per_id(df: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """One row an id; rows of one id carry the same text."""
    return df.where(F.col(id_name).isNotNull()).dropDuplicates([id_name])


def table_records(spark: SparkSession, sf_dir: str, name: str, id_name: str) -> DataFrame:
    """(id, text) of the Parquet tables ``corpus`` and ``queries``, one row a record."""
    raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for c in RECORD.names:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return one_per_id(choose_fields(raw, name, id_name), id_name)


def _fields(spark: SparkSession, path: str, at_least: int) -> DataFrame:
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    return lines.select("line", F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= at_least)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rank, score, tag, line) of a TREC run; shorter lines are dropped."""
    f = lambda i: F.col("f")[i]
    return _fields(spark, path, 6).select(f(0).alias("qid"), f(2).alias("doc_id"), f(3).cast("int").alias("rank"), f(4).cast("double").alias("score"), f(5).alias("tag"), "line")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of TREC judgements; of repeated ones the last counts."""
    f = lambda i: F.col("f")[i]
    rows = _fields(spark, path, 4).select(f(0).alias("qid"), f(2).alias("doc_id"), f(3).cast("int").alias("rel"), "line")
    return rows.groupBy("qid", "doc_id").agg(F.max_by("rel", "line").alias("rel"))


def last_relevant(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id): the relevant document that stands last for each query."""
    f = lambda i: F.col("f")[i]
    rows = _fields(spark, path, 4).select(f(0).alias("qid"), f(2).alias("doc_id"), f(3).cast("int").alias("rel"), "line")
    return rows.where("rel > 0").groupBy("qid").agg(F.max_by("doc_id", "line").alias("doc_id"))


def first_in_file(run: DataFrame, k: int) -> DataFrame:
    """The first ``k`` lines of each query, in file order."""
    w = W.partitionBy("qid").orderBy("line")
    return run.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query_text, doc_id, bm25_score, text): one row a candidate."""
    return spark.read.schema(CANDIDATES).json(path).selectExpr("qid", "query_text", "inline(candidates)")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated table with a header (id mappings, missing sources, fetch errors)."""
    return spark.read.csv(path, sep="\t", header=True)


TRUTH = T.StructType(
    [
        T.StructField("_reference", T.StringType()),
        T.StructField(
            "feature",
            T.ArrayType(
                T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("name", "source_reference", "this_offset", "this_length", "source_offset", "source_length", "obfuscation")])
            ),
        ),
    ]
)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(filename, name, source_reference, start, end, src_start, src_end, obfuscation) of truth XML, all features."""
    raw = spark.read.format("xml").option("rowTag", "document").schema(TRUTH).load(path)
    x = raw.select(F.col("_reference").alias("filename"), F.explode("feature").alias("f"))
    number = lambda n: F.coalesce(F.col(f"f._{n}").try_cast("int"), F.lit(0))
    return x.select(
        "filename",
        F.col("f._name").alias("name"),
        F.col("f._source_reference").alias("source_reference"),
        number("this_offset").alias("start"),
        (number("this_offset") + number("this_length")).alias("end"),
        number("source_offset").alias("src_start"),
        (number("source_offset") + number("source_length")).alias("src_end"),
        F.col("f._obfuscation").alias("obfuscation"),
    )


def truth_spans(truth: DataFrame) -> DataFrame:
    """Only the copied passages."""
    return truth.where("name = 'plagiarism'")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text): one row a file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))


def read_loose_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON object each, trailing commas allowed; those beyond repair are left out."""
    parsed = read_text_files(spark, path).select("filename", F.from_json(repair_json(F.col("text")), schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return parsed.where("j is not null and j._bad is null").select("filename", "j.*").drop("_bad")


def first_n(df: DataFrame, n: int, by: str) -> DataFrame:
    """The first ``n`` rows by a column (0: all); a scan cap for experiments, never used by the queries."""
    return df.orderBy(by).limit(n) if n else df
