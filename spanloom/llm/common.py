"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def first_filled(*names: str) -> Column:
    """First of the columns that is neither null nor empty, else null."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def corpus_records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(id, text, and the columns ``more``) of ``corpus`` by the effective-id rule; repeated deliveries are kept."""
    df = spark.read.parquet(f"{sf_dir}/corpus.parquet")
    return df.select(first_filled("doc_id", "qid").alias("id"), first_filled("default_text", "query").alias("text"), *more)


def query_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of ``queries`` by the effective-id rule; repeated rows are kept."""
    df = spark.read.parquet(f"{sf_dir}/queries.parquet")
    return df.select(first_filled("qid", "query_id").alias("id"), first_filled("query", "default_text").alias("text"))


def text_batches(batches: Iterator[pa.RecordBatch], max_chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches so that one piece holds about ``max_chars`` bytes of its column ``text``.

    A single longer text makes a piece of its own. Yields the piece and its texts as Python strings (None for null).
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if size and size + n > max_chars:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += n
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def map_arrow(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with small names; ``make`` takes and yields record batches."""
    return df.mapInArrow(make, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    The folder comes from the session; only where it is unset (tests, a laptop) a local one is chosen.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


#: So many keys (8 bytes each) are sent to all executors; beyond it both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def only_with(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``keys``. The keys are counted: few enough go to every executor."""
    keys = checkpointed(keys.select(on).distinct())
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi")
