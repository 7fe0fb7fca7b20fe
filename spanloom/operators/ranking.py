"""Top-k by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], k: int, by: str = "score", tie: str = "doc_id", out: str = "rank") -> DataFrame:
    """Rows 1..k of each key by descending score, ties by ascending id; partial limits run before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.desc(by), F.col(tie))
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
