"""Top-k per group.

A ``row_number`` filter written directly on the window lets Spark insert a
partial group limit below the shuffle, so at most k rows of a group leave a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank0") -> DataFrame:
    """The first ``k`` rows of each group, with their 0-based rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= F.lit(k))
        .withColumn(rank, F.col("_rn") - 1)
        .drop("_rn")
    )
