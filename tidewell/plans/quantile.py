"""Exact medians without holding a group in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A sketch errs by at most 1 / ACCURACY of a group; the bracket reaches MARGIN times as far on both sides of the middle.
ACCURACY, MARGIN = 10_000, 4


def around_middle(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, _n, _v, _c``: the distinct values near each group's middle with their counts, and all smaller ones as one row with a null.

    A quantile sketch, merged from all tasks, brackets the middle; what lies outside is only
    counted. So what is ordered is 8 in 10,000 of a group, however its values are spread.
    """
    keys = list(keys)
    reach = MARGIN / ACCURACY
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, [0.5 - reach, 0.5 + reach], ACCURACY).alias("_q"))
    near = rows.join(sketch, keys).where(F.col(value) <= F.col("_q")[1])
    kept = F.when(F.col(value) >= F.col("_q")[0], F.col(value))
    return near.groupBy(*keys, "_n", kept.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group; values that are null do not count."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
    ranked = around_middle(rows, keys, "_value").withColumn("_upto", upto)
    holds = lambda place: F.max(F.when((F.col("_upto") >= place) & (F.col("_upto") - F.col("_c") < place), F.col("_v")))
    return ranked.groupBy(*keys).agg(
        ((holds(F.floor((F.col("_n") + 1) / 2)) + holds(F.floor((F.col("_n") + 2) / 2))) / 2).alias(name))
