"""Merges on natural keys as map-side combined aggregates.

No window over the key is used: a key with very many versions is reduced by the
partial aggregate of every task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(value: Column | str, order: Column) -> Column:
    """Value of the first row by ``order``."""
    return F.min_by(value, order)


def last_by(value: Column | str, order: Column) -> Column:
    """Value of the last row by ``order``."""
    return F.max_by(value, order)


def last_known(value: Column | str, order: Column) -> Column:
    """Last non-null value by ``order`` (plain ``max_by`` may return a null)."""
    col = F.col(value) if isinstance(value, str) else value
    return F.max_by(col, F.when(col.isNotNull(), order))


def first_known(value: Column | str, order: Column) -> Column:
    """First non-null value by ``order``."""
    col = F.col(value) if isinstance(value, str) else value
    return F.min_by(col, F.when(col.isNotNull(), order))


def _whole_row(df: DataFrame, keys: Sequence[str], pick, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), order).alias("_row"))
        .select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])
    )


def last_write_wins(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the row with the greatest ``order``."""
    return _whole_row(df, keys, F.max_by, order)


def first_write_wins(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the row with the least ``order``."""
    return _whole_row(df, keys, F.min_by, order)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Existing rows replaced by the last incoming row of the same key.

    Both sides have the same columns; ``seq`` orders the incoming rows.
    """
    both = existing.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    return last_write_wins(both, keys, F.struct("_src", seq)).drop("_src")


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Existing rows plus the first incoming row of every unknown key."""
    fresh = first_write_wins(incoming, keys, F.struct(seq)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh)
