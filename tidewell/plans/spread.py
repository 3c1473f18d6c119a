"""Use all cores for work that is heavy per row, where the session asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewell.session import SPREAD_CONF


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over as many tasks as ``SPREAD_CONF`` says, or as it is where that is unset.

    A Parquet row group is read by one task, so a table in one small file would be
    processed by a single core. Tables of many files need no such setting and are not
    shuffled without it, whatever their size. ``key`` must be (nearly) unique; hashing
    it keeps a repeated task deterministic.
    """
    tasks = int(df.sparkSession.conf.get(SPREAD_CONF, "0") or 0)
    return df.repartition(tasks, key) if tasks > 0 and not df.isStreaming else df
