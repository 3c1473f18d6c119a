"""Registry of named queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


_MADE: dict[tuple, str] = {}


def once(t: Tables, name: str, tables: list[str], make: Callable[[], str]) -> str:
    """Where something stored lies that ``make`` makes of some tables: made once for an application and the files as they are."""
    state = []
    for table in tables:
        files = getattr(t, table).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        state.append(files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0])
    key = (t.spark.sparkContext.applicationId, t.folder, name, *state)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add
