"""Tables that grow by numbered changes: each change adds a folder to each of them, and counts once it is committed.

A change that is begun again replaces what it had written; one that is committed is not applied
twice. Only changed rows are written, and readers see committed changes only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans import snapshots


@dataclass(frozen=True)
class Segments:
    spark: SparkSession
    root: str

    def versions(self) -> list[int]:
        """Numbers of the committed changes, in order."""
        return sorted(snapshots.complete_versions(self.spark, f"{self.root}/commits"))

    def write(self, df: DataFrame, table: str, version: int, by: Sequence[str] = ()) -> DataFrame:
        """Writes one segment of a table (in folders of the columns ``by``) and gives it back as read."""
        path = f"{self.root}/{table}/segment={version}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, table: str, schema: T.StructType | dict[str, str] | None = None, below: int | None = None) -> DataFrame:
        """Rows of all committed segments (before ``below`` if given) of a table, with their ``segment``.

        ``schema`` may be types by name. Without one that of the files counts; there is at least one then.
        """
        paths = [f"{self.root}/{table}/segment={v}" for v in self.versions() if below is None or v < below]
        reader = self.spark.read.option("basePath", f"{self.root}/{table}")
        if schema is None:
            return reader.parquet(*paths)
        types = schema if isinstance(schema, dict) else {f.name: f.dataType.simpleString() for f in schema}
        whole = ", ".join(f"`{name}` {kind}" for name, kind in [*types.items(), ("segment", "int")])
        return reader.schema(whole).parquet(*paths) if paths else self.spark.createDataFrame([], whole)

    def commit(self, version: int, note: DataFrame) -> None:
        """Makes a change count; ``note`` is its small row."""
        snapshots.write_version(note.coalesce(1), f"{self.root}/commits", version)

    def notes(self) -> DataFrame:
        """The rows of all commits, with their ``segment``; there is at least one."""
        rows = self.spark.read.parquet(*[f"{self.root}/commits/v{v}" for v in self.versions()])
        return rows.withColumn("segment", F.regexp_extract("_metadata.file_path", r"/v(\d+)/[^/]*$", 1).cast("int"))


def last_of(rows: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Of each key the row of the last segment, without its number."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in rows.columns if c not in (*keys, "segment")]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "segment").alias("row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in rows.columns if c != "segment"])


def without_removed(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in no later segment of ``removed`` (``key, segment``)."""
    gone = removed.groupBy(F.col(key).alias("gone_key")).agg(F.max("segment").alias("gone_at"))
    return rows.join(gone, (F.col(key) == F.col("gone_key")) & (F.col("segment") < F.col("gone_at")), "left_anti")
