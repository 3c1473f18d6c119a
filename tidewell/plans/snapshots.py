"""Versioned Parquet tables: write a new folder, never overwrite one in use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP_DEFAULT = 7


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath) and fs.getFileStatus(hpath).isFile()


def complete_versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions below ``root``, newest first."""
    fs, hpath = _fs(spark, root)
    if not fs.exists(hpath):
        return []
    found = []
    for status in fs.listStatus(hpath):
        m = re.fullmatch(r"v(\d+)", status.getPath().getName())
        if m and exists(spark, f"{root}/v{m.group(1)}/_SUCCESS"):
            found.append(int(m.group(1)))
    return sorted(found, reverse=True)


def write_version(df: DataFrame, root: str, version: int) -> None:
    """Write one version; a repeated attempt replaces its own half-done folder."""
    df.write.mode("overwrite").parquet(f"{root}/v{version}")


def prune_versions(spark: SparkSession, root: str, keep: int = 3) -> None:
    """Delete all but the newest finished versions of a state table."""
    for version in complete_versions(spark, root)[keep:]:
        fs, hpath = _fs(spark, f"{root}/v{version}")
        fs.delete(hpath, True)


def read_latest(spark: SparkSession, root: str, below: int | None = None) -> DataFrame | None:
    """Newest finished version (older than ``below`` if given), or None."""
    versions = [v for v in complete_versions(spark, root) if below is None or v < below]
    return spark.read.parquet(f"{root}/v{versions[0]}") if versions else None


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and order-free checksum of a table."""
    digest = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), digest.alias("checksum")).select(
        F.lit(name).alias("table_name"), "n_rows", F.coalesce("checksum", F.lit(0).cast("decimal(38,0)")).alias("checksum")
    )


def create_backup(tables: dict[str, DataFrame], root: str, stamp: str) -> None:
    """Copy every table below ``root/stamp``."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{stamp}/{name}")


def verify_backup(tables: dict[str, DataFrame], root: str, stamp: str) -> DataFrame:
    """One row per table: counts and checksums of both sides and whether they agree."""
    out = None
    for name, df in tables.items():
        copy = df.sparkSession.read.parquet(f"{root}/{stamp}/{name}")
        pair = fingerprint(df, name).join(
            fingerprint(copy, name).withColumnsRenamed({"n_rows": "copy_rows", "checksum": "copy_checksum"}), "table_name"
        )
        row = pair.select(
            "table_name", "n_rows", "copy_rows",
            ((F.col("n_rows") == F.col("copy_rows")) & (F.col("checksum") == F.col("copy_checksum"))).alias("intact"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def list_backups(spark: SparkSession, root: str) -> list[str]:
    """Stamps of the backups below ``root``, newest first."""
    fs, hpath = _fs(spark, root)
    if not fs.exists(hpath):
        return []
    return sorted((s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory()), reverse=True)


def prune_backups(spark: SparkSession, root: str, keep: int = KEEP_DEFAULT) -> list[str]:
    """Delete all but the ``keep`` newest backups; returns the removed stamps."""
    removed = list_backups(spark, root)[max(keep, 0):]
    for stamp in removed:
        fs, hpath = _fs(spark, f"{root}/{stamp}")
        fs.delete(hpath, True)
    return removed
