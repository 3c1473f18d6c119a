"""Operator 13: exact duplicates by a 128-bit content hash, with a comparison of bytes inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize


def content_hash(text: Column) -> Column:
    """128 bits of a text's bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def as_it_is(text: Column) -> Column:
    return text


def _better(keep: str) -> Callable[[str], Column]:
    """The aggregate that finds the row that stays: ids before none, then by id, then by the row's place."""
    if keep == "smallest":
        return lambda c: F.min(F.struct(F.col(f"{c}.none"), F.col(f"{c}.id"), F.col(f"{c}.place")))
    if keep == "largest":
        return lambda c: F.max(F.struct((~F.col(f"{c}.none")).alias("some"), F.col(f"{c}.id"), F.col(f"{c}.place")))
    raise ValueError(f"keep is smallest or largest, not {keep}")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest",
                normalise: Callable[[Column], Column] = as_it_is, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``doc_id, keep_id, group_size long, kept boolean, text_sha256 string``: one row for each row of ``docs``.

    Texts are equal when their bytes are after ``normalise``; null counts as empty. Of equal texts
    the row with the smallest (or largest) id stays; a null id only where no row has another. Of
    repeated rows of one id one stays. An empty table gives no rows. Other columns are not read.

    1. Hashes are written without texts. A group is summed up for each split of the input, then
       over all splits, and the result goes back to the splits and from there to the rows. So a
       group of any size meets its rows a split at a time, never in one task.
    2. Distinct pairs of hash and text, combined in each task, show which hashes stand for more
       than one text. Rows of these are grouped by their texts instead.
    """
    best = _better(keep)
    whole = docs.select(F.col(doc_id).alias("id"), F.coalesce(normalise(F.col(text).cast("string")), F.lit("")).alias("t"))
    whole = whole.withColumn("k", digest(F.col("t")))
    own = F.struct(F.col("id").isNull().alias("none"), "id", F.monotonically_increasing_id().alias("place")).alias("own")
    # The upper bits of a place number the split that the row came from.
    rows = materialize(whole.select(own, "k", F.sha2(F.col("t").cast("binary"), 256).alias("sha")), "hashes").withColumn(
        "split", F.shiftright("own.place", 33))

    parts = rows.groupBy("k", "split").agg(F.count(F.lit(1)).alias("n"), best("own").alias("best"))
    picked = (F.min if keep == "smallest" else F.max)("best")
    groups = parts.groupBy("k").agg(F.sum("n").alias("size"), picked.alias("best")).filter("size > 1").select(F.col("k").alias("g_k"), "size", "best")
    told = parts.select("k", "split").join(groups, F.col("k") == F.col("g_k")).select(
        F.col("k").alias("g_k"), F.col("split").alias("g_split"), "size", "best")

    mixed = whole.select("k", "t").distinct().groupBy("k").count().filter("count > 1").select(F.col("k").alias("m_k"))
    mixed = materialize(mixed, "mixed")
    alike = rows.join(mixed, F.col("k") == F.col("m_k"), "left_anti").join(
        told, (F.col("k") == F.col("g_k")) & (F.col("split") == F.col("g_split")), "left")

    apart = materialize(whole.join(mixed, F.col("k") == F.col("m_k"), "left_semi").select(own, "t"), "apart")
    texts = apart.groupBy("t").agg(F.count(F.lit(1)).alias("size"), best("own").alias("best")).withColumnRenamed("t", "g_t")
    told_apart = apart.join(texts, F.col("t") == F.col("g_t")).withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))

    def out(found: DataFrame) -> DataFrame:
        alone = F.col("size").isNull()
        return found.select(
            F.col("own.id").alias(doc_id), F.when(alone, F.col("own.id")).otherwise(F.col("best.id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("own.place") == F.col("best.place"))).alias("kept"),
            F.col("sha").alias("text_sha256"))

    return out(alike).unionByName(out(told_apart))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
