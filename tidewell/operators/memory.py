"""Session memories and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scoring import composite, recency
from tidewell.operators.retrieval import knn
from tidewell.plans.blocked import with_neighbours
from tidewell.plans.topk import top_k


def recall(memories: DataFrame, queries: DataFrame, now: Column, top: int = 5, *, id_col: str = "memory_id") -> DataFrame:
    """Best memories per query: three times as many neighbours, rescored with age and quality.

    ``memories``: ``memory_id, embedding, created_at, quality``; ``queries``:
    ``query_id, query_embedding``.
    """
    near = knn(memories, queries, top * 3, id_col=id_col).withColumnRenamed("doc_id", id_col)
    rest = near.join(memories.drop("embedding"), id_col)
    scored = rest.withColumn("recency", recency("created_at", now)).withColumn(
        "score", F.round(composite(F.greatest(F.lit(0.0), "similarity"), "recency", "quality"), 9))
    return top_k(scored.drop("rank0"), ["query_id"], [F.desc("score"), F.asc(id_col)], top, rank="position")


def reinforce(uses: DataFrame, pattern: str = "pattern") -> DataFrame:
    """One strategy per pattern: uses, mean quality, tools and time of the last use."""
    return uses.groupBy(pattern).agg(
        F.count(F.lit(1)).alias("times_reinforced"), F.avg("quality").alias("avg_quality"),
        F.max_by("tools", F.col("seq")).alias("tools"), F.max("used_at").alias("last_used"))


def best_strategies(strategies: DataFrame, top: int = 3, pattern: str = "pattern") -> DataFrame:
    return strategies.orderBy(F.desc("avg_quality"), F.asc(pattern)).limit(top)


def within_budget(rows: DataFrame, key: str, order: str, text: str, block: Column, budget: int = 2000) -> DataFrame:
    """Leading rows of a key while their total length stays within the budget."""
    running = with_neighbours(rows, [key], [order], block, running_sum={"running_chars": F.length(text)})
    return running.where(F.col("running_chars") <= budget)


def newest(rows: DataFrame, key: str, order: str, n: int = 40) -> DataFrame:
    """Last ``n`` rows of a key."""
    return top_k(rows, [key], [F.desc(order)], n, rank="_r").drop("_r")
