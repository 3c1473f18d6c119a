"""Evaluation scores and trajectory checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.text import first_number
from tidewell.plans.blocked import with_neighbours
from tidewell.plans.topk import top_k


def faithfulness(claims: DataFrame, key: str) -> DataFrame:
    """Supported share of the judged claims; unclear ones do not count; 1 when none is judged."""
    yes, no = F.count_if(F.col("judgment") == "supported"), F.count_if(F.col("judgment") == "not_supported")
    return claims.groupBy(key).agg(F.when(yes + no > 0, F.try_divide(yes, yes + no)).otherwise(F.lit(1.0)).alias("faithfulness"))


def with_repeats(calls: DataFrame, key: str, step: str, block: Column, call: str = "tool_name") -> DataFrame:
    """Calls with ``is_repeat``: the same as the call directly before."""
    prev = with_neighbours(calls, [key], [step], block, lag={"_prev": F.struct(F.col(call).alias("c"))})
    return prev.withColumn("is_repeat", F.col("_prev").isNotNull() & (F.col("_prev.c").eqNullSafe(F.col(call)))).drop("_prev")


def trajectory_precision(questions: DataFrame, calls: DataFrame, expected: DataFrame, key: str, step: str, block: Column) -> DataFrame:
    """Share of calls that hit an expected tool and do not repeat the call before; 1 without calls.

    ``expected``: ``key, tool_name`` rows.
    """
    marked = with_repeats(calls, key, step, block)
    hit = expected.select(key, "tool_name").distinct().withColumn("_hit", F.lit(True))
    useful = ~F.col("is_repeat") & F.col("_hit").isNotNull()
    per = marked.join(hit, [key, "tool_name"], "left").groupBy(key).agg(
        F.try_divide(F.count_if(useful), F.count(F.lit(1))).alias("trajectory_precision"))
    return questions.select(key).join(per, key, "left").fillna({"trajectory_precision": 1.0})


SCORES = ["faithfulness", "relevancy", "trajectory", "accuracy"]


def of_tier(items: DataFrame, tier: str | None = None) -> DataFrame:
    """Evaluation items of one tier, or all; items without a tier belong to none."""
    return items if tier is None else items.where(F.col("tier") == tier)


def gate_report(results: DataFrame) -> DataFrame:
    """Means of the four scores and whether each reaches its threshold; no results fail."""
    means = results.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(s), F.lit(0.0)).alias(s) for s in SCORES])
    passed = F.col("n") > 0
    for s in SCORES:
        passed = passed & (F.col(s) >= fixed.GATE[s])
    return means.withColumn("passed", passed)


def tier_breakdown(results: DataFrame) -> DataFrame:
    """The same means per tier; an empty tier is ``unknown``."""
    tier = F.when(F.coalesce("tier", F.lit("")) == "", "unknown").otherwise(F.col("tier"))
    return results.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(s) for s in SCORES])


def tail_runs(calls: DataFrame, key: str, step: str, block: Column, call: Column, n: int = 3) -> DataFrame:
    """Trajectories whose last ``n`` calls are identical, with the length of that run.

    One ordered pass numbers the calls and marks where they change; the run is what
    follows the last change, so two aggregates give its length without a join.
    """
    marked = with_neighbours(calls.withColumn("_call", call), [key], [step], block,
                             lag={"_prev": F.struct(F.col("_call").alias("c"))}, running_sum={"_rn": F.lit(1)})
    change = F.col("_prev").isNull() | ~F.col("_prev.c").eqNullSafe(F.col("_call"))
    per = marked.groupBy(key).agg(F.max_by("_call", F.col(step)).alias("call"), F.max("_rn").alias("_all"),
                                  F.max(F.when(change, F.col("_rn"))).alias("_start"))
    return per.select(key, "call", (F.col("_all") - F.col("_start") + 1).alias("run_length")).where(F.col("run_length") >= n)


def total_repeats(calls: DataFrame, key: str, call: Column, n: int = 3) -> DataFrame:
    """Identical calls made at least ``n`` times in a trajectory."""
    return calls.groupBy(key, call.alias("call")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= n)


def token_budget(calls: DataFrame, key: str, texts: list[str], budget: int) -> DataFrame:
    """Estimated tokens per trajectory and whether they exceed the budget."""
    chars = F.lit(0)
    for t in texts:
        chars = chars + F.coalesce(F.length(t), F.lit(0))
    return calls.groupBy(key).agg(F.floor(F.sum(chars) / 4).alias("tokens")).withColumn("over_budget", F.col("tokens") > budget)


def loop_report(calls: DataFrame, key: str, step: str, block: Column, call: Column, texts: list[str], *, n_tail: int = 3,
                n_total: int = 3, budget: int = 100_000) -> DataFrame:
    """One row per trajectory with its first ``problem``: stuck, looping, over budget, or null."""
    stuck = tail_runs(calls, key, step, block, call, n_tail).select(key, F.lit(True).alias("_stuck"))
    looping = total_repeats(calls, key, call, n_total).select(key).distinct().withColumn("_looping", F.lit(True))
    out = token_budget(calls, key, texts, budget).join(stuck, key, "left").join(looping, key, "left")
    problem = F.when(F.col("_stuck"), "stuck").when(F.col("_looping"), "looping").when(F.col("over_budget"), "over budget")
    return out.select(key, "tokens", problem.alias("problem"))


def compact_observations(entries: DataFrame, key: str, step: str, *, tool: str, observation: str, keep: int = 2) -> DataFrame:
    """All but the newest ``keep`` entries shortened to a summary line.

    The newest steps of a key are a bounded top-k; the others join to it.
    """
    recent = top_k(entries.select(key, step), [key], [F.desc(step)], keep, rank="_r").select(key, step, F.lit(True).alias("_recent"))
    obs = F.coalesce(observation, F.lit(""))
    body = F.when(F.length(obs) > 200, F.concat(F.left(obs, F.lit(100)), F.lit("... [truncated] ..."), F.right(obs, F.lit(100)))).otherwise(obs)
    short = F.concat(F.lit("[Summarized] ["), F.col(tool), F.lit("] "), body)
    joined = entries.join(recent, [key, step], "left")
    return joined.withColumn(observation, F.when(F.col("_recent"), F.col(observation)).otherwise(short)).drop("_recent")


def reported_rate(answers: DataFrame, observations: DataFrame, key: str, step: str) -> DataFrame:
    """Rate stated in an answer, else in its newest observation that states one."""
    answer = first_number("output", fixed.RATE_PATTERNS)
    noted = observations.withColumn("_n", first_number("observation", fixed.RATE_PATTERNS))
    last = noted.groupBy(key).agg(F.max_by("_n", F.when(F.col("_n").isNotNull(), F.col(step))).alias("_fallback"))
    return answers.join(last, key, "left").withColumn("rate", F.coalesce(answer, F.col("_fallback"))).drop("_fallback")
