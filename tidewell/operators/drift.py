"""Expected against observed: drifts, differences and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.scoring import drift_status, relative_drift, share_pct, status_name, status_rank
from tidewell.functions.text import lookup
from tidewell.plans.quantile import exact_median
from tidewell.plans.topk import top_k


def with_drift(rows: DataFrame, thresholds: tuple[float, float] = fixed.RATE_THRESHOLDS) -> DataFrame:
    """Adds ``absolute_delta, relative_pct, status`` to rows of ``expected, observed``."""
    out = rows.withColumn("absolute_delta", F.col("expected").cast("double") - F.col("observed").cast("double"))
    out = out.withColumn("relative_pct", relative_drift("expected", "observed"))
    return out.withColumn("status", drift_status("relative_pct", thresholds))


def expected_vs_observed(observed: DataFrame, expected: DataFrame, keys: Sequence[str],
                         thresholds: tuple[float, float] = fixed.ABILITY_THRESHOLDS) -> DataFrame:
    """Drift per observed key; a key that is not expected counts as expected 0."""
    joined = observed.join(expected, list(keys), "left")
    return with_drift(joined.withColumn("expected", F.coalesce("expected", F.lit(0.0))), thresholds)


def fight_status(drifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst status over all metrics of a fight."""
    return drifts.groupBy(*keys).agg(F.max(status_rank("status")).alias("_r")).withColumn(
        "overall_status", status_name("_r")).drop("_r")


def per_boss(rates: DataFrame, key: str = "encounter_name") -> DataFrame:
    """Averages per boss and the status of the average drift."""
    agg = rates.groupBy(key).agg(
        F.count(F.lit(1)).alias("fight_count"), F.avg("expected").alias("avg_expected"),
        F.avg("observed").alias("avg_observed"), F.avg("relative_pct").alias("avg_drift_pct"))
    return agg.withColumn("status", drift_status("avg_drift_pct", fixed.RATE_THRESHOLDS))


def overall_report(rates: DataFrame, fights: DataFrame) -> DataFrame:
    """One row: counts, mean drift (0 when nothing was compared) and its status.

    ``fights`` holds every fight with its ``included`` flag.
    """
    drift = rates.agg(F.coalesce(F.avg("relative_pct"), F.lit(0.0)).alias("overall_drift_pct")).scalar()
    counts = fights.agg(F.count(F.lit(1)).alias("total_fights"), F.count_if("included").alias("included_fights"))
    out = counts.withColumn("excluded_fights", F.col("total_fights") - F.col("included_fights")).withColumn(
        "overall_drift_pct", drift)
    return out.withColumn("overall_status", drift_status("overall_drift_pct", fixed.RATE_THRESHOLDS))


def stored_report(report: DataFrame, run_id: Column, created_at: Column) -> DataFrame:
    """Report row in the form kept in the run history."""
    return report.select(run_id.alias("run_id"), created_at.alias("created_at"),
                         F.to_json(F.struct(*report.columns)).alias("report_json"))


def run_history(runs: DataFrame, n: int = 20) -> DataFrame:
    """The newest runs."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def stored_run(runs: DataFrame, run_id, schema: str) -> DataFrame:
    """A stored report by id, decoded."""
    return runs.where(F.col("run_id") == run_id).select("run_id", F.from_json("report_json", schema).alias("r")).select(
        "run_id", "r.*")


# --- comparisons -------------------------------------------------------------
def before_after(before: DataFrame, after: DataFrame, keys: Sequence[str], *, min_change: float | None = None) -> DataFrame:
    """Rows ``before, after, delta, delta_pct`` over the union of keys.

    Without ``min_change`` every changed row is kept, with it rows that changed by more.
    """
    joined = before.join(after, list(keys), "full").select(
        *keys, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    out = joined.withColumn("delta", F.col("after") - F.col("before")).withColumn(
        "delta_pct", F.when(F.col("before") > 0, F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100)
        .otherwise(F.lit(0.0)))
    return out.where(F.col("delta") != 0) if min_change is None else out.where(F.abs("delta") > min_change)


def range_check(results: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Value against its expected range: inside or not, drift from the middle in percent."""
    mid = (F.col("low") + F.col("high")) / 2
    return results.join(profiles, key).withColumns({
        "in_range": (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")),
        "drift_pct": F.when(mid > 0, F.try_divide(F.col("value") - mid, mid) * 100).otherwise(F.lit(0.0)),
    })


# --- statistics over result tables -------------------------------------------
def trial_statistics(trials: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for a single trial), exact median, min, max."""
    moments = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        F.coalesce(F.when(F.count(value) > 1, F.stddev_samp(value)), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return moments.join(exact_median(trials, keys, value), list(keys), "left")


def outcome_breakdown(hits: DataFrame, keys: Sequence[str], trials: Column) -> DataFrame:
    """Per category: mean damage per trial, share, and percent of each outcome."""
    c = lambda *names: F.count_if(F.col("outcome").isin(*names))
    per = hits.groupBy(*keys, "ability").agg(
        F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("n"), c("hit", "tick").alias("_hit"), c("crit").alias("_crit"),
        c("miss").alias("_miss"), c("dodge").alias("_dodge"), c("glancing").alias("_glancing"))
    whole = per.groupBy(*keys).agg(F.sum("_sum").alias("_whole"))
    joined = per.join(whole, list(keys)) if keys else per.withColumn("_whole", whole.select("_whole").scalar())
    return joined.select(
        *keys, "ability", (F.col("_sum") / trials).alias("mean_damage"), share_pct("_sum", "_whole").alias("share_pct"),
        *[share_pct(f"_{o}", "n").alias(f"{o}_pct") for o in ("hit", "crit", "miss", "dodge", "glancing")])


def stat_totals(gear: DataFrame, key: str, stats: str, caps: dict[str, float]) -> DataFrame:
    """Sum per stat over all gear of a config, and whether it reaches its cap."""
    per = gear.select(key, F.explode(stats).alias("stat", "value")).groupBy(key, "stat").agg(F.sum("value").alias("total"))
    cap = lookup("stat", caps) if caps else F.lit(None).cast("double")
    return per.withColumn("capped", F.coalesce(F.col("total") >= cap, F.lit(False)))


def weighted_candidates(items: DataFrame, weights: dict[str, float], stats: str, k: int = 20) -> DataFrame:
    """Best ``k`` items per slot by the weighted sum of their stats."""
    score = F.aggregate(F.map_entries(stats), F.lit(0.0),
                        lambda acc, e: acc + e["value"].cast("double") * lookup(e["key"], weights, 0.0))
    return top_k(items.withColumn("score", F.round(score, 6)), ["slot"], [F.desc("score"), F.asc("item_id")], k)


def recommend(results: DataFrame, base: DataFrame, key: str, current: str, value: str, n: int = 5) -> DataFrame:
    """Candidates ranked by gain over the base of their key, without the current item."""
    joined = results.join(base.select(key, F.col(value).alias("_base"), F.col(current).alias("_cur")), key)
    better = joined.where(F.col("item_id") != F.col("_cur")).withColumn("delta", F.round(F.col(value) - F.col("_base"), 6))
    return top_k(better, [key], [F.desc("delta"), F.asc("item_id")], n, rank="position").drop("_cur")


def stat_weights(results: DataFrame, key: str, *, reference: str = "attack_power") -> DataFrame:
    """Value of one point of each stat, relative to the reference stat where that is positive.

    ``results``: ``key, stat, delta, value``; the row with stat ``base`` is the base.
    """
    base = results.where(F.col("stat") == "base").select(key, F.col("value").alias("_base"))
    raw = results.where(F.col("stat") != "base").join(base, key).withColumn(
        "weight", F.try_divide(F.col("value") - F.col("_base"), F.col("delta").cast("double")))
    ref = raw.where(F.col("stat") == reference).select(key, F.col("weight").alias("_ref"))
    out = raw.join(ref, key, "left")
    return out.withColumn("normalized", F.when(F.col("_ref") > 0, F.try_divide("weight", "_ref")).otherwise(F.col("weight"))
                          ).select(key, "stat", "weight", "normalized")


def resolve_buffs(chosen: DataFrame, key: str) -> DataFrame:
    """Buffs that count for a config after the stacking rules.

    ``chosen``: ``key, buff_id, category, stats, seq``. A flask excludes elixirs;
    within a category the buff with the larger stat total counts (the first on a
    tie); uncategorised buffs all count.
    """
    flask = chosen.groupBy(key).agg(F.bool_or(F.col("category") == "flask").alias("_flask"))
    elixir = F.col("category").isin("battle_elixir", "guardian_elixir")
    kept = chosen.join(flask, key).where(~(F.col("_flask") & elixir)).drop("_flask")
    size = F.aggregate(F.map_values("stats"), F.lit(0.0), lambda a, v: a + v)
    rest = [c for c in chosen.columns if c not in (key, "category")]
    best = kept.where(F.col("category") != "uncategorized").groupBy(key, "category").agg(
        F.max_by(F.struct(*rest), F.struct(size.alias("size"), (-F.col("seq")).alias("first"))).alias("_b"))
    winners = best.select(key, "category", *[F.col(f"_b.{c}").alias(c) for c in rest])
    return winners.unionByName(kept.where(F.col("category") == "uncategorized").select(*winners.columns))


def buff_effects(kept: DataFrame, key: str) -> DataFrame:
    """Sums per config and stat, marked as flat, multiplier (``_pct``) or armour reduction."""
    per = kept.select(key, F.explode("stats").alias("stat", "value")).groupBy(key, "stat").agg(F.sum("value").alias("total"))
    kind = F.when(F.col("stat") == "boss_armor_reduction", "armor").when(F.endswith("stat", F.lit("_pct")), "multiplier").otherwise("flat")
    return per.withColumn("effect", kind)
