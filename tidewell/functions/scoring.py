"""Numeric scores: trust, recency, drift, accuracy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.text import lookup


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clamp(col: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Value kept within bounds; null stays null (``greatest`` alone would skip it)."""
    x = _c(col)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def base_trust(source_type: Column | str, table: dict[str, float] | None = None) -> Column:
    """Starting trust of a kind of source."""
    return lookup(source_type, fixed.SOURCE_TRUST if table is None else table, fixed.DEFAULT_TRUST)


def trust_with_events(base: Column | str, delta_sum: Column | str) -> Column:
    """Base trust plus all event deltas, kept within bounds."""
    return clamp(_c(base) + F.coalesce(_c(delta_sum), F.lit(0.0)), fixed.TRUST_FLOOR, fixed.TRUST_CEILING)


def aged_trust(base: Column | str, age_days: Column | str, max_age: float, factor: float) -> Column:
    """Older scheme: exponential loss once a source is older than ``max_age``."""
    age = _c(age_days)
    over = (age - F.lit(float(max_age))) / F.lit(float(max_age))
    return F.when(age <= max_age, _c(base)).otherwise(_c(base) * F.pow(F.lit(float(factor)), over))


def age_days(created: Column | str, now: Column) -> Column:
    """Days between two timestamps, with fractions."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(_c(created).cast("timestamp"))) / F.lit(86_400_000_000.0)


def recency(created: Column | str, now: Column, fold_days: float = 30.0) -> Column:
    """``exp(-age / fold_days)``; 1 for the future, 0.5 when the time is unknown.

    ``created`` may be a timestamp or text; text that is no time counts as unknown.
    """
    stamp = F.try_to_timestamp(_c(created).cast("string"))
    known = F.exp(-F.greatest(F.lit(0.0), age_days(stamp, now)) / F.lit(fold_days))
    return F.when(stamp.isNotNull(), known).otherwise(F.lit(0.5))


def composite(similarity: Column | str, recency_: Column | str, quality: Column | str) -> Column:
    """Memory score out of similarity, recency and quality."""
    return F.lit(0.6) * _c(similarity) + F.lit(0.2) * _c(recency_) + F.lit(0.2) * _c(quality)


def relative_drift(expected: Column | str, observed: Column | str) -> Column:
    """Deviation of expected from observed in percent of observed."""
    e, o = _c(expected).cast("double"), _c(observed).cast("double")
    return F.when(o != 0, F.try_divide(e - o, o) * 100).otherwise(F.when(e > 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def drift_status(pct: Column | str, thresholds: tuple[float, float]) -> Column:
    """``pass``, ``warn`` or ``fail`` by the size of a drift."""
    size = F.abs(_c(pct))
    return F.when(size <= thresholds[0], "pass").when(size <= thresholds[1], "warn").otherwise("fail")


STATUS_RANK = {"pass": 0, "warn": 1, "fail": 2}


def status_rank(status: Column | str) -> Column:
    return lookup(status, STATUS_RANK)


def status_name(rank: Column | str) -> Column:
    return lookup(rank, {v: k for k, v in STATUS_RANK.items()})


def active_rate(total: Column | str, active_ms: Column | str) -> Column:
    """Amount per active second; 0 without active time."""
    ms = F.coalesce(_c(active_ms), F.lit(0)).cast("double")
    return F.when(ms > 0, F.try_divide(_c(total).cast("double"), ms / 1000.0)).otherwise(F.lit(0.0))


def share_pct(part: Column | str, total: Column | str) -> Column:
    """Share in percent; 0 when the total is not positive."""
    t = _c(total).cast("double")
    return F.when(t > 0, F.try_divide(_c(part).cast("double"), t) * 100).otherwise(F.lit(0.0))


def range_accuracy(actual: Column | str, low: Column | str, high: Column | str, tolerance_pct: float = 5.0) -> Column:
    """1 inside the range, falling to 0 over a margin of ``tolerance_pct`` of its width."""
    a, lo, hi = (_c(x).cast("double") for x in (actual, low, high))
    width = F.when(hi - lo > 0, hi - lo).otherwise(F.lit(1.0))
    dist = F.greatest(lo - a, a - hi)
    return F.when((a >= lo) & (a <= hi), F.lit(1.0)).when(
        a.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - dist / (width * F.lit(tolerance_pct / 100.0))))


def blended_accuracy(accuracy: Column | str, range_acc: Column | str, tier: Column | str) -> Column:
    """Judged accuracy averaged with the range accuracy for simulation questions."""
    return F.when((_c(tier) == "simulation") & _c(range_acc).isNotNull(), (_c(accuracy) + _c(range_acc)) / 2).otherwise(
        _c(accuracy))


def strategy_quality(distinct_tools: Column | str) -> Column:
    """Quality credited to an answer by the number of distinct tools used."""
    return F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * _c(distinct_tools))
