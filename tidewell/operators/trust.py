"""Trust scores and freshness of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.scoring import trust_with_events
from tidewell.functions.text import content_hash, is_blank


def event_totals(events: DataFrame, key: str = "source") -> DataFrame:
    """Sum of trust deltas per source; sums combine before the shuffle."""
    return events.groupBy(key).agg(F.sum("delta").alias("delta_sum"))


def effective_trust(sources: DataFrame, events: DataFrame, key: str = "source", base: str = "trust_score") -> DataFrame:
    """``sources`` with ``effective_trust``: base plus event deltas within bounds."""
    return sources.join(event_totals(events, key), key, "left").withColumn(
        "effective_trust", trust_with_events(base, "delta_sum")).drop("delta_sum")


def event_history(events: DataFrame, source: str | None = None) -> DataFrame:
    """Trust events in time order, of one source or of all."""
    kept = events if source is None else events.where(F.col("source") == source)
    return kept.orderBy("source", "created_at", "event_id")


def age_hours(then: Column | str, now: Column) -> Column:
    col = F.col(then) if isinstance(then, str) else then
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(col.cast("timestamp"))
    return micros / F.lit(3_600_000_000.0)


def due_for_check(sources: DataFrame, now: Column) -> DataFrame:
    """Sources never checked or checked longer ago than their interval."""
    overdue = F.col("last_checked").isNull() | (age_hours("last_checked", now) > F.col("check_interval_hours"))
    return sources.where(overdue)


def stale_list(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("is_stale"))


def clear_stale(sources: DataFrame, keys: DataFrame, key: str = "url") -> DataFrame:
    """All sources, with the flag cleared for those listed in ``keys``."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    cleared = sources.join(hit, key, "left")
    return cleared.withColumn("is_stale", F.col("is_stale") & F.col("_hit").isNull()).drop("_hit")


def freshness_outcome(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """Compare sources with what a fetch observed.

    ``seen``: ``url, head_status, last_modified, text`` (nulls where absent) and,
    optionally, ``fetch_error`` with the message of a fetch that failed. ``outcome`` is
    one of unobserved (no row in ``seen``), error, dead, fresh, empty, unchanged, changed.
    """
    if "fetch_error" not in seen.columns:
        seen = seen.withColumn("fetch_error", F.lit(None).cast("string"))
    joined = sources.join(seen.withColumn("_seen", F.lit(True)), "url", "left")
    new_hash = content_hash("text")
    outcome = (
        F.when(F.col("_seen").isNull(), "unobserved")
        .when(F.col("fetch_error").isNotNull(), "error")
        .when(F.col("head_status") >= 400, "dead")
        .when(F.col("last_modified") < F.col("last_checked"), "fresh")
        .when(is_blank("text"), "empty")
        .when(new_hash == F.col("content_hash"), "unchanged")
        .otherwise("changed")
    )
    out = joined.withColumn("outcome", outcome).drop("_seen")
    read = F.col("outcome").isin("unchanged", "changed")
    error = (
        F.when(F.col("outcome") == "error", F.col("fetch_error"))
        .when(F.col("outcome") == "dead", F.concat(F.lit("Source returned HTTP "), F.col("head_status").cast("string")))
        .when(F.col("outcome") == "empty", F.lit("Content extraction returned empty"))
    )
    return out.withColumns({
        "new_hash": F.when(F.col("outcome") == "fresh", F.col("content_hash")).when(read, new_hash),
        "changed": F.col("outcome") == "changed",
        "head_only": F.col("outcome").isin("dead", "fresh"),
        "error": error,
    })


def apply_freshness(outcomes: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """New state of the sources; a failed fetch or none leaves ``last_checked`` as it was.

    The reference behaviour overwrites the ingested hash as soon as a change is
    seen, so that the new text later counts as already known and the source stays
    hidden. Here ``ingested_hash`` keeps what was ingested; ``content_hash`` is
    what was last seen.
    """
    changed = F.col("changed")
    new = outcomes.withColumns({
        "content_hash_previous": F.when(changed, F.col("content_hash")).otherwise(F.col("content_hash_previous")),
        "content_hash": F.when(changed, F.col("new_hash")).otherwise(F.col("content_hash")),
        "change_count": F.col("change_count") + changed.cast("int"),
        "is_stale": F.col("is_stale") | changed,
        "last_checked": F.when(F.col("outcome").isin("unobserved", "error"), F.col("last_checked")).otherwise(now),
    })
    return new.select(*columns)


def dead_url_events(outcomes: DataFrame, now: Column, once_per_outage: DataFrame | None = None) -> DataFrame:
    """Trust events for unreachable sources.

    ``once_per_outage``: sources (``url``) already known to be down; they lose trust
    only once per outage instead of at every sweep.
    """
    dead = outcomes.where(F.col("outcome") == "dead")
    if once_per_outage is not None:
        dead = dead.join(once_per_outage.select("url").distinct(), "url", "left_anti")
    return dead.select(
        "url", F.lit("dead_url").alias("event_type"), F.lit(fixed.TRUST_DELTAS["dead_url"]).alias("delta"),
        F.concat(F.lit("HTTP "), F.col("head_status").cast("string"), F.lit(" for "), F.col("url")).alias("details"),
        now.alias("created_at"),
    )


def freshness_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a sweep: checked, changed, errors; unobserved sources are not checked."""
    return outcomes.agg(
        F.count_if(F.col("outcome") != "unobserved").alias("checked"),
        F.count_if("changed").alias("changed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def stale_count_for_urls(lists: DataFrame, sources: DataFrame, key: str, urls: str) -> DataFrame:
    """Per row of ``lists``, how many of its URLs belong to stale sources; 0 when none."""
    wanted = lists.select(key, F.explode(F.array_distinct(urls)).alias("url"))
    hits = wanted.join(sources.where(F.col("is_stale")).select("url"), "url").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_stale"))
    return lists.select(key).join(hits, key, "left").select(key, F.coalesce("n_stale", F.lit(0)).alias("n_stale"))
