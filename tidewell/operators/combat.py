"""Combat-log analytics: encounters, damage, casts, auras, fights.

Events are rows ``log_id, seq, ts_ms, kind, ability, amount, ...`` ordered by
``seq`` within a log. Logs may be arbitrarily long: ordered steps run per block
of the sequence, and everything else is an aggregate on fine-grained keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.scoring import active_rate, share_pct
from tidewell.functions.text import lookup
from tidewell.plans.blocked import with_neighbours

START, END = "start", "end"


def with_markers(events: DataFrame, block: Column) -> DataFrame:
    """Events with the nearest marker before and after them, in one ordered pass.

    ``kind`` is ``start`` / ``end`` for markers. Ties in ``seq`` must not occur within
    a log.
    """
    is_marker = F.col("kind").isin(START, END)
    mark = F.when(is_marker, F.struct(F.col("kind").alias("k"), F.col("seq").alias("s"), F.col("ts_ms").alias("t")))
    return with_neighbours(events, ["log_id"], ["seq"], block, last_before={"_prev": mark}, first_after={"_next": mark})


def inside_encounters(marked: DataFrame) -> DataFrame:
    """Events inside completed encounters, with the encounter's bounds.

    An event counts when the marker before it is a start and the one after it is an
    end, which says the same as: a new start drops an open encounter, an end without
    a start is ignored, an unfinished encounter is dropped. Adds ``enc_seq,
    enc_start_ms, enc_end_ms`` (sequence number of the start marker, both times).
    """
    inside = ~F.col("kind").isin(START, END) & (F.col("_prev.k") == START) & (F.col("_next.k") == END)
    return marked.where(inside).withColumns({
        "enc_seq": F.col("_prev.s"), "enc_start_ms": F.col("_prev.t"), "enc_end_ms": F.col("_next.t")}).drop("_prev", "_next")


def completed_encounters(marked: DataFrame) -> DataFrame:
    """One row per completed encounter, also of those without any event."""
    done = (F.col("kind") == START) & (F.col("_next.k") == END)
    named = [c for c in ("enc_id", "enc_name") if c in marked.columns]
    return marked.where(done).select("log_id", F.col("seq").alias("enc_seq"), F.col("ts_ms").alias("enc_start_ms"),
                                     F.col("_next.t").alias("enc_end_ms"), *named)


def open_tail(marked: DataFrame) -> DataFrame:
    """Start marker and events of the encounter still open at the end of each log."""
    last = F.col("_next").isNull()
    still = last & ((F.col("kind") == START) | (~F.col("kind").isin(START, END) & (F.col("_prev.k") == START)))
    return marked.where(still).drop("_prev", "_next")


def encounter_events(events: DataFrame, block: Column) -> DataFrame:
    """Events inside completed encounters of raw log events."""
    return inside_encounters(with_markers(events, block))


def ability_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Damage, hits and casts by key and ability; sums of parts add up to those of the whole."""
    return rows.where(F.col("kind").isin("damage", "cast")).groupBy(*keys, "ability").agg(
        F.sum(F.when(F.col("kind") == "damage", F.col("amount"))).alias("damage"),
        F.count_if(F.col("kind") == "damage").alias("hits"), F.count_if(F.col("kind") == "cast").alias("casts"))


def breakdown_of(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Damage, share of the total and casts of the abilities with damage, from ``ability_sums``."""
    per = sums.where(F.col("hits") > 0).drop("hits")
    totals = per.groupBy(*keys).agg(F.sum("damage").alias("total_damage"))
    return per.join(totals, list(keys)).withColumn("damage_pct", share_pct("damage", "total_damage"))


def ability_breakdown(inside: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Per encounter and ability: damage, share of the total, casts.

    Abilities without damage are left out, with their casts.
    """
    keys = ["log_id", "enc_seq", *extra_keys]
    return breakdown_of(ability_sums(inside, keys), keys)


def encounter_totals(fights: DataFrame, inside: DataFrame) -> DataFrame:
    """Per completed encounter: total damage, duration and damage per second."""
    damage = inside.where(F.col("kind") == "damage").groupBy("log_id", "enc_seq").agg(F.sum("amount").alias("total_damage"))
    return totals_of(fights, damage)


def totals_of(fights: DataFrame, damage: DataFrame) -> DataFrame:
    """``encounter_totals`` from ``log_id, enc_seq, total_damage``."""
    duration = F.col("enc_end_ms") - F.col("enc_start_ms")
    out = fights.join(damage, ["log_id", "enc_seq"], "left").withColumn("duration_ms", duration)
    total = F.coalesce("total_damage", F.lit(0))
    return out.withColumn("total_damage", total).withColumn("dps", active_rate(total, F.greatest("duration_ms", F.lit(0))))


def aura_intervals(inside: DataFrame, block: Column) -> DataFrame:
    """Active intervals of auras inside an encounter.

    An interval runs from the application directly before a removal. A second
    application restarts it and forgets the earlier time; a removal of an inactive
    aura is ignored; an aura still active runs to the end of the encounter.
    """
    auras = inside.where(F.col("kind").isin("aura_on", "aura_off"))
    nxt = with_neighbours(auras, ["log_id", "enc_seq", "ability"], ["seq"], block, lead={
        "_n": F.struct(F.col("kind").alias("k"), F.col("ts_ms").alias("t"))})
    until = F.when(F.col("_n").isNull(), F.col("enc_end_ms")).when(F.col("_n.k") == "aura_off", F.col("_n.t"))
    return nxt.where(F.col("kind") == "aura_on").withColumn("until_ms", until).withColumn(
        "active_ms", F.coalesce(F.col("until_ms") - F.col("ts_ms"), F.lit(0)))


def aura_uptime(intervals: DataFrame) -> DataFrame:
    """Share of the encounter an aura was active; none for encounters without duration."""
    duration = F.col("enc_end_ms") - F.col("enc_start_ms")
    return intervals.where(duration > 0).groupBy("log_id", "enc_seq", "ability").agg(
        F.sum("active_ms").alias("active_ms"), F.max(duration).alias("duration_ms")
    ).withColumn("uptime", F.col("active_ms") / F.col("duration_ms"))


# --- dictionary look-ups -----------------------------------------------------
def known_abilities(rows: DataFrame, id_col: str, names: dict | None = None) -> DataFrame:
    """Rows with a known id, named; others are dropped."""
    table = fixed.SPELL_ABILITY if names is None else names
    return rows.withColumn("ability", lookup(id_col, table)).where(F.col("ability").isNotNull())


def name_or_unknown(id_col: str | Column, prefix: str = "unknown_", names: dict | None = None) -> Column:
    """Name of an id, or the id behind a prefix."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    table = fixed.SPELL_ABILITY if names is None else names
    return lookup(col, table, default=F.concat(F.lit(prefix), col.cast("string")))


def unmapped(rows: DataFrame, id_col: str, names: dict | None = None) -> DataFrame:
    """Side table: rows whose id has no name."""
    table = fixed.SPELL_ABILITY if names is None else names
    return rows.where(lookup(id_col, table).isNull())


def ability_totals(rows: DataFrame, keys: Sequence[str], id_col: str, total_col: str, *, of_all: bool = False,
                   names: dict | None = None) -> DataFrame:
    """Totals by mapped name, ranks of one ability added up, with their share.

    The share is of the mapped amount, or with ``of_all`` of the whole amount. Only
    aggregated rows are joined.
    """
    per = known_abilities(rows, id_col, names).groupBy(*keys, "ability").agg(F.sum(total_col).alias("total"))
    base, amount = (rows, total_col) if of_all else (per, "total")
    whole = base.groupBy(*keys).agg(F.sum(amount).alias("_whole"))
    return per.join(whole, list(keys)).withColumn("share_pct", share_pct("total", "_whole")).drop("_whole")


def actor_names(rows: DataFrame, actors: DataFrame, id_col: str, actor_id: str, actor_name: str, out: str = "player_name") -> DataFrame:
    """Name of an actor, the empty string when it has none."""
    names = actors.where((F.coalesce(actor_name, F.lit("")) != "") & (F.col(actor_id) != 0)).select(
        F.col(actor_id).alias(id_col), F.col(actor_name).alias(out))
    return rows.join(names, id_col, "left").withColumn(out, F.coalesce(out, F.lit("")))


# --- fights ------------------------------------------------------------------
def join_fights(fights: DataFrame, damage: DataFrame, combatants: DataFrame) -> DataFrame:
    """Fights with the damage and combatant row of the same player."""
    keys = ["report_code", "fight_id"]
    return fights.join(damage, keys).join(combatants, [*keys, "player_name"])


def annotate_fights(
    fights: DataFrame, *, kills_only: bool = True, min_duration_ms: int = 30_000, stationary_only: bool = True,
    whitelist: Sequence[int] | None = None, stationary: Sequence[int] = tuple(fixed.STATIONARY_ENCOUNTERS),
    death_ratio: float = 0.85,
) -> DataFrame:
    """All fights with ``exclusion_reason`` (null = usable), ``included`` and ``active_dps``.

    The first reason that applies is given.
    """
    reason = F.when(F.lit(kills_only) & ~F.col("kill"), "wipe").when(F.col("duration_ms") < min_duration_ms, "short_fight")
    if whitelist is not None:
        reason = reason.when(~F.col("encounter_id").isin(list(whitelist)), "not_in_whitelist")
    elif stationary_only:
        reason = reason.when(~F.col("encounter_id").isin(list(stationary)), "movement_boss")
    has_time = F.coalesce("active_time_ms", F.lit(0)) != 0
    ratio = F.try_divide(F.col("active_time_ms").cast("double"), F.col("duration_ms").cast("double"))
    reason = reason.when(has_time & (F.col("duration_ms") > 0) & (ratio < death_ratio), "death")
    return fights.withColumns({
        "exclusion_reason": reason, "included": reason.isNull(), "active_dps": active_rate("total_damage", "active_time_ms"),
    })


def report_spans(fights: DataFrame) -> DataFrame:
    """Start and end of a report over its fights; set only if both are known."""
    start, end = F.nullif("start_ms", F.lit(0)), F.nullif("end_ms", F.lit(0))
    span = fights.groupBy("report_code").agg(F.min(start).alias("start_ms"), F.max(end).alias("end_ms"))
    both = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    return span.select("report_code", F.when(both, F.col("start_ms")).alias("start_ms"),
                       F.when(both, F.col("end_ms")).alias("end_ms"))


def snapshot_changes(snapshots: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str,
                     report: str) -> DataFrame:
    """Consecutive snapshots that differ: from, to, old and new value.

    A missing value counts as an empty list. Rows are compared per ``keys``; give
    the player among them, or snapshots of different players are compared.
    """
    state = snapshots.withColumn(value, F.coalesce(value, F.lit("[]")))
    prev = with_neighbours(state, keys, order, block, lag={"old_value": value, "from_report": report})
    return prev.where(F.col("old_value").isNotNull() & (F.col("old_value") != F.col(value))).select(
        *keys, "from_report", F.col(report).alias("to_report"), "old_value", F.col(value).alias("new_value"))


def gear_history(combatants: DataFrame, character_log: DataFrame, reports: DataFrame) -> DataFrame:
    """Gear snapshots of tracked characters with the time of their report."""
    logged = character_log.join(combatants, ["report_code", "fight_id"])
    return logged.join(reports.select("report_code", F.coalesce("start_time", F.lit(0)).alias("start_time")), "report_code")


def unbuffed_stats(combatants: DataFrame, buff_stats: dict[str, dict[str, float]], *, base: dict[str, float] | None = None,
                   multiplier_buff: str = "kings", multiplier: float = 1.10) -> DataFrame:
    """Stats without buffs: multiplier undone, base and flat buff stats taken off, at least 0.

    ``auras`` is the row's array of buff ids; ``buff_stats`` gives the flat stats of a buff.
    """
    # --- fixed values: stats of a character without any gear
    base = {"agility": 180.0, "strength": 110.0, "stamina": 100.0} if base is None else base
    stats = ["agility", "strength", "stamina", "hit_rating", "crit_rating", "haste_rating", "expertise_rating"]
    buffs = F.array_distinct(F.filter(F.transform("auras", lambda a: lookup(a, fixed.BUFF_NAME)), lambda b: b.isNotNull()))
    out = combatants.withColumn("buffs", buffs)
    boosted = F.array_contains("buffs", multiplier_buff)

    def unbuffed(stat: str) -> Column:
        value = F.coalesce(F.col(stat).cast("double"), F.lit(0.0))
        if stat in base:
            value = F.when(boosted, value / multiplier).otherwise(value) - base[stat]
        flat = {b: float(s[stat]) for b, s in buff_stats.items() if s.get(stat) and stat != "expertise_rating"}
        for buff, amount in flat.items():
            value = value - F.when(F.array_contains("buffs", buff), F.lit(amount)).otherwise(F.lit(0.0))
        return F.greatest(F.lit(0.0), value)

    spec, talents = ({i: build[k] for i, build in fixed.SPEC_BUILDS.items()} for k in (0, 1))
    spec_id = F.coalesce(F.nullif("spec_id", F.lit(0)), F.lit(260))
    return out.withColumns({
        **{f"gear_{s}": unbuffed(s) for s in stats},
        "spec": lookup(spec_id, spec, "combat_swords"), "talents": lookup(spec_id, talents, "20/41/0"),
        "fight_length": F.coalesce(F.floor(F.col("duration_ms") / 1000), F.lit(300)),
    })
