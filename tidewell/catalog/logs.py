"""Log analytics: events as combat logs, orders and line items as fights and damage."""

from pyspark.sql import functions as F

from tidewell.catalog.registry import query
from tidewell.functions import scoring as SC
from tidewell.functions.text import lookup
from tidewell.operators import combat as C
from tidewell.operators import drift as D
from tidewell.operators.tables import drop_trash
from tidewell.plans.blocked import balanced_block
from tidewell.sources import combat_log as L

def log_events(t):
    """Users as logs: signup starts and purchase ends an encounter; the rest acts."""
    e = t.events.select(
        F.col("user_id").alias("log_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        "event_type", F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        F.from_json("props", "k bigint")["k"].alias("k"))
    kind = (F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end")
            .when(F.col("event_type") == "error", "cast").otherwise("damage"))
    return e.withColumn("kind", kind).withColumn("ability", F.concat(F.lit("a"), (F.col("k") % 5).cast("string")))


def aura_events(t):
    """The same logs with view as aura applied and click as aura removed."""
    kind = (F.when(F.col("event_type") == "view", "aura_on").when(F.col("event_type") == "click", "aura_off")
            .otherwise(F.col("kind")))
    return log_events(t).withColumn("kind", kind).withColumn("ability", F.concat(F.lit("b"), (F.col("k") % 2).cast("string")))


def block(t):
    return balanced_block(log_events(t), "seq")



EV_SQL = """
ev as (
  select user_id as log_id, event_id as seq, epoch_us(ts) // 1000 as ts_ms, event_type, round(value * 100)::bigint as amount,
         json_extract(props, '$.k')::bigint as k,
         case event_type when 'signup' then 'start' when 'purchase' then 'end' when 'error' then 'cast' else 'damage' end as kind
  from events),
seg as (select *, sum((kind = 'start')::int) over (partition by log_id order by seq) as seg_no from ev),
bounds as (
  select log_id, seg_no, min(seq) filter (kind = 'start') as enc_seq, min(ts_ms) filter (kind = 'start') as enc_start_ms,
         min(seq) filter (kind = 'end') as end_seq, min(ts_ms) filter (kind = 'end') as enc_end_ms
  from seg where seg_no > 0 group by 1, 2),
inside as (
  select s.*, enc_seq, enc_start_ms, enc_end_ms from seg s join bounds b using (log_id, seg_no)
  where end_seq is not null and s.seq > enc_seq and s.seq < end_seq and kind not in ('start', 'end'))
"""


@query("e03_encounter_segments", f"with {EV_SQL} select log_id, seq, enc_seq, enc_start_ms, enc_end_ms from inside")
def e03(t):
    return C.encounter_events(log_events(t), block(t)).select("log_id", "seq", "enc_seq", "enc_start_ms", "enc_end_ms")


@query("e03_open_encounters", f"""with {EV_SQL}
select s.log_id, s.seq from seg s join bounds b using (log_id, seg_no)
where end_seq is null and seg_no = (select max(seg_no) from seg x where x.log_id = s.log_id)""")
def e03b(t):
    return C.open_tail(C.with_markers(log_events(t), block(t))).select("log_id", "seq")


@query("d07_encounter_ability_metrics", f"""with {EV_SQL},
per as (select log_id, enc_seq, 'a' || (k % 5) as ability, sum(amount) filter (kind = 'damage')::bigint as damage,
               count(*) filter (kind = 'cast') as casts
        from inside group by all having count(*) filter (kind = 'damage') > 0)
select log_id, enc_seq, ability, damage, casts, round(case when sum(damage) over w > 0
  then damage / (sum(damage) over w)::double * 100 else 0 end, 6) as damage_pct
from per window w as (partition by log_id, enc_seq)""")
def d07(t):
    got = C.ability_breakdown(C.encounter_events(log_events(t), block(t)))
    return got.select("log_id", "enc_seq", "ability", "damage", "casts", F.round("damage_pct", 6).alias("damage_pct"))


@query("d07_encounter_totals", f"""with {EV_SQL},
dmg as (select log_id, enc_seq, sum(amount)::bigint as dmg from inside where kind = 'damage' group by 1, 2)
select log_id, enc_seq, enc_end_ms - enc_start_ms as duration_ms, coalesce(dmg, 0) as total_damage,
  round(case when enc_end_ms > enc_start_ms then coalesce(dmg, 0) / ((enc_end_ms - enc_start_ms) / 1000.0::double) else 0 end, 6) as dps
from bounds left join dmg using (log_id, enc_seq) where end_seq is not null""")
def d07b(t):
    marked = C.with_markers(log_events(t), block(t))
    got = C.encounter_totals(C.completed_encounters(marked), C.inside_encounters(marked))
    return got.select("log_id", "enc_seq", "duration_ms", "total_damage", F.round("dps", 6).alias("dps"))


AURA_SQL = """
au as (select log_id, enc_seq, enc_end_ms, enc_start_ms, seq, ts_ms, 'b' || (k % 2) as ability, event_type from {src}
       where event_type in ('view', 'click')),
pairs as (select *, lead(event_type) over w as nxt, lead(ts_ms) over w as nxt_ts from au
          window w as (partition by log_id, enc_seq, ability order by seq)),
spans as (select *, case when nxt is null then enc_end_ms when nxt = 'click' then nxt_ts end as until_ms
          from pairs where event_type = 'view')
"""


@query("e04_aura_pairs", f"""with {EV_SQL},
days as (select *, date_trunc('day', make_timestamp(ts_ms * 1000)) as enc_day from ev),
day_ev as (select log_id, epoch_ms(enc_day) as enc_seq, epoch_ms(enc_day) as enc_start_ms, epoch_ms(enc_day) + 86400000 as enc_end_ms,
                  seq, ts_ms, k, event_type from days),
{AURA_SQL.format(src='day_ev')}
select log_id, enc_seq, ability, seq, ts_ms, until_ms, coalesce(until_ms - ts_ms, 0) as active_ms from spans""")
def e04(t):
    day = F.floor(F.col("ts_ms") / 86_400_000) * 86_400_000
    by_day = aura_events(t).withColumn("enc_seq", day).withColumn("enc_start_ms", day).withColumn("enc_end_ms", day + 86_400_000)
    return C.aura_intervals(by_day, block(t)).select("log_id", "enc_seq", "ability", "seq", "ts_ms", "until_ms", "active_ms")


@query("d08_aura_uptime", f"""with {EV_SQL}, {AURA_SQL.format(src='inside')}
select log_id, enc_seq, ability, sum(coalesce(until_ms - ts_ms, 0))::bigint as active_ms,
  round(sum(coalesce(until_ms - ts_ms, 0)) / any_value(enc_end_ms - enc_start_ms)::double, 6) as uptime
from spans where enc_end_ms > enc_start_ms group by 1, 2, 3""")
def d08(t):
    spans = C.aura_intervals(C.encounter_events(aura_events(t), block(t)), block(t))
    return C.aura_uptime(spans).select("log_id", "enc_seq", "ability", "active_ms", F.round("uptime", 6).alias("uptime"))


@query("a05_log_text_scan", f"""with {EV_SQL}
select log_id, seq, ts_ms - 1704067200000 as ts_ms, kind, case when kind in ('damage', 'cast') then 'unknown_' || (700000 + k % 5) end as ability,
  case when kind = 'damage' then amount end as amount from ev""")
def a05(t):
    """Events written as log lines, with a junk line before each, and scanned back."""
    e = log_events(t)
    stamp = F.concat(F.date_format(F.timestamp_millis("ts_ms"), "M/d HH:mm:ss."), F.date_format(F.timestamp_millis("ts_ms"), "SSS"))
    who = F.lit('Player-1,"Some One",0x1,0x0,Creature-2,"Target, Big",0x2,0x0,')
    spell = (F.col("k") % 5 + 700000).cast("string")
    body = (
        F.when(F.col("kind") == "start", F.concat(F.lit('ENCOUNTER_START,652,"Some Boss"')))
        .when(F.col("kind") == "end", F.lit('ENCOUNTER_END,652,"Some Boss"'))
        .when(F.col("kind") == "cast", F.concat(F.lit("SPELL_CAST_SUCCESS,"), who, spell, F.lit(',"Spell",0x1')))
        .otherwise(F.concat(F.lit("SPELL_DAMAGE,"), who, spell, F.lit(',"Spell",0x1,unit,0,'), F.col("amount").cast("string"), F.lit(",0,1")))
    )
    lines = e.select("log_id", "seq", F.concat(stamp, F.lit("  "), body).alias("line"))
    junk = e.select("log_id", "seq", F.lit("## not a log line").alias("line"))
    return L.parse_lines(junk.unionByName(lines)).select("log_id", "seq", "ts_ms", "kind", "ability", "amount")


# --- fights ------------------------------------------------------------------
def fights(t):
    """Orders as fights."""
    return t.orders.select(
        F.col("o_custkey").alias("report_code"), F.col("o_orderkey").alias("fight_id"),
        (F.col("o_orderkey") % 7 + 600).alias("encounter_id"), F.col("o_orderpriority").alias("encounter_name"),
        (F.col("o_orderstatus") != "P").alias("kill"), (F.floor(F.col("o_totalprice")) * 2).alias("duration_ms"))


def fight_damage(t):
    """Line items per order and supplier as damage of a player."""
    per = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum((F.col("l_quantity")).cast("bigint")).alias("total_damage"),
        F.sum(F.floor(F.col("l_extendedprice") * 8)).alias("active_time_ms"))
    return per.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(
        F.col("o_custkey").alias("report_code"), F.col("l_orderkey").alias("fight_id"), F.col("l_suppkey").alias("player_name"),
        "total_damage", "active_time_ms")


def combatants(t):
    return t.lineitem.select("l_orderkey", "l_suppkey").distinct().join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(
        F.col("o_custkey").alias("report_code"), F.col("l_orderkey").alias("fight_id"), F.col("l_suppkey").alias("player_name"),
        (F.col("l_suppkey") % 25).alias("source_id"))


FIGHT_SQL = """
f as (select o_custkey as report_code, o_orderkey as fight_id, o_orderkey % 7 + 600 as encounter_id, o_orderpriority as encounter_name,
             o_orderstatus <> 'P' as kill, floor(o_totalprice)::bigint * 2 as duration_ms from orders),
d as (select l_orderkey as fight_id, l_suppkey as player_name, sum(l_quantity::bigint)::bigint as total_damage,
             sum(floor(l_extendedprice * 8)::bigint)::bigint as active_time_ms from lineitem group by 1, 2),
j as (select f.*, d.player_name, d.total_damage, d.active_time_ms, d.player_name % 25 as source_id from f join d using (fight_id)),
reasons as (select *, case when not kill then 'wipe' when duration_ms < 30000 then 'short_fight'
    when encounter_id not in (601, 602) then 'movement_boss'
    when active_time_ms <> 0 and duration_ms > 0 and active_time_ms / duration_ms::double < 0.85 then 'death' end as exclusion_reason,
  case when active_time_ms > 0 then total_damage / (active_time_ms / 1000.0::double) else 0 end as active_dps from j)
"""


@query("c06_fight_join", f"with {FIGHT_SQL} select report_code, fight_id, player_name, total_damage, source_id from j")
def c06(t):
    return C.join_fights(fights(t), fight_damage(t), combatants(t)).select(
        "report_code", "fight_id", "player_name", "total_damage", "source_id")


@query("b06_fight_inclusion", f"""with {FIGHT_SQL}
select report_code, fight_id, player_name, exclusion_reason, exclusion_reason is null as included, round(active_dps, 6) as active_dps from reasons""")
def b06(t):
    got = C.annotate_fights(C.join_fights(fights(t), fight_damage(t), combatants(t)), stationary=[601, 602, 652])
    return got.select("report_code", "fight_id", "player_name", "exclusion_reason", "included", F.round("active_dps", 6).alias("active_dps"))


@query("b06_fight_whitelist", f"""with {FIGHT_SQL}
select fight_id, player_name, case when not kill then 'wipe' when duration_ms < 30000 then 'short_fight'
    when encounter_id not in (603) then 'not_in_whitelist'
    when active_time_ms <> 0 and duration_ms > 0 and active_time_ms / duration_ms::double < 0.85 then 'death' end as exclusion_reason from j""")
def b06b(t):
    got = C.annotate_fights(C.join_fights(fights(t), fight_damage(t), combatants(t)), whitelist=[603])
    return got.select("fight_id", "player_name", "exclusion_reason")


@query("b09_drop_trash", "select o_orderkey as fight_id from orders where o_orderpriority <> '1-URGENT'")
def b09(t):
    fights_ = t.orders.select(F.col("o_orderkey").alias("fight_id"), (F.ascii("o_orderpriority") - 49).alias("encounter_id"))
    return drop_trash(fights_).select("fight_id")


@query("h12_active_rate", """
select l_orderkey, l_linenumber, round(case when l_discount > 0.03 then l_quantity / (l_discount * 100.0 / 1000.0) else 0 end, 6) as rate from lineitem""")
def h12(t):
    ms = F.when(F.col("l_discount") > 0.03, F.col("l_discount") * 100.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(SC.active_rate("l_quantity", ms), 6).alias("rate"))


@query("d05_report_time_span", """
with f as (select l_orderkey as report_code, case when l_linenumber = 1 then 0 else epoch_ms(l_shipdate) end as s,
                  case when l_linenumber > 5 then 0 else epoch_ms(l_shipdate) + 1000 end as e from lineitem),
m as (select report_code, min(nullif(s, 0)) as s, max(nullif(e, 0)) as e from f group by 1)
select report_code, case when s is not null and e is not null then s end as start_ms,
       case when s is not null and e is not null then e end as end_ms from m""")
def d05(t):
    ms = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    f = t.lineitem.select(
        F.col("l_orderkey").alias("report_code"), F.when(F.col("l_linenumber") == 1, F.lit(0)).otherwise(ms).alias("start_ms"),
        F.when(F.col("l_linenumber") > 5, F.lit(0)).otherwise(ms + 1000).alias("end_ms"))
    return C.report_spans(f)


SPELLS = {1: "melee", 2: "strike", 3: "strike", 5: "stab", 8: "stab", 13: "poison"}
SPELL_CASE = "case k when 1 then 'melee' when 2 then 'strike' when 3 then 'strike' when 5 then 'stab' when 8 then 'stab' when 13 then 'poison' end"


def ability_rows(t):
    return t.events.select("event_id", "user_id", "event_type", F.from_json("props", "k int")["k"].alias("k"),
                           F.round(F.col("value") * 100).cast("bigint").alias("amount"))


@query("c09_ability_lookup", f"""
select event_id, {SPELL_CASE} as ability from (select *, json_extract(props, '$.k')::int as k from events) where {SPELL_CASE} is not null""")
def c09(t):
    return C.known_abilities(ability_rows(t), "k", SPELLS).select("event_id", "ability")


@query("c09_keep_unknown", f"""
select event_id, coalesce({SPELL_CASE}, 'unknown_' || k) as ability from (select *, json_extract(props, '$.k')::int as k from events)""")
def c09b(t):
    return ability_rows(t).select("event_id", C.name_or_unknown("k", names=SPELLS).alias("ability"))


@query("c09_unmapped_rows", f"""
select event_id, k from (select *, json_extract(props, '$.k')::int as k from events) where {SPELL_CASE} is null""")
def c09c(t):
    return C.unmapped(ability_rows(t), "k", SPELLS).select("event_id", "k")


@query("d06_ability_totals", f"""
with r as (select user_id, {SPELL_CASE} as ability, round(value * 100)::bigint as amount
           from (select *, json_extract(props, '$.k')::int as k from events)),
w as (select user_id, sum(amount)::bigint as whole from r group by 1)
select user_id, ability, sum(amount)::bigint as total, round(sum(amount) / any_value(whole)::double * 100, 6) as share_pct
from r join w using (user_id) where ability is not null group by 1, 2""")
def d06(t):
    got = C.ability_totals(ability_rows(t), ["user_id"], "k", "amount", of_all=True, names=SPELLS)
    return got.withColumn("share_pct", F.round("share_pct", 6))


@query("c08_actor_names", """
select l_orderkey, l_linenumber, coalesce(case when s_acctbal > 0 and s_suppkey <> 0 then s_name end, '') as player_name
from lineitem left join supplier on l_suppkey = s_suppkey""")
def c08(t):
    actors = t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("s_name"))
    return C.actor_names(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), actors, "l_suppkey", "s_suppkey", "s_name").select(
        "l_orderkey", "l_linenumber", "player_name")


@query("c07_gear_history", """
select o_orderkey as report_code, o_custkey as fight_id, l_linenumber, l_partkey, coalesce(epoch_ms(case when o_orderstatus <> 'P' then o_orderdate end), 0) as start_time
from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'""")
def c07(t):
    comb = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("report_code"), F.col("o_custkey").alias("fight_id"), "l_linenumber", "l_partkey")
    log = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("report_code"), F.col("o_custkey").alias("fight_id"))
    reports = t.orders.select(F.col("o_orderkey").alias("report_code"), F.unix_millis(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).cast("timestamp")).alias("start_time"))
    return C.gear_history(comb, log, reports).select("report_code", "fight_id", "l_linenumber", "l_partkey", "start_time")


@query("e02_snapshot_changes", """
with s as (select user_id, event_id, coalesce(case when event_type <> 'error' then props end, '[]') as gear from events),
p as (select *, lag(gear) over w as old_value, lag(event_id) over w as from_report from s window w as (partition by user_id order by event_id))
select user_id, from_report, event_id as to_report, old_value, gear as new_value from p where old_value is not null and old_value <> gear""")
def e02(t):
    s = t.events.select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("gear"))
    return C.snapshot_changes(s, ["user_id"], ["event_id"], balanced_block(t.events, "event_id"), "gear", "event_id")


# --- drift -------------------------------------------------------------------
def rate_pairs(t):
    """Per part and brand, priced value of open against closed line items."""
    v = F.sum(F.col("l_quantity"))
    exp = t.lineitem.where(F.col("l_linestatus") == "O").groupBy("l_partkey").agg(v.alias("expected"))
    obs = t.lineitem.where(F.col("l_linestatus") == "F").groupBy("l_partkey").agg(v.alias("observed"))
    return obs, exp


DRIFT_SQL = """
exp as (select l_partkey, sum(l_quantity) as expected from lineitem where l_linestatus = 'O' group by 1),
obs as (select l_partkey, sum(l_quantity) as observed from lineitem where l_linestatus = 'F' group by 1),
pairs as (select l_partkey, observed, coalesce(expected, 0) as expected from obs left join exp using (l_partkey)),
drifts as (select *, expected - observed as absolute_delta,
  case when observed <> 0 then (expected - observed) / observed * 100 when expected > 0 then 100.0 else 0.0 end as relative_pct from pairs)
"""


@query("c10_expected_vs_observed", f"""with {DRIFT_SQL}
select l_partkey, expected, observed, round(relative_pct, 6) as relative_pct,
  case when abs(relative_pct) <= 15 then 'pass' when abs(relative_pct) <= 30 then 'warn' else 'fail' end as status from drifts""")
def c10(t):
    return D.expected_vs_observed(*rate_pairs(t), ["l_partkey"]).select(
        "l_partkey", "expected", "observed", F.round("relative_pct", 6).alias("relative_pct"), "status")


@query("h11_compute_drift", f"""with {DRIFT_SQL}
select l_partkey, round(absolute_delta, 6) as absolute_delta, round(relative_pct, 6) as relative_pct,
  case when abs(relative_pct) <= 5 then 'pass' when abs(relative_pct) <= 10 then 'warn' else 'fail' end as status from drifts""")
def h11(t):
    obs, exp = rate_pairs(t)
    rows = obs.join(exp, "l_partkey", "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    return D.with_drift(rows).select("l_partkey", F.round("absolute_delta", 6).alias("absolute_delta"),
                                     F.round("relative_pct", 6).alias("relative_pct"), "status")


def boss_rates(t):
    obs, exp = rate_pairs(t)
    rows = obs.join(exp, "l_partkey", "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    return D.with_drift(rows.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("encounter_name")), "l_partkey"))


BOSS_SQL = DRIFT_SQL + ", rates as (select d.*, p_brand as encounter_name from drifts d join part on p_partkey = l_partkey)"
STATUS = "case when abs({0}) <= 5 then 'pass' when abs({0}) <= 10 then 'warn' else 'fail' end"


@query("d09_per_boss_report", f"""with {BOSS_SQL}
select encounter_name, count(*) as fight_count, round(avg(expected), 6) as avg_expected, round(avg(observed), 6) as avg_observed,
  round(avg(relative_pct), 6) as avg_drift_pct, {STATUS.format('avg(relative_pct)')} as status from rates group by 1""")
def d09(t):
    got = D.per_boss(boss_rates(t))
    return got.select("encounter_name", "fight_count", *[F.round(c, 6).alias(c) for c in (
        "avg_expected", "avg_observed", "avg_drift_pct")], "status")


@query("d10_overall_report", f"""with {BOSS_SQL},
c as (select count(*) as total_fights, count(*) filter (o_orderstatus <> 'P') as included_fights from orders),
o as (select coalesce(avg(relative_pct), 0) as drift from rates)
select total_fights, included_fights, total_fights - included_fights as excluded_fights, round(drift, 6) as overall_drift_pct,
  {STATUS.format('drift')} as overall_status from c, o""")
def d10(t):
    got = D.overall_report(boss_rates(t), t.orders.select((F.col("o_orderstatus") != "P").alias("included")))
    return got.withColumn("overall_drift_pct", F.round("overall_drift_pct", 6))


@query("d10_fight_status", f"""with {BOSS_SQL}
select encounter_name, case max(case when abs(relative_pct) <= 5 then 0 when abs(relative_pct) <= 10 then 1 else 2 end)
  when 0 then 'pass' when 1 then 'warn' else 'fail' end as overall_status from rates group by 1""")
def d10b(t):
    return D.fight_status(boss_rates(t), ["encounter_name"])


@query("d11_report_history", """
select o_orderkey as run_id, o_orderdate as created_at, o_totalprice as price, o_orderstatus as status
from orders order by o_orderdate desc, o_orderkey desc limit 20""")
def d11(t):
    runs = D.stored_report(t.orders.select(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
                                           "o_orderkey", "o_orderdate"), F.col("o_orderkey"), F.col("o_orderdate"))
    last = D.run_history(runs)
    got = F.from_json("report_json", "price double, status string")
    return last.select("run_id", "created_at", got["price"].alias("price"), got["status"].alias("status"))


@query("d11_report_by_id", """
select o_orderkey as run_id, o_totalprice as price, o_orderstatus as status from orders where o_orderkey = (select max(o_orderkey) from orders)""")
def d11_by_id(t):
    runs = D.stored_report(t.orders.select(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
                                           "o_orderkey", "o_orderdate"), F.col("o_orderkey"), F.col("o_orderdate"))
    return D.stored_run(runs, t.orders.agg(F.max("o_orderkey")).first()[0], "price double, status string")


@query("c11_before_after", """
with b as (select l_partkey, l_returnflag, sum(l_quantity) as before from lineitem where year(l_shipdate) = 1995 group by 1, 2),
a as (select l_partkey, l_returnflag, sum(l_quantity) as after from lineitem where year(l_shipdate) = 1996 group by 1, 2),
u as (select coalesce(b.l_partkey, a.l_partkey) as l_partkey, coalesce(b.l_returnflag, a.l_returnflag) as l_returnflag,
        coalesce(before, 0) as before, coalesce(after, 0) as after from b full join a on a.l_partkey = b.l_partkey and a.l_returnflag = b.l_returnflag)
select l_partkey, l_returnflag, before, after, after - before as delta,
  round(case when before > 0 then (after - before) / before * 100 else 0 end, 6) as delta_pct from u where abs(after - before) > 0.01""")
def c11(t):
    def year(y, name):
        return t.lineitem.where(F.year("l_shipdate") == y).groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias(name))
    got = D.before_after(year(1995, "before"), year(1996, "after"), ["l_partkey", "l_returnflag"], min_change=0.01)
    return got.withColumn("delta_pct", F.round("delta_pct", 6))


@query("j12_range_check", """
with p as (select p_brand, min(p_retailprice) + 5 as low, max(p_retailprice) - 5 as high from part group by 1)
select p_partkey, p_retailprice between low and high as in_range,
  round(case when (low + high) / 2 > 0 then (p_retailprice - (low + high) / 2) / ((low + high) / 2) * 100 else 0 end, 6) as drift_pct
from part join p using (p_brand)""")
def j12(t):
    prof = t.part.groupBy("p_brand").agg((F.min("p_retailprice") + 5).alias("low"), (F.max("p_retailprice") - 5).alias("high"))
    got = D.range_check(t.part.withColumn("value", F.col("p_retailprice")), prof, "p_brand")
    return got.select("p_partkey", "in_range", F.round("drift_pct", 6).alias("drift_pct"))


@query("h14_range_accuracy", """
with p as (select p_brand, avg(p_retailprice) - 50 as low, avg(p_retailprice) + 50 as high from part group by 1)
select p_partkey, round(case when p_retailprice between low and high then 1 else greatest(0, 1 - least(abs(p_retailprice - low), abs(p_retailprice - high))
  / ((high - low) * 0.05)) end, 6)::double as score from part join p using (p_brand)""")
def h14(t):
    prof = t.part.groupBy("p_brand").agg((F.avg("p_retailprice") - 50).alias("low"), (F.avg("p_retailprice") + 50).alias("high"))
    return t.part.join(prof, "p_brand").select("p_partkey", F.round(SC.range_accuracy("p_retailprice", "low", "high"), 6).alias("score"))


# --- statistics --------------------------------------------------------------
@query("d21_trial_statistics", """
select l_suppkey, count(*) as n, round(avg(l_extendedprice), 4) as mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) as std,
  round(median(l_extendedprice), 4) as median, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem group by 1""")
def d21(t):
    got = D.trial_statistics(t.lineitem, ["l_suppkey"], "l_extendedprice")
    return got.select("l_suppkey", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median")], "min", "max")


@query("d21_outcome_breakdown", """
with h as (select l_suppkey, l_shipdate is null as x, l_returnflag as ability, l_quantity as amount,
  case l_linenumber when 1 then 'hit' when 2 then 'tick' when 3 then 'crit' when 4 then 'miss' when 5 then 'dodge' else 'glancing' end as outcome from lineitem),
p as (select l_suppkey, ability, sum(amount) as s, count(*) as n, count(*) filter (outcome in ('hit', 'tick')) as hit, count(*) filter (outcome = 'crit') as crit,
  count(*) filter (outcome = 'miss') as miss, count(*) filter (outcome = 'dodge') as dodge, count(*) filter (outcome = 'glancing') as glancing from h group by 1, 2)
select l_suppkey, ability, round(s / 10, 6) as mean_damage, round(s / sum(s) over (partition by l_suppkey) * 100, 6) as share_pct,
  round(hit / n::double * 100, 6) as hit_pct, round(crit / n::double * 100, 6) as crit_pct, round(miss / n::double * 100, 6) as miss_pct,
  round(dodge / n::double * 100, 6) as dodge_pct, round(glancing / n::double * 100, 6) as glancing_pct from p""")
def d21b(t):
    names = {1: "hit", 2: "tick", 3: "crit", 4: "miss", 5: "dodge"}
    h = t.lineitem.select("l_suppkey", F.col("l_returnflag").alias("ability"), F.col("l_quantity").alias("amount"),
                          lookup("l_linenumber", names, "glancing").alias("outcome"))
    got = D.outcome_breakdown(h, ["l_suppkey"], F.lit(10.0))
    return got.select("l_suppkey", "ability", *[F.round(c, 6).alias(c) for c in got.columns if c not in ("l_suppkey", "ability")])


def gear_rows(t):
    return t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice"), "l_partkey").select(
        "l_orderkey", F.create_map(F.lit("agility"), F.col("p_size").cast("double"), F.lit("hit_rating"), F.col("l_quantity")).alias("stats"))


@query("d22_gear_stat_totals", """
with g as (select l_orderkey, p_size::double as a, l_quantity as h from lineitem join part on p_partkey = l_partkey),
s as (select l_orderkey, 'agility' as stat, sum(a) as total from g group by 1 union all select l_orderkey, 'hit_rating', sum(h) from g group by 1)
select l_orderkey, stat, total, stat = 'hit_rating' and total >= 142 as capped from s""")
def d22(t):
    return D.stat_totals(gear_rows(t), "l_orderkey", "stats", {"hit_rating": 142.0})


def chosen_buffs(t):
    """Parts as buffs of a config (their brand)."""
    cat = lookup("p_type", {"ECONOMY": "flask", "SMALL": "battle_elixir", "LARGE": "guardian_elixir", "MEDIUM": "shout"}, "uncategorized")
    cat = F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") < 49), F.lit("food")).otherwise(cat)
    stats = F.create_map(F.lit("attack_power"), F.col("p_size").cast("double"), F.lit("agility_pct"), F.lit(1.0),
                         F.lit("boss_armor_reduction"), (F.col("p_size") * 2).cast("double"))
    return t.part.select(F.col("p_brand").alias("config"), F.col("p_name").alias("buff_id"), cat.alias("category"), stats.alias("stats"),
                         F.col("p_partkey").alias("seq"))


BUFF_SQL = """
b as (select p_brand as config, p_partkey as seq, p_size, p_name as buff_id, case when p_type = 'ECONOMY' and p_size < 49 then 'food'
  else case p_type when 'ECONOMY' then 'flask' when 'SMALL' then 'battle_elixir' when 'LARGE' then 'guardian_elixir' when 'MEDIUM' then 'shout' else 'uncategorized' end end as category
  from part),
fl as (select config, bool_or(category = 'flask') as has_flask from b group by 1),
ok as (select b.* from b join fl using (config) where not (has_flask and category in ('battle_elixir', 'guardian_elixir'))),
win as (select * from ok where category = 'uncategorized' union all
  select * from (select * from ok where category <> 'uncategorized' qualify row_number() over (partition by config, category order by p_size desc, seq) = 1))
"""


@query("d23_buff_stacking", f"with {BUFF_SQL} select config, category, buff_id, seq from win")
def d23(t):
    return D.resolve_buffs(chosen_buffs(t), "config").select("config", "category", "buff_id", "seq")


@query("d23_buff_effects", f"""with {BUFF_SQL}
select config, 'attack_power' as stat, sum(p_size)::double as total, 'flat' as effect from win group by 1
union all select config, 'agility_pct', count(*)::double, 'multiplier' from win group by 1
union all select config, 'boss_armor_reduction', sum(p_size * 2)::double, 'armor' from win group by 1""")
def d23b(t):
    return D.buff_effects(D.resolve_buffs(chosen_buffs(t), "config"), "config")


@query("f06_candidate_prefilter", """
select p_partkey as item_id, p_brand as slot, round(p_size * 2.5 + p_retailprice * 0.1, 6) as score, rank0 from (
  select *, row_number() over (partition by p_brand order by round(p_size * 2.5 + p_retailprice * 0.1, 6) desc, p_partkey) - 1 as rank0 from part) where rank0 < 20""")
def f06(t):
    stats = F.create_map(F.lit("agility"), F.col("p_size").cast("double"), F.lit("crit_rating"), F.col("p_retailprice"), F.lit("armor"), F.lit(9.0))
    items = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("slot"), stats.alias("stats"))
    got = D.weighted_candidates(items, {"agility": 2.5, "crit_rating": 0.1}, "stats")
    return got.select("item_id", "slot", "score", F.col("rank0").cast("bigint").alias("rank0"))


@query("f07_recommendations", """
with base as (select p_brand, min(p_partkey) as cur from part group by 1),
b as (select base.p_brand, cur, p_retailprice as v from base join part on p_partkey = cur),
c as (select p.p_brand, p.p_partkey as item_id, round(p.p_retailprice - b.v, 6) as delta from part p join b using (p_brand) where p.p_partkey <> cur)
select p_brand, item_id, delta, position from (
  select *, row_number() over (partition by p_brand order by delta desc, item_id) - 1 as position from c) where position < 5""")
def f07(t):
    cand = t.part.select("p_brand", F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("v"))
    base = cand.groupBy("p_brand").agg(F.min_by(F.struct("item_id", "v"), "item_id").alias("b")).select(
        "p_brand", F.col("b.item_id").alias("item_id"), F.col("b.v").alias("v"))
    got = D.recommend(cand, base, "p_brand", "item_id", "v")
    return got.select("p_brand", "item_id", "delta", F.col("position").cast("bigint").alias("position"))


@query("f08_stat_weights", """
with r as (select l_suppkey, case l_linenumber when 1 then 'base' when 2 then 'attack_power' else 'stat' || l_linenumber end as stat,
             avg(l_extendedprice) as v from lineitem group by 1, 2),
w as (select r.l_suppkey, r.stat, (r.v - b.v) / 80 as weight from r join r b on b.l_suppkey = r.l_suppkey and b.stat = 'base' where r.stat <> 'base')
select w.l_suppkey, w.stat, round(w.weight, 4) as weight, round(case when a.weight > 0 then w.weight / a.weight else w.weight end, 3) as normalized
from w left join w a on a.l_suppkey = w.l_suppkey and a.stat = 'attack_power'""")
def f08(t):
    stat = lookup("l_linenumber", {1: "base", 2: "attack_power"}, F.concat(F.lit("stat"), F.col("l_linenumber").cast("string")))
    r = t.lineitem.groupBy("l_suppkey", stat.alias("stat")).agg(F.avg("l_extendedprice").alias("value")).withColumn("delta", F.lit(80))
    got = D.stat_weights(r, "l_suppkey")
    return got.select("l_suppkey", "stat", F.round("weight", 4).alias("weight"), F.round("normalized", 3).alias("normalized"))


@query("j09_unbuffed_stats", """
with c as (select l_orderkey, l_linenumber, l_suppkey % 4 as a, l_quantity * 10 as agi, 120 + l_quantity as hit, l_returnflag as f from lineitem)
select l_orderkey, l_linenumber, round(greatest(0, case when a = 1 then agi / 1.1 else agi end - 180 - case when a = 2 then 77 else 0 end), 6) as agility,
  round(greatest(0, hit - case when a = 3 then 20 else 0 end), 6) as hit, case a when 1 then 'kings' when 2 then 'grace_of_air' when 3 then 'heroism' else '' end as buffs,
  case when f = 'A' then '41/20/0' else '20/41/0' end as talents from c""")
def j09(t):
    a = F.col("l_suppkey") % 4
    aura = lookup(a.cast("int"), {1: 25898, 2: 25359, 3: 32182}, 4)
    zero = F.lit(0.0)
    c = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.array(aura, aura, F.lit(99)).alias("auras"), (F.col("l_quantity") * 10).alias("agility"),
        (F.col("l_quantity") + 120).alias("hit_rating"), zero.alias("strength"), zero.alias("stamina"), zero.alias("crit_rating"),
        zero.alias("haste_rating"), zero.alias("expertise_rating"),
        F.when(F.col("l_returnflag") == "A", 259).when(F.col("l_returnflag") == "N", 0).otherwise(777).alias("spec_id"), F.lit(61500).alias("duration_ms"))
    got = C.unbuffed_stats(c, {"grace_of_air": {"agility": 77.0}, "heroism": {"hit_rating": 20.0, "attack_power": 5.0}})
    return got.select("l_orderkey", "l_linenumber", F.round("gear_agility", 6).alias("agility"), F.round("gear_hit_rating", 6).alias("hit"),
                      F.array_join("buffs", ",").alias("buffs"), "talents")
