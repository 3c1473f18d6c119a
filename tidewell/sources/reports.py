"""Report JSON: nested API answers to flat tables.

One row per answer in, six child tables out. Missing lists count as empty and
missing scalars get their default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans import snapshots
from tidewell.plans.segments import Segments, last_of

# --- fixed values: fields of the answers -------------------------------------
ABILITY = "struct<guid:bigint,name:string,total:bigint>"
COMBATANT_STATS = {
    "strength": "strength", "agility": "agility", "stamina": "stamina", "intellect": "intellect", "spirit": "spirit",
    "crit_melee": "critMelee", "crit_ranged": "critRanged", "crit_spell": "critSpell",
    "haste_melee": "hasteMelee", "haste_ranged": "hasteRanged", "haste_spell": "hasteSpell",
    "hit_melee": "hitMelee", "hit_ranged": "hitRanged", "hit_spell": "hitSpell",
    "expertise": "expertise", "dodge": "dodge", "parry": "parry", "block": "block", "armor": "armor",
}
COMBATANT_LISTS = {
    "gear": "array<struct<id:bigint,slot:int,itemLevel:int>>",
    "talents": "array<struct<id:bigint,icon:string>>",
    "auras": "array<struct<source:bigint,ability:bigint,stacks:int,name:string>>",
}
COMBATANT = (
    "struct<fight:bigint,sourceID:bigint,specID:int,faction:int," + ",".join(f"{j}:bigint" for j in COMBATANT_STATS.values())
    + "," + ",".join(f"{c}:{t}" for c, t in COMBATANT_LISTS.items()) + ">"
)
TABLE_ENTRY = (f"struct<name:string,type:string,total:bigint,activeTime:bigint,abilities:array<{ABILITY}>,"
               "targets:array<struct<name:string,type:string,total:bigint>>>")
AURA = "struct<name:string,guid:bigint,totalUptime:bigint,totalUses:bigint,bands:array<struct<startTime:bigint,endTime:bigint>>>"
RANKED = "struct<name:string,server:string,class:string,spec:string,amount:double,rankPercent:double,totalParses:bigint>"
REPORT = (
    "code string, archived boolean, title string, zone struct<id:int,name:string>, "
    "fights array<struct<id:bigint,encounterID:bigint,name:string,kill:boolean,startTime:bigint,endTime:bigint,"
    "bossPercentage:double,averageItemLevel:double,size:int,difficulty:int>>, "
    "actors array<struct<id:bigint,name:string>>, "
    f"combatants array<{COMBATANT}>, "
    f"damage array<struct<fight:bigint,entries:array<{TABLE_ENTRY}>>>, "
    f"buffs array<struct<fight:bigint,auras:array<{AURA}>>>, "
    f"casts array<struct<fight:bigint,entries:array<{TABLE_ENTRY}>>>, "
    f"rankings array<struct<fightID:bigint,encounterID:bigint,roles:map<string,struct<characters:array<{RANKED}>>>>>"
)
RANKING_ROW = (
    "struct<name:string,spec:string,amount:double,duration:bigint,faction:int,size:int,bracketData:double,"
    "report:struct<code:string,fightID:bigint>,server:struct<name:string,region:string>,guild:struct<name:string>>"
)
RANKINGS = f"zone_id int, encounter_id bigint, encounter_name string, rankings array<{RANKING_ROW}>"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports as JSON lines; ``unread`` holds a line that could not be read (see ``report_rejects``)."""
    return spark.read.schema(REPORT + ", unread string").json(path, columnNameOfCorruptRecord="unread")


def parse_reports(raw: DataFrame, text_col: str) -> DataFrame:
    """Reports out of a JSON text column; ``unread`` as in ``read_reports``."""
    read = F.from_json(text_col, REPORT + ", unread string", {"columnNameOfCorruptRecord": "unread"})
    return raw.select(read.alias("r")).select("r.*")


def report_rejects(reports: DataFrame) -> DataFrame:
    """Lines without a report: ``unread, reject_reason``. They give no rows in the tables below."""
    reason = F.when(F.col("unread").isNotNull(), "unreadable").when(F.col("code").isNull(), "no code")
    return reports.select("unread", reason.alias("reject_reason")).where(F.col("reject_reason").isNotNull())


def _or(col: str, default) -> Column:
    return F.coalesce(F.col(col), F.lit(default)).alias(col.split(".")[-1])


def report_rows(reports: DataFrame) -> DataFrame:
    """One row per report with its time span and archive flag."""
    starts = F.filter(F.transform("fights", lambda f: f["startTime"]), lambda x: F.coalesce(x, F.lit(0)) != 0)
    ends = F.filter(F.transform("fights", lambda f: f["endTime"]), lambda x: F.coalesce(x, F.lit(0)) != 0)
    both = (F.size(starts) > 0) & (F.size(ends) > 0)
    return reports.where(F.col("code").isNotNull()).select(
        F.col("code").alias("report_code"), F.nullif("title", F.lit("")).alias("title"), F.col("zone.id").alias("zone_id"),
        F.nullif("zone.name", F.lit("")).alias("zone_name"), F.when(both, F.array_min(starts)).alias("start_time"),
        F.when(both, F.array_max(ends)).alias("end_time"), _or("archived", False).alias("is_archived"))


def _live(reports: DataFrame) -> DataFrame:
    return reports.where(~F.coalesce("archived", F.lit(False)))


def fight_rows(reports: DataFrame) -> DataFrame:
    """Boss fights; trash (no encounter) is left out."""
    f = _live(reports).select(F.col("code").alias("report_code"), F.explode("fights").alias("f"))
    return f.where(F.coalesce("f.encounterID", F.lit(0)) != 0).select(
        "report_code", F.col("f.id").alias("fight_id"), F.col("f.encounterID").alias("encounter_id"),
        F.coalesce("f.name", F.lit("")).alias("encounter_name"), F.coalesce("f.kill", F.lit(False)).alias("kill"),
        (F.coalesce("f.endTime", F.lit(0)) - F.coalesce("f.startTime", F.lit(0))).alias("duration_ms"),
        F.col("f.bossPercentage").alias("boss_percentage"), F.col("f.averageItemLevel").alias("avg_item_level"),
        F.col("f.size").alias("raid_size"), F.col("f.difficulty").alias("difficulty"))


def combatant_rows(reports: DataFrame) -> DataFrame:
    """Combatants with their name; an event without fight belongs to the first boss fight."""
    named = F.filter("actors", lambda a: (F.coalesce(a["id"], F.lit(0)) != 0) & (F.coalesce(a["name"], F.lit("")) != ""))
    bosses = F.filter("fights", lambda f: F.coalesce(f["encounterID"], F.lit(0)) != 0)
    e = _live(reports).where(F.size(bosses) > 0).select(
        F.col("code").alias("report_code"), F.get(bosses, F.lit(0))["id"].alias("_first"),
        F.map_from_entries(F.transform(named, lambda a: F.struct(a["id"], a["name"]))).alias("_names"),
        F.explode("combatants").alias("e"))
    source = F.coalesce("e.sourceID", F.lit(0))
    return e.select(
        "report_code", F.coalesce("e.fight", "_first").alias("fight_id"), source.alias("source_id"),
        F.coalesce(F.try_element_at("_names", source), F.lit("")).alias("player_name"), F.col("e.specID").alias("spec_id"),
        F.col("e.faction").alias("faction"), *[F.col(f"e.{j}").alias(c) for c, j in COMBATANT_STATS.items()],
        *[F.coalesce(F.col(f"e.{c}"), F.array().cast(t)).alias(c) for c, t in COMBATANT_LISTS.items()])


def damage_rows(reports: DataFrame) -> DataFrame:
    e = _live(reports).select(F.col("code").alias("report_code"), F.explode("damage").alias("d")).select(
        "report_code", F.col("d.fight").alias("fight_id"), F.explode("d.entries").alias("e"))
    return e.select(
        "report_code", "fight_id", F.coalesce("e.name", F.lit("")).alias("player_name"), F.col("e.type").alias("player_type"),
        F.coalesce("e.total", F.lit(0)).alias("total_damage"), F.col("e.activeTime").alias("active_time_ms"),
        F.col("e.abilities").alias("abilities"), F.col("e.targets").alias("targets"))


def buff_rows(reports: DataFrame) -> DataFrame:
    """Auras per fight; they are not told apart by player."""
    a = _live(reports).select(F.col("code").alias("report_code"), F.explode("buffs").alias("b")).select(
        "report_code", F.col("b.fight").alias("fight_id"), F.explode("b.auras").alias("a"))
    return a.select(
        "report_code", "fight_id", F.coalesce("a.name", F.lit("")).alias("buff_name"), F.coalesce("a.guid", F.lit(0)).alias("buff_guid"),
        F.coalesce("a.totalUptime", F.lit(0)).alias("total_uptime_ms"), F.coalesce("a.totalUses", F.lit(0)).alias("total_uses"),
        F.col("a.bands").alias("bands"))


def cast_rows(reports: DataFrame) -> DataFrame:
    e = _live(reports).select(F.col("code").alias("report_code"), F.explode("casts").alias("d")).select(
        "report_code", F.col("d.fight").alias("fight_id"), F.explode("d.entries").alias("e")).select(
        "report_code", "fight_id", F.col("e.name").alias("player_name"), F.explode("e.abilities").alias("a"))
    return e.select("report_code", "fight_id", F.coalesce("player_name", F.lit("")).alias("player_name"),
                    F.coalesce("a.name", F.lit("")).alias("ability_name"), F.coalesce("a.total", F.lit(0)).alias("cast_count"))


def fight_ranking_rows(reports: DataFrame) -> DataFrame:
    """Rankings over all roles; the server is a name or an object with a name."""
    c = _live(reports).select(F.col("code").alias("report_code"), F.explode("rankings").alias("k")).select(
        "report_code", F.coalesce("k.fightID", F.lit(0)).alias("fight_id"), F.coalesce("k.encounterID", F.lit(0)).alias("encounter_id"),
        F.explode(F.map_values("k.roles")).alias("role")).select("report_code", "fight_id", "encounter_id", F.explode("role.characters").alias("c"))
    server = F.when(F.startswith("c.server", F.lit("{")), F.get_json_object("c.server", "$.name")).otherwise(F.col("c.server"))
    return c.select(
        "report_code", "fight_id", "encounter_id", F.coalesce("c.name", F.lit("")).alias("player_name"), server.alias("server_name"),
        F.coalesce("c.class", F.lit("")).alias("class"), F.col("c.spec").alias("spec"), F.coalesce("c.amount", F.lit(0.0)).alias("dps"),
        F.col("c.rankPercent").alias("rank_percent"), F.col("c.totalParses").alias("total_parses"))


def ranking_rows(answers: DataFrame) -> DataFrame:
    """Encounter rankings (all pages given) as flat rows."""
    r = answers.select("zone_id", "encounter_id", "encounter_name", F.explode("rankings").alias("r"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return r.select(
        "zone_id", "encounter_id", "encounter_name", text("r.name").alias("player_name"), text("r.spec").alias("spec"),
        F.coalesce("r.amount", F.lit(0.0)).alias("dps"), F.coalesce("r.duration", F.lit(0)).alias("duration_ms"),
        text("r.report.code").alias("report_code"), F.coalesce("r.report.fightID", F.lit(0)).alias("fight_id"),
        F.col("r.guild.name").alias("guild_name"), text("r.server.name").alias("server_name"), text("r.server.region").alias("server_region"),
        F.col("r.faction").alias("faction"), F.col("r.size").alias("raid_size"), F.col("r.bracketData").alias("bracket_data"))


def of_encounter(encounters: DataFrame, encounter_id: int | None = None) -> DataFrame:
    """One encounter of a zone, or all of them."""
    return encounters if encounter_id is None else encounters.where(F.col("encounter_id") == encounter_id)


def report_codes(rankings: DataFrame) -> DataFrame:
    """Distinct non-empty report codes over all encounters."""
    return rankings.where(F.col("report_code") != "").select("report_code").distinct()


# --- fixed values: natural keys of the child tables
KEYS = {
    "rankings": ["encounter_id", "player_name", "server_name", "report_code"],
    "fights": ["report_code", "fight_id"],
    "combatants": ["report_code", "fight_id", "source_id"],
    "damage": ["report_code", "fight_id", "player_name"],
    "buffs": ["report_code", "fight_id", "buff_guid"],
    "casts": ["report_code", "fight_id", "player_name", "ability_name"],
    "fight_rankings": ["report_code", "fight_id", "player_name"],
}


# --- stored tables -----------------------------------------------------------
#: Parts of a table's keys, of each of which a change keeps a print of the rows that it was given.
PRINT_PARTS = 1024
PRINT = ["n", "low", "high"]


def _part(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PRINT_PARTS)).cast("int")


def _prints(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, part, n, low, high``: number and summed digests (in halves, so that no sum overflows) of the rows of each part."""
    digest = F.col("digest")
    found = [rows.select(F.lit(name).alias("table_name"), _part(KEYS[name]).alias("part"), F.xxhash64(*_key_first(name, rows)).alias("digest"))
             .groupBy("table_name", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(digest.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("low"),
                                                F.sum(F.shiftright(digest, 32)).alias("high")) for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, found)


def _key_first(name: str, rows: DataFrame) -> list[str]:
    return [*KEYS[name], *[c for c in rows.columns if c not in KEYS[name]]]


def _open_parts(store: Segments, tables: dict[str, DataFrame], version: int) -> dict[str, list[int]]:
    """Of each table the parts whose rows are not those that the last change with rows in them brought: a repeated part changes nothing."""
    root = f"{store.root}/prints"
    snapshots.write_version(_prints(tables).coalesce(1), root, version)
    given, earlier = store.spark.read.parquet(f"{root}/v{version}"), [v for v in store.versions() if v < version]
    if earlier:
        held = reduce(DataFrame.unionByName, [store.spark.read.parquet(f"{root}/v{v}").withColumn("segment", F.lit(v)) for v in earlier])
        given = given.join(last_of(held, ["table_name", "part"]), ["table_name", "part", *PRINT], "left_anti")
    found = given.select("table_name", "part").collect()  # at most PRINT_PARTS a table
    return {name: sorted(r["part"] for r in found if r["table_name"] == name) for name in tables}


def store_tables(store: Segments, tables: dict[str, DataFrame], version: int) -> bool:
    """Writes flattened tables (names of ``KEYS``) into their stored ones, as change ``version`` of all of them.

    A row replaces the one with its natural key; of rows with one key in a batch the greatest counts.
    Only rows that are new or differ are written, so a report that is read twice changes nothing,
    and no earlier file is touched. Parts of the keys whose rows come again as they came last are
    known by their prints and not moved. Says whether the change was applied now.
    """
    if version in store.versions():
        return False
    written, parts = [], _open_parts(store, tables, version)
    for name, rows in tables.items():
        keys, rest = KEYS[name], [c for c in rows.columns if c not in KEYS[name]]
        stored = T.StructType([*rows.schema.fields, T.StructField("digest", T.LongType())])
        met_parts = F.lit(True) if len(parts[name]) == PRINT_PARTS else F.array_contains(F.array(*map(F.lit, parts[name])).cast("array<int>"), _part(keys))
        fresh = rows.where(met_parts).select(*keys, F.struct(*rest).alias("row"), F.lit(None).cast("long").alias("digest"), F.lit(None).cast("int").alias("segment"))
        # Of what is stored the digests alone are read; they meet the new rows in the exchange that those need anyway.
        known = store.read(name, stored, below=version).where(met_parts).select(*keys, F.lit(None).cast(fresh.schema["row"].dataType).alias("row"), "digest", "segment")
        met = fresh.unionByName(known).groupBy(*keys).agg(F.max("row").alias("row"), F.max_by("digest", "segment").alias("known_digest"))
        last = met.where(F.col("row").isNotNull()).select(*keys, *[F.col("row")[c].alias(c) for c in rest], "known_digest")
        digested = last.withColumn("digest", F.xxhash64(*keys, *rest))
        changed = digested.where(~F.col("digest").eqNullSafe(F.col("known_digest"))).select(*keys, *rest, "digest")
        written.append(store.write(changed, name, version).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n"))
    store.commit(version, reduce(DataFrame.unionByName, written))
    return True


def stored_table(store: Segments, name: str) -> DataFrame:
    """The rows of one stored table as they were last written."""
    rows = store.read(name)
    held = [r["segment"] for r in store.notes().where((F.col("table_name") == name) & (F.col("n") > 0)).select("segment").collect()]  # one for a change
    # A key stands once in a segment, so that rows of a single one need not meet.
    return (rows.where(F.col("segment").isin(held)).drop("segment") if len(held) < 2 else last_of(rows, KEYS[name])).drop("digest")
