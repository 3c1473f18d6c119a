"""Character exports of three formats, one export text per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.text import SPACES, digit_sums, is_blank, lookup, spec_from_digits

# --- fixed values: race and build names of the formats -----------------------
RACES = {
    "orc": "orc", "human": "human", "night_elf": "night_elf", "nightelf": "night_elf", "blood_elf": "blood_elf",
    "bloodelf": "blood_elf", "undead": "undead", "dwarf": "dwarf", "gnome": "gnome", "troll": "troll",
}
NUMBERED_RACES = {1: "human", 2: "orc", 3: "dwarf", 4: "night_elf", 7: "gnome", 8: "troll", 10: "blood_elf", 11: "undead"}
BUILDS = {
    "combat": "combat_swords", "combat_swords": "combat_swords", "combat_fists": "combat_fists",
    "combat_daggers": "combat_daggers", "assassination": "assassination_mutilate",
    "assassination_mutilate": "assassination_mutilate", "mutilate": "assassination_mutilate",
}
GEAR = "array<struct<slot:string,item_id:bigint,enchant:bigint,gems:array<bigint>>>"
LISTED = "struct<race:string,spec:string,talents:string,items:array<struct<slot:string,id:bigint>>>"
NUMBERED = ("struct<player:struct<race:int,talentsString:string,equipment:struct<items:array<"
            "struct<id:bigint,enchant:bigint,gems:array<bigint>>>>>>")


def export_format(raw: Column | str) -> Column:
    """``key_value``, ``listed`` (JSON) or ``numbered`` (JSON with a player; anything else as well)."""
    x = F.btrim(F.col(raw) if isinstance(raw, str) else raw, F.lit(SPACES))
    first = F.substring_index(x, "\n", 1)
    has_player = F.coalesce(F.array_contains(F.json_object_keys(x), "player"), F.lit(False))
    return (
        F.when(is_blank(x), "numbered")
        .when(first.startswith("{") & has_player, "numbered")
        .when(first.startswith("{") | first.startswith("["), "listed")
        .when(first.rlike(r"^[a-zA-Z_]\w*=.+"), "key_value")
        .otherwise("numbered")
    )


def _key_value(raw: Column) -> Column:
    lines = F.transform(F.filter(F.split(raw, "\n"), lambda s: F.contains(s, F.lit("="))), lambda s: F.struct(
        F.btrim(F.substring_index(s, "=", 1), F.lit(SPACES)).alias("k"), F.btrim(F.regexp_replace(s, "^[^=]*=", ""), F.lit(SPACES)).alias("v")))
    last = lambda key: F.element_at(F.transform(F.filter(lines, lambda p: p["k"] == key), lambda p: F.replace(p["v"], F.lit('"'), F.lit(""))), -1)
    value = lambda key: F.when(F.exists(lines, lambda p: p["k"] == key), last(key))
    gear = F.filter(F.transform(lines, lambda p: F.struct(
        lookup(p["k"], fixed.KEY_VALUE_SLOTS).alias("slot"), F.regexp_extract(p["v"], r"id=(\d+)", 1).try_cast("bigint").alias("item_id"),
        F.lit(None).cast("bigint").alias("enchant"), F.lit(None).cast("array<bigint>").alias("gems"))),
        lambda g: g["slot"].isNotNull() & g["item_id"].isNotNull())
    race, spec = F.lower(value("race")), F.lower(value("spec"))
    return F.struct(lookup(race, RACES).alias("race"), lookup(spec, BUILDS).alias("spec"), F.nullif(value("talents"), F.lit("")).alias("talents"),
                    gear.cast(GEAR).alias("gear"), (race.isNotNull() & lookup(race, RACES).isNull()).alias("bad_race"),
                    (spec.isNotNull() & lookup(spec, BUILDS).isNull()).alias("bad_spec"), F.lit(False).alias("bad_json"))


def _listed(raw: Column) -> Column:
    d = F.from_json(raw, LISTED)
    key = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("_"))
    race, spec = lookup(key(d["race"]), RACES), lookup(key(d["spec"]), BUILDS)
    gear = F.filter(F.transform(d["items"], lambda i: F.struct(
        lookup(i["slot"], fixed.TITLED_SLOTS).alias("slot"), i["id"].alias("item_id"), F.lit(None).cast("bigint").alias("enchant"),
        F.lit(None).cast("array<bigint>").alias("gems"))), lambda g: g["slot"].isNotNull() & g["item_id"].isNotNull())
    return F.struct(race.alias("race"), spec.alias("spec"), F.nullif(d["talents"], F.lit("")).alias("talents"),
                    F.coalesce(gear, F.array()).cast(GEAR).alias("gear"), race.isNull().alias("bad_race"), spec.isNull().alias("bad_spec"),
                    F.json_object_keys(raw).isNull().alias("bad_json"))


def _numbered(raw: Column) -> Column:
    p = F.from_json(raw, NUMBERED)["player"]
    talents = F.coalesce(p["talentsString"], F.lit(""))
    items = F.transform(p["equipment"]["items"], lambda i, n: F.struct(
        lookup(n, fixed.NUMBERED_SLOTS).alias("slot"), F.nullif(i["id"], F.lit(0)).alias("item_id"), F.nullif(i["enchant"], F.lit(0)).alias("enchant"),
        F.when(F.size(i["gems"]) > 0, i["gems"]).alias("gems")))
    gear = F.filter(items, lambda g: g["slot"].isNotNull() & g["item_id"].isNotNull())
    return F.struct(lookup(F.coalesce(p["race"], F.lit(1)), NUMBERED_RACES, "human").alias("race"), spec_from_digits(talents).alias("spec"),
                    F.array_join(F.transform(digit_sums(talents), lambda s: s.cast("string")), "/").alias("talents"),
                    F.coalesce(gear, F.array()).cast(GEAR).alias("gear"), F.lit(False).alias("bad_race"), F.lit(False).alias("bad_spec"),
                    p.isNull().alias("bad_json"))


def parse_exports(exports: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, format, race, spec, talents, gear, reject_reason`` for every export.

    A rejected export keeps its row, with the reason and without data.
    """
    raw = F.btrim(F.col(text_col), F.lit(SPACES))
    fmt = export_format(raw)
    parsed = F.when(fmt == "key_value", _key_value(raw)).when(fmt == "listed", _listed(raw)).otherwise(_numbered(raw))
    rows = exports.select(F.col(id_col), fmt.alias("format"), parsed.alias("c")).withColumn("gear", F.col("c.gear"))
    # A slot that is named twice holds what was named last.
    rows = rows.withColumn("gear", F.filter("gear", lambda g, i: ~F.exists(
        F.slice("gear", i + 2, F.size("gear")), lambda later: later["slot"] == g["slot"])))
    reason = (
        F.when(F.col("c.bad_json"), "invalid json").when(F.col("c.bad_race"), "unknown race").when(F.col("c.bad_spec"), "unknown spec")
        .when(F.col("c.spec").isNull(), "missing spec").when(F.col("c.race").isNull(), "missing race")
        .when(F.col("c.talents").isNull(), "missing talents")
    )
    out = rows.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    return out.select(id_col, "format", *[F.when(good, F.col(f"c.{x}")).alias(x) for x in ("race", "spec", "talents")],
                      F.when(good, F.col("gear")).alias("gear"), "reject_reason")
