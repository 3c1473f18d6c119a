"""Combat-log text: lines to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators.combat import name_or_unknown
from tidewell.plans.spread import spread

# --- fixed values: line format and field positions ---------------------------
KINDS = {
    "ENCOUNTER_START": "start", "ENCOUNTER_END": "end",
    "SWING_DAMAGE": "damage", "SPELL_DAMAGE": "damage", "SPELL_PERIODIC_DAMAGE": "damage",
    "SPELL_CAST_SUCCESS": "cast", "SPELL_AURA_APPLIED": "aura_on", "SPELL_AURA_REMOVED": "aura_off",
}
LINE = r"^(\d+/\d+\s+\d+:\d+:\d+\.\d+)\s{2}(.+)"
SOURCE_NAME, DEST_NAME, SPELL_ID, SWING_AMOUNT, SPELL_AMOUNT = 2, 6, 9, 11, 14


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``log_id, seq, line`` of log files, one log per file.

    ``seq`` is (byte offset of the file split, row number in the task), which
    orders the lines of a file; the split is the block of ordered windows.
    """
    raw = spark.read.text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("log_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"),
        F.col("value").alias("line"),
    )


def file_block() -> Column:
    """Block column for rows of :func:`read_logs`."""
    return F.col("seq.block")


def parse_lines(lines: DataFrame, *, compat: bool = False) -> DataFrame:
    """Typed events out of ``log_id, seq, line``; other lines are dropped.

    ``compat`` keeps only the time of day, as the original does, which makes an
    encounter across midnight negative; the default counts days too.
    """
    line = F.btrim("line", F.lit(X.SPACES))
    cut = spread(lines, "seq").select(
        "log_id", "seq", F.regexp_extract(line, LINE, 1).alias("_t"), F.regexp_extract(line, LINE, 2).alias("_p"))
    # The kind is read off the head of the payload, so that other lines are dropped
    # before their fields are cut.
    head = F.btrim(F.replace(F.substring_index("_p", ",", 1), F.lit('"'), F.lit("")), F.lit(X.SPACES))
    kept = cut.where(F.col("_t") != "").withColumn("event", head).withColumn("kind", X.lookup("event", KINDS)).where(
        F.col("kind").isNotNull())
    fields = kept.select("log_id", "seq", (X.log_time_ms("_t") if compat else X.log_order_ms("_t")).alias("ts_ms"), "event", "kind",
                         X.quoted_fields("_p").alias("f"))
    f, kind = F.col("f"), F.col("kind")
    marker, aura = kind.isin("start", "end"), kind.isin("aura_on", "aura_off")
    spell = X.safe_int(f, SPELL_ID)
    swing = F.col("event") == "SWING_DAMAGE"
    row = F.struct(
        F.when(kind == "start", X.safe_int(f, 1)).alias("enc_id"),
        F.when(kind == "start", X.field_or(f, 2, "Unknown")).alias("enc_name"),
        F.when(marker, F.lit(None)).when(swing, "melee").when(aura, name_or_unknown(spell, "buff_")).otherwise(name_or_unknown(spell)).alias("ability"),
        F.when(kind == "damage", F.when(swing, X.safe_int(f, SWING_AMOUNT)).otherwise(X.safe_int(f, SPELL_AMOUNT))).alias("amount"),
        F.when(aura, X.field_or(f, DEST_NAME)).when(~marker, X.field_or(f, SOURCE_NAME)).alias("actor"),
    )
    # A generator, not a filter: a filter on the fields would cut them a second time.
    return fields.select("log_id", "seq", "ts_ms", "kind", F.inline(F.when(marker | (F.size(f) >= 4), F.array(row))))


def for_character(events: DataFrame, name: str) -> DataFrame:
    """Markers, and the events of one character (source of damage and casts, target of auras)."""
    return events.where(F.col("kind").isin("start", "end") | (F.col("actor") == name))
