"""Streaming jobs.

State lives in Spark's state store, or in versioned tables below a root folder, one version per
micro-batch. A repeated micro-batch reads the version before it and writes its own version
again, so every batch counts exactly once, also after a lost executor or a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators import combat
from tidewell.operators.library import Library, ingest_pages
from tidewell.plans import snapshots
from tidewell.plans.merge import last_write_wins
from tidewell.plans.segments import Segments, last_of


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream; the schema is taken from it."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    if snapshots.is_file(spark, path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], root: str, *, available_now: bool = True) -> StreamingQuery:
    """Run ``step(batch, number)`` per micro-batch with checkpoints below ``root``."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_end(stream: DataFrame, step: Callable[[DataFrame, int], None], root: str) -> None:
    """Process everything there is and stop."""
    query = run_batches(stream, step, root)
    query.awaitTermination()


# --- encounters --------------------------------------------------------------
ENCOUNTER = ["log_id", "enc_seq"]


def encounter_step(spark: SparkSession, root: str, block: Callable[[], Column], expire_ms: int | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batch step: completed encounters out, the sums of open ones kept.

    The state of a log is its open start marker and one row of sums for each ability met since, so
    an encounter that never ends grows no larger than its abilities. The marker joins the next
    batch as its first row; a batch is cut into encounters by the blocked windows of the batch
    form, so a log of any size is dealt over tasks, which keyed state would not do. Rows of a
    batch of one log must not be older than those of the batch before. With ``expire_ms``, an
    encounter that began so long before the latest row of a batch is given up.
    """

    def step(batch: DataFrame, number: int) -> None:
        opened = snapshots.read_latest(spark, f"{root}/open", below=number)
        before = snapshots.read_latest(spark, f"{root}/sums", below=number)
        rows = batch if opened is None else batch.unionByName(opened, allowMissingColumns=True)
        marked = combat.with_markers(rows, block()).persist()
        after = ~F.col("kind").isin(combat.START, combat.END) & (F.col("_prev.k") == combat.START)
        acting = marked.where(after & (F.col("_next").isNull() | (F.col("_next.k") == combat.END)))
        sums = combat.ability_sums(acting.withColumn("enc_seq", F.col("_prev.s")), ENCOUNTER)
        if before is not None:
            sums = sums.unionByName(before).groupBy(*ENCOUNTER, "ability").agg(*[F.sum(c).alias(c) for c in ("damage", "hits", "casts")])
        # What neither ended nor is still open was dropped by a new start, and its sums go with it.
        done = combat.completed_encounters(marked)
        still = marked.where(F.col("_next").isNull() & (F.col("kind") == combat.START)).drop("_prev", "_next")
        if expire_ms is not None:
            latest = batch.agg(F.max("ts_ms")).first()[0]
            still = still.where(F.col("ts_ms") >= (latest if latest is not None else 0) - expire_ms)
        snapshots.write_version(still, f"{root}/open", number)
        ended = sums.join(done.select(*ENCOUNTER), ENCOUNTER, "left_semi").persist()
        damage = ended.groupBy(*ENCOUNTER).agg(F.sum("damage").alias("total_damage"))
        snapshots.write_version(combat.totals_of(done, damage).select(*ENCOUNTER, "duration_ms", "total_damage", "dps"), f"{root}/totals", number)
        snapshots.write_version(combat.breakdown_of(ended, ENCOUNTER), f"{root}/abilities", number)
        kept = snapshots.read_latest(spark, f"{root}/open", below=number + 1).select("log_id", F.col("seq").alias("enc_seq"))
        snapshots.write_version(sums.join(kept, ENCOUNTER, "left_semi"), f"{root}/sums", number)
        for table in ("open", "sums"):
            snapshots.prune_versions(spark, f"{root}/{table}")
        marked.unpersist()
        ended.unpersist()

    return step


def stream_encounters(spark: SparkSession, events: DataFrame, root: str, block: Callable[[], Column]) -> tuple[DataFrame, DataFrame]:
    """Encounter totals and ability breakdown of a stream of log events."""
    run_to_end(events, encounter_step(spark, root, block), root)
    return all_versions(spark, f"{root}/totals"), all_versions(spark, f"{root}/abilities")


def all_versions(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every finished version."""
    return spark.read.parquet(*[f"{root}/v{v}" for v in snapshots.complete_versions(spark, root)])


# --- ingest ------------------------------------------------------------------
def ingest_step(library: Library, now: Callable[[DataFrame], Column], intervals: dict[str, int] | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batch step: arriving pages go into a library as one change; only changed rows are written.

    Within a batch the last page of a URL by ``seq`` counts; later batches come later. A repeated
    batch has the number of its change, and is not applied again.
    """

    def step(batch: DataFrame, number: int) -> None:
        ingest_pages(library, last_write_wins(batch, ["url"], F.col("seq")).drop("seq"), number + 1, now(batch), intervals=intervals)

    return step


# --- running aggregates ------------------------------------------------------
def running_step(spark: SparkSession, root: str, partial: Callable[[DataFrame], DataFrame], keys: list[str],
                 merge: Callable[[], list[Column]]) -> Callable[[DataFrame, int], None]:
    """Micro-batch step that folds the batch's partial aggregate into the running one.

    ``partial`` reduces a batch to one row per key; ``merge`` lists the aggregates
    that combine two such rows under the same column names.
    """

    def step(batch: DataFrame, number: int) -> None:
        fresh = partial(batch)
        before = snapshots.read_latest(spark, f"{root}/state", below=number)
        both = fresh if before is None else before.unionByName(fresh)
        snapshots.write_version(both.groupBy(*keys).agg(*merge()), f"{root}/state", number)
        snapshots.prune_versions(spark, f"{root}/state")

    return step


def running_groups(groups: DataFrame, root: str, key: str) -> DataFrame:
    """A streaming aggregate with one row a ``key``, kept by Spark's own state store and read to the end of the stream.

    Each micro-batch hands on the rows that it changed, and only those are written. A repeated
    batch writes its segment again. All rows count whenever they arrive: none is late.
    """
    segments = Segments(groups.sparkSession, root)

    def step(batch: DataFrame, number: int) -> None:
        changed = segments.write(batch, "state", number)
        segments.commit(number, changed.agg(F.count(F.lit(1)).alias("changed")))

    query = groups.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return last_of(segments.read("state", groups.schema), key)


def running_trust(spark: SparkSession, events: DataFrame, root: str) -> DataFrame:
    """Sum of trust deltas per source over a stream of trust events."""
    return running_groups(events.groupBy("source").agg(F.sum("delta").alias("delta_sum"), F.count(F.lit(1)).alias("n_events")), root, "source")


def running_strategies(spark: SparkSession, uses: DataFrame, root: str) -> DataFrame:
    """Strategies out of a stream of uses; equals the batch form."""
    state = running_groups(uses.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality_sum"), F.max(F.struct("seq", "tools")).alias("latest"),
        F.max("used_at").alias("last_used")), root, "pattern")
    return state.select("pattern", F.col("n").alias("times_reinforced"), (F.col("quality_sum") / F.col("n")).alias("avg_quality"),
                        F.col("latest.tools").alias("tools"), "last_used")
