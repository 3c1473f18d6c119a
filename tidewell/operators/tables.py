"""Filters, catalog look-ups, referential clean-up and table statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.plans.blocked import all_of


# --- filters -----------------------------------------------------------------
def filter_sources(
    sources: DataFrame, *, max_priority: int | None = None, category: str | None = None, spec: str | None = None,
    enabled_only: bool = True,
) -> DataFrame:
    """Source-list entries that meet every given condition."""
    tests = [F.col("enabled")] if enabled_only else []
    if max_priority is not None:
        tests.append(F.col("priority") <= max_priority)
    if category is not None:
        tests.append(F.col("category") == category)
    if spec is not None:
        tests.append(F.col("spec") == spec)
    return sources.where(all_of(tests))


def list_articles(articles: DataFrame, *, status: str | None = None, spec: str | None = None) -> DataFrame:
    """Articles by optional status and spec, newest update first."""
    tests = []
    if status is not None:
        tests.append(F.col("status") == status)
    if spec is not None:
        tests.append(F.col("spec") == spec)
    return articles.where(all_of(tests)).orderBy(F.desc("updated_at"), F.asc("path"))


def search_titles(
    articles: DataFrame, text: str | None, *, status: str | None = None, known_status: Sequence[str] = (),
    spec: str | None = None, known_specs: Sequence[str] = (),
) -> DataFrame:
    """Case-insensitive title search; an unknown status or spec finds nothing."""
    if (status and status not in known_status) or (spec and spec not in known_specs):
        return articles.where(F.lit(False))
    tests = []
    if status:
        tests.append(F.col("status") == status)
    if spec:
        tests.append(F.col("spec") == spec)
    if text:
        tests.append(F.contains(F.lower("title"), F.lit(text.lower())))
    return articles.where(all_of(tests))


def items_for_slot(items: DataFrame, slot: str, *, max_phase: int, min_level: int = 0) -> DataFrame:
    """Catalog items of a slot, best level first."""
    kept = items.where((F.col("slot") == slot) & (F.col("phase") <= max_phase) & (F.col("level") >= min_level))
    return kept.orderBy(F.desc("level"), F.asc("item_id"))


def search_items(items: DataFrame, text: str, slot: str) -> DataFrame:
    """Items whose name contains ``text``: those of ``slot``, or of any slot if it has none."""
    hits = items.where(F.contains(F.lower("name"), F.lit(text.lower())))
    in_slot = F.col("slot") == F.lit(slot)
    any_in_slot = hits.agg(F.coalesce(F.bool_or(in_slot), F.lit(False)).alias("any")).scalar()
    return hits.where(in_slot | ~any_in_slot)


def known_relation_types(wanted: Sequence[str] | None, known: Sequence[str]) -> list[str]:
    """Valid names out of a requested list; empty means no filter."""
    return [w for w in wanted or [] if w in set(known)]


def filter_relations(edges: DataFrame, wanted: Sequence[str] | None, known: Sequence[str]) -> DataFrame:
    """Edges of the requested types; unknown names are ignored."""
    valid = known_relation_types(wanted, known)
    return edges.where(F.col("relation_type").isin(valid)) if valid else edges


def drop_trash(fights: DataFrame) -> DataFrame:
    """Fights that belong to an encounter."""
    return fights.where(F.coalesce("encounter_id", F.lit(0)) != 0)


# --- referential actions -----------------------------------------------------
def coalesce_update(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Update ``columns`` from ``incoming`` where it has a non-empty value."""
    renamed = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = existing.join(renamed, list(keys), "left")
    types = dict(existing.dtypes)

    def pick(c: str) -> Column:
        new = F.col(f"_new_{c}")
        return F.coalesce(F.nullif(new, F.lit("")) if types[c] == "string" else new, F.col(c)).alias(c)

    return joined.select(*[pick(c) if c in columns else F.col(c) for c in existing.columns])


def cascade_delete(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    alive = parents.select(F.col(parent_key).alias(child_key))
    return children.join(alive, child_key, "left_semi")


def set_null_delete(rows: DataFrame, parents: DataFrame, ref: str, parent_key: str) -> DataFrame:
    """All rows; a reference to a missing parent becomes null."""
    alive = parents.select(F.col(parent_key).alias(ref)).distinct().withColumn("_alive", F.lit(True))
    joined = rows.join(alive, ref, "left")
    return joined.select(*[F.when(F.col("_alive"), F.col(c)).alias(c) if c == ref else F.col(c) for c in rows.columns])


def unprocessed(rows: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    """Rows not referenced by ``done``; null references match nothing."""
    return rows.join(done.select(F.col(done_key).alias(key)), key, "left_anti")


def new_reports(reports: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct reports of a character that its log does not hold yet."""
    return reports.select(*keys).distinct().join(log.select(*keys), list(keys), "left_anti")


# --- statistics --------------------------------------------------------------
def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def type_distribution(rows: DataFrame, types: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per type name, most frequent first."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(types.select(key, name), key).select(name, "n").orderBy(F.desc("n"), F.asc(name))


def group_coverage(rows: DataFrame, key: str) -> DataFrame:
    """Rows per group."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def ingest_report(results: DataFrame) -> DataFrame:
    """Counts of an ingest run out of ``ok, existed, n_chunks`` rows."""
    ok = F.col("ok")
    return results.agg(
        F.count_if(ok & ~F.col("existed")).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & F.col("existed")).alias("skipped"),
        F.coalesce(F.sum(F.when(ok & ~F.col("existed"), F.col("n_chunks"))), F.lit(0)).alias("total_chunks"),
    )
