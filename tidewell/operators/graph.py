"""Knowledge graph: canonical entities, typed edges, look-ups and search cards."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import fixed
from tidewell.functions.text import resolve_canonical, title_case, tokens
from tidewell.plans.blocked import with_neighbours
from tidewell.plans.merge import first_by, last_known
from tidewell.plans.slices import SLICE_ENTRIES, list_sizes, slices
from tidewell.plans.spread import spread
from tidewell.plans.topk import top_k


# --- seed tables -------------------------------------------------------------
def entity_types(spark: SparkSession) -> DataFrame:
    """``entity_type, display_name`` of all entity types."""
    rows = spark.createDataFrame([(x,) for x in fixed.ENTITY_TYPES], "entity_type string")
    return rows.withColumn("display_name", title_case("entity_type"))


def alias_table(spark: SparkSession) -> DataFrame:
    """``alias, canonical_name`` rows."""
    return spark.createDataFrame(list(fixed.ALIASES.items()), "alias string, canonical_name string")


# --- merges ------------------------------------------------------------------
def entity_id(canonical: Column | str, entity_type: Column | str) -> Column:
    """Deterministic id of an entity out of its natural key."""
    return F.xxhash64(canonical, entity_type)


def merge_entities(found: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """One entity per canonical name and type.

    ``found``: ``seq, name, entity_type, confidence, properties, source_chunk``.
    Keeps the first surface name, the highest confidence and the last known
    properties and chunk.
    """
    rows = found.withColumn("canonical_name", resolve_canonical("name", aliases))
    order = F.col("seq")
    return rows.groupBy("canonical_name", "entity_type").agg(
        first_by("name", order).alias("name"), F.max("confidence").alias("confidence"),
        last_known("properties", order).alias("properties"), last_known("source_chunk", order).alias("source_chunk"),
    ).withColumn("entity_id", entity_id("canonical_name", "entity_type"))


def merge_relationships(found: DataFrame) -> DataFrame:
    """One edge per source, target and type.

    Keeps the highest confidence, the last known properties and the *first* chunk:
    a repeated edge does not move its provenance.
    """
    order = F.col("seq")
    return found.groupBy("source_id", "target_id", "relation_type").agg(
        F.max("confidence").alias("confidence"), last_known("properties", order).alias("properties"),
        first_by("source_chunk", order).alias("source_chunk"))


def resolve_endpoints(edges: DataFrame, entities: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Entity ids for edges given by names.

    ``edges``: ``doc, edge_id, chunk_seq, source_name, target_name, ...``;
    ``entities``: ``doc, chunk_seq, name, entity_id, seq``. A name means the latest
    entity of that name in the same or an earlier chunk of the document; edges with
    an unresolved end are dropped. Both inputs run through one ordered pass per
    name, so a common name makes no pairs.
    """
    ents = entities.select("doc", "name", "chunk_seq", F.lit(0).alias("_side"), F.col("seq").cast("bigint").alias("_tie"),
                           F.lit(None).cast(dict(edges.dtypes)["edge_id"]).alias("_edge"), "entity_id", F.lit(None).cast("string").alias("_role"))
    ends = edges.select("doc", "edge_id", "chunk_seq", F.explode(F.array(
        F.struct(F.lit("source").alias("role"), F.col("source_name").alias("name")),
        F.struct(F.lit("target").alias("role"), F.col("target_name").alias("name")))).alias("e")).select(
        "doc", F.col("e.name").alias("name"), "chunk_seq", F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), F.col("edge_id").alias("_edge"),
        F.lit(None).cast(dict(entities.dtypes)["entity_id"]).alias("entity_id"), F.col("e.role").alias("_role"))
    both = ents.unionByName(ends)
    known = with_neighbours(both, ["doc", "name"], ["chunk_seq", "_side", "_tie", "_edge", "_role"],
                            F.floor(F.col("chunk_seq") / block), last_until={"_found": "entity_id"})
    hits = known.where((F.col("_side") == 1) & F.col("_found").isNotNull())
    pairs = hits.groupBy("doc", F.col("_edge").alias("edge_id")).agg(
        F.max(F.when(F.col("_role") == "source", F.col("_found"))).alias("source_id"),
        F.max(F.when(F.col("_role") == "target", F.col("_found"))).alias("target_id"))
    whole = pairs.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    return edges.join(whole, ["doc", "edge_id"])


# --- look-ups ----------------------------------------------------------------
def find_entities(asked: DataFrame, entities: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """All entities a name may mean: ``asked`` (``query_id, name, entity_type``) joined by canonical name.

    A null ``entity_type`` asks for any type.
    """
    wanted = asked.select("query_id", resolve_canonical("name", aliases).alias("canonical_name"),
                          F.col("entity_type").alias("_type"))
    hits = entities.join(wanted, "canonical_name")
    return hits.where(F.col("_type").isNull() | (F.col("_type") == F.col("entity_type"))).drop("_type")


def first_entity(matches: DataFrame) -> DataFrame:
    """One entity per asked name: the one with the least id."""
    rest = [c for c in matches.columns if c != "query_id"]
    return matches.groupBy("query_id").agg(F.min_by(F.struct(*rest), "entity_id").alias("_e")).select("query_id", "_e.*")


def neighbours(asked: DataFrame, edges: DataFrame, entities: DataFrame, direction: str = "outgoing",
               relation_types: Sequence[str] | None = None) -> DataFrame:
    """Edges of the asked entities (``query_id, entity_id``) with the entity at the other end."""
    if direction == "outgoing":
        here, there = "source_id", "target_id"
    elif direction == "incoming":
        here, there = "target_id", "source_id"
    else:
        raise ValueError(f"direction must be outgoing or incoming, not {direction!r}")
    kept = edges.where(F.col("relation_type").isin(list(relation_types))) if relation_types else edges
    other = entities.select(
        F.col("entity_id").alias(there), F.col("name").alias("related_name"), F.col("canonical_name").alias("related_canonical"),
        F.col("entity_type").alias("related_type"))
    return kept.join(asked.select("query_id", F.col("entity_id").alias(here)), here).join(other, there)


def search_cards(asked: DataFrame, edges: DataFrame, entities: DataFrame, *, aliases: dict[str, str] | None = None,
                 relation_types: Sequence[str] | None = None, target_type: str | None = None,
                 top: int = fixed.GRAPH_TOP_K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph search for many names: (edges of unambiguous names, ambiguous matches, related chunks).

    A name with one match shows its best edges in both directions; a name with more
    matches shows the matches. The target type filters edges, it does not decide
    between matches.
    """
    matches = find_entities(asked, entities, aliases)
    n = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_matches"))
    counted = matches.join(n, "query_id")
    ambiguous = counted.where(F.col("n_matches") > 1).select("query_id", "entity_id", "name", "entity_type")
    single = counted.where(F.col("n_matches") == 1)

    # Edges of the asked entities only, with the end that was asked; names are looked up for the best ones.
    kept = edges.where(F.col("relation_type").isin(list(relation_types))) if relation_types else edges
    ends = F.explode(F.array(F.struct(F.lit("outgoing").alias("direction"), F.col("source_id").alias("here"), F.col("target_id").alias("there")),
                             F.struct(F.lit("incoming").alias("direction"), F.col("target_id").alias("here"), F.col("source_id").alias("there"))))
    held = kept.select("source_id", "target_id", "relation_type", "confidence", "source_chunk", ends.alias("end")).select("*", "end.*").drop("end")
    both = held.join(single.select("query_id", F.col("entity_id").alias("here")), "here")
    there = entities.select(F.col("entity_id").alias("there"), F.col("name").alias("related_name"), F.col("entity_type").alias("related_type"))
    shown = there.where(F.col("related_type") == target_type) if target_type else there
    both = both.join(shown.select("there"), "there", "left_semi")
    best = top_k(both, ["query_id", "direction"], [F.desc("confidence"), F.asc("relation_type"), F.asc("source_id"), F.asc("target_id")], top)
    best = best.join(there, "there").select("query_id", "direction", "relation_type", "related_name", "related_type", "source_id", "target_id",
                                            "confidence", "source_chunk", "rank0")
    return best, ambiguous, related_chunks(single, best)


def related_chunks(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct non-null chunks of the entities and their shown edges, as rows."""
    both = entities.select("query_id", "source_chunk").unionByName(edges.select("query_id", "source_chunk"))
    return both.where(F.col("source_chunk").isNotNull()).distinct()


def chunk_list(chunks: DataFrame) -> DataFrame:
    """Chunk ids of each card as one sorted array; a card shows a bounded number of edges."""
    return chunks.groupBy("query_id").agg(F.array_sort(F.collect_set("source_chunk")).alias("chunk_ids"))


# --- extraction --------------------------------------------------------------
def extract_with(chunks: DataFrame, extract_fn: Callable[[str], list[dict]], *, id_col: str, text_col: str) -> DataFrame:
    """Rows ``id, ok, error, name, entity_type`` by a user function, chunk by chunk.

    A chunk for which the function fails gives one row with ``ok`` false and does
    not stop the others.
    """
    schema = "id bigint, ok boolean, error string, name string, entity_type string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                try:
                    rows += [(key, True, None, e["name"], e["entity_type"]) for e in extract_fn(text)]
                except Exception as exc:  # noqa: BLE001 - a failed chunk is a result row
                    rows.append((key, False, str(exc), None, None))
            yield pd.DataFrame(rows, columns=["id", "ok", "error", "name", "entity_type"])

    return chunks.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def word_sequences(toks: Column | str, n: int) -> Column:
    """All sequences of ``n`` consecutive tokens, joined by a space."""
    t = F.col(toks) if isinstance(toks, str) else toks
    if n == 1:
        return t
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))


def gazetteer_mentions(chunks: DataFrame, gazetteer: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Default extractor: names of a gazetteer that occur as word sequences of a chunk.

    ``gazetteer``: ``canonical_name, entity_type``. Names and texts are cut into words alike, so
    that a name with an apostrophe or a dash is found however it is written. Sequences are cut in the lengths that
    its names have, however long. Each chunk gives every sequence once, so the join meets
    no pairs within a chunk; a gazetteer small enough is broadcast by its size.
    """
    names = gazetteer.withColumn("_key", F.array_join(tokens("canonical_name"), " "))
    words = spread(chunks.select(id_col, text_col), id_col).select(id_col, tokens(text_col).alias("_t"))
    grams = words.select(id_col, F.explode(F.array_distinct(F.flatten(F.array(
        *[word_sequences("_t", n) for n in _lengths(names)])))).alias("_key"))
    return grams.join(names, "_key").drop("_key")


def _lengths(names: DataFrame) -> list[int]:
    """Numbers of words that the names (``_key``) have."""
    return sorted(r.n for r in names.where(F.col("_key") != "").select(F.size(F.split("_key", " ")).alias("n")).distinct().collect()) or [1]


def _sequences(words: DataFrame, id_col: str, lengths: list[int]) -> DataFrame:
    """``id, start, minus, key``: the word sequences of these lengths (``minus`` them) of ``id, _t``, made of bounded slices of the words."""
    schema = T.StructType([words.schema[id_col], T.StructField("start", T.IntegerType()), T.StructField("minus", T.IntegerType()),
                           T.StructField("key", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, list_sizes(whole.column(1)), SLICE_ENTRIES)):
            flat, sizes = batch.column(1).flatten(), list_sizes(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words from here to the end of the text
            for n in lengths:
                at = np.flatnonzero(left >= n)
                parts = [flat.take(pa.array(at + i)) for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row[at])), pa.array((sizes[row[at]] - left[at]).astype("int32")), pa.array(np.full(len(at), -n, "int32")),
                    pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]], names=schema.names)

    return words.select(id_col, "_t").mapInArrow(run, schema)


def longest_mentions(chunks: DataFrame, gazetteer: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``id, position, canonical_name, entity_type``: names as a reader meets them, from left to right.

    At each word the longest name that begins there counts, and the next one begins after it; so
    of overlapping names the first and longest is taken. Positions count words from 0. A name
    that the gazetteer holds under several types is met under each.
    """
    names = gazetteer.withColumn("_key", F.array_join(tokens("canonical_name"), " "))
    words = spread(chunks.select(id_col, text_col), id_col).select(id_col, tokens(text_col).alias("_t"))

    met = _sequences(words, id_col, _lengths(names)).join(names.select(F.col("_key").alias("key")).distinct(), "key", "left_semi")
    # The mentions of one chunk in order: longer ones first where they begin together.
    rows = met.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "minus", "key"))).alias("rows"))
    schema = T.StructType([words.schema[id_col], T.StructField("position", T.IntegerType()), T.StructField("_key", T.StringType())])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, list_sizes(whole.column(1)), SLICE_ENTRIES)):
            found, sizes = batch.column(1).flatten(), list_sizes(batch.column(1))
            row, starts = np.repeat(np.arange(batch.num_rows), sizes), found.field("start")
            taken, chunk, free = [], -1, 0
            for i, (r, start, minus) in enumerate(zip(row.tolist(), starts.to_pylist(), found.field("minus").to_pylist(), strict=True)):
                if r != chunk:
                    chunk, free = r, 0
                if start >= free:
                    taken.append(i)
                    free = start - minus
            at = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[taken].astype("int64"))), starts.take(at), found.field("key").take(at)], names=schema.names)

    found = rows.select(id_col, "rows").mapInArrow(kept, schema)
    return found.join(names, "_key").drop("_key")


def pending_chunks(chunks: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Chunks not yet in the ledger of processed chunks.

    Asking which chunks an entity refers to would repeat chunks without entities for
    ever and forget chunks whose entity moved on; the ledger does neither.
    """
    return chunks.join(ledger.select(key), key, "left_anti")


def mentioned_entities(claim: Column | str, refs: Column | str) -> Column:
    """Entity references of an article that occur in one of its claims, any case."""
    text = F.lower(F.col(claim) if isinstance(claim, str) else claim)
    return F.filter(F.col(refs) if isinstance(refs, str) else refs, lambda r: F.contains(text, F.lower(r)))
