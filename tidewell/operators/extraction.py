"""Extraction of entities and relationships from chunks as one stored job.

A run asks the user's function for every chunk that was not read successfully before, and writes
what it said, once, as one numbered change: entities, relationships with their properties, and
whether the chunk failed. The ledger, the graph's entities and its edges are read from there, so a
failed chunk is asked again by the next run, alone, and a repeated run changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.operators.graph import entity_id, merge_entities, merge_relationships, resolve_endpoints
from tidewell.functions.text import resolve_canonical
from tidewell.plans.segments import Segments, last_of
from tidewell.session import materialize

FOUND = {
    "chunk_id": "string", "seq": "bigint", "ok": "boolean", "error": "string",
    "entities": "array<struct<name: string, entity_type: string, properties: string>>",
    "relationships": "array<struct<source: string, target: string, relation_type: string, properties: string>>"}
CONFIDENCE = 0.5


@dataclass(frozen=True)
class ExtractionStore:
    """What runs have found, below one folder."""

    spark: SparkSession
    root: str

    @property
    def segments(self) -> Segments:
        return Segments(self.spark, self.root)

    def found(self, below: int | None = None) -> DataFrame:
        return self.segments.read("found", FOUND, below)

    def ledger(self, below: int | None = None) -> DataFrame:
        """``chunk_id, ok, error`` as the last run that asked for a chunk left it."""
        return last_of(self.found(below).select("chunk_id", "ok", "error", "segment"), "chunk_id")

    def entities(self, aliases: dict[str, str] | None = None) -> DataFrame:
        """One entity for each canonical name and type; see ``graph.merge_entities``."""
        return merge_entities(self._named().select("seq", "name", "entity_type", F.lit(CONFIDENCE).alias("confidence"), "properties",
                                                   F.col("chunk_id").alias("source_chunk")), aliases)

    def edges(self, aliases: dict[str, str] | None = None) -> DataFrame:
        """One edge for each pair of entities and type; relationships whose ends no chunk of the run has named by then are left out."""
        names = self._named().select(
            F.col("segment").alias("doc"), F.col("seq.chunk").alias("chunk_seq"), "name", F.col("seq.at").alias("seq"),
            entity_id(resolve_canonical("name", aliases), F.col("entity_type")).alias("entity_id"))
        told = self.found().where("ok").select("segment", "chunk_id", F.col("seq").alias("chunk"), F.posexplode("relationships").alias("at", "r"))
        told = told.select(F.col("segment").alias("doc"), F.concat("chunk_id", F.lit("#"), "at").alias("edge_id"), F.col("chunk").alias("chunk_seq"),
                           F.col("r.source").alias("source_name"), F.col("r.target").alias("target_name"), "r.relation_type", "r.properties", "chunk_id", "at")
        ended = resolve_endpoints(told, names)
        return merge_relationships(ended.select(
            F.struct(F.col("doc").alias("run"), F.col("chunk_seq").alias("chunk"), "at").alias("seq"), "source_id", "target_id", "relation_type",
            F.lit(CONFIDENCE).alias("confidence"), "properties", F.col("chunk_id").alias("source_chunk")))

    def _named(self) -> DataFrame:
        rows = self.found().where("ok").select("segment", "chunk_id", F.col("seq").alias("chunk"), F.posexplode("entities").alias("at", "e"))
        return rows.select("segment", "chunk_id", "chunk", "at", F.struct(F.col("segment").alias("run"), "chunk", "at").alias("seq"), "e.*")


def _checked(said: dict) -> tuple[list, list]:
    """Rows of what the function said; unknown types make the chunk fail."""
    def text(properties):
        return json.dumps(properties, sort_keys=True) if properties else None

    ents = [(e["name"], e["entity_type"], text(e.get("properties"))) for e in said["entities"]]
    rels = [(r["source"], r["target"], r["relation_type"], text(r.get("properties"))) for r in said["relationships"]]
    for kind, known in (*((e[1], fixed.ENTITY_TYPES) for e in ents), *((r[2], fixed.RELATION_TYPES) for r in rels)):
        if kind not in known:
            raise ValueError(f"unknown type {kind}")
    return ents, rels


def _pending(store: ExtractionStore, chunks: DataFrame, version: int) -> DataFrame:
    """The chunks that no run before ``version`` has read; ids decide, and the texts move only where too many are left to be broadcast."""
    if not [v for v in store.segments.versions() if v < version]:
        return chunks
    read = store.ledger(below=version).where("ok").select("chunk_id")
    left = materialize(chunks.select("chunk_id").join(read, "chunk_id", "left_anti").distinct().withColumnRenamed("chunk_id", "own_id"), "pending")
    return chunks.join(left, F.col("chunk_id").eqNullSafe(F.col("own_id")), "left_semi")


def run_extraction(store: ExtractionStore, chunks: DataFrame, version: int, extract_fn: Callable[[str], dict]) -> bool:
    """Asks ``extract_fn`` for the chunks (``chunk_id, seq, content``) that no run before has read, as run ``version``.

    The function gives ``{"entities": [{name, entity_type, properties}], "relationships": [{source,
    target, relation_type, properties}]}`` of a text. Says whether the run was done now.
    """
    segments = store.segments
    if version in segments.versions():
        return False
    chunks = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("seq").cast("long").alias("seq"), "content")
    pending = _pending(store, chunks, version)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for key, seq, content in zip(pdf["chunk_id"], pdf["seq"], pdf["content"], strict=True):
                try:
                    rows.append((key, seq, True, None, *_checked(extract_fn(content))))
                except Exception as exc:  # noqa: BLE001 - a failed chunk is a row of the ledger
                    rows.append((key, seq, False, str(exc), [], []))
            yield pd.DataFrame(rows, columns=list(FOUND))

    found = segments.write(pending.mapInPandas(run, ", ".join(f"{c} {kind}" for c, kind in FOUND.items())), "found", version)
    segments.commit(version, found.agg(F.count(F.lit(1)).alias("asked"), F.count_if("ok").alias("read")))
    return True
