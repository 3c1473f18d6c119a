"""A library of ingested pages: sources, chunks, vectors and a keyword index that change together.

One ingest of a batch of pages is one numbered change of all tables (``plans/segments.py``): it
decides each page against the stored sources, cuts the pages that are new or changed, and lets
that one change set of added and removed chunks drive the chunk table, the vectors and the
postings. A repeated batch finds its pages unchanged and writes nothing; a repeated number is not
applied again; a change that broke off is not seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import ingest
from tidewell.operators.retrieval import feature_hash_embedding
from tidewell.operators.search_index import SearchIndex, change_index, create_index, open_index
from tidewell.functions.text import content_hash
from tidewell.plans.segments import Segments, last_of, without_removed
from tidewell.session import materialize

SOURCES = {
    "url": "string", "title": "string", "source_type": "string", "content_hash": "string", "content_hash_previous": "string", "change_count": "int",
    "is_stale": "boolean", "trust_score": "double", "check_interval_hours": "int", "fetched_at": "timestamp", "last_checked": "timestamp",
    "chunk_count": "bigint", "gone": "boolean"}
CHUNKS = {"chunk_id": "string", "url": "string", "chunk_index": "int", "content": "string", "char_count": "int", "token_estimate": "bigint"}
VECTORS = {"chunk_id": "string", "embedding": "array<double>"}
REMOVED = {"chunk_id": "string"}
DECISIONS = {"url": "string", "action": "string", "chunk_count": "bigint", "has_text": "boolean"}


@dataclass(frozen=True)
class Library:
    spark: SparkSession
    root: str

    @property
    def segments(self) -> Segments:
        return Segments(self.spark, self.root)

    @property
    def index(self) -> SearchIndex:
        return open_index(self.spark, f"{self.root}/index")

    def sources(self, below: int | None = None) -> DataFrame:
        """The sources as their last change left them."""
        return last_of(self.segments.read("sources", SOURCES, below), "url").where(~F.col("gone")).drop("gone")

    def chunks(self, below: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The chunks that belong to the sources as they are, or to those of them in ``of`` (``url``)."""
        rows = self.segments.read("chunks", CHUNKS, below)
        rows = rows if of is None else rows.join(of, "url", "left_semi")
        return without_removed(rows, self.segments.read("removed", REMOVED, below), "chunk_id").drop("segment")

    def vectors(self) -> DataFrame:
        """The vectors of these chunks."""
        return without_removed(self.segments.read("vectors", VECTORS), self.segments.read("removed", REMOVED), "chunk_id").drop("segment")

    def decisions(self, version: int) -> DataFrame:
        """``url, action, chunk_count, has_text`` of the pages of one change."""
        return self.segments.read("decisions", DECISIONS).where(F.col("segment") == version).drop("segment")


def create_library(spark: SparkSession, root: str, blocks: int = 16, buckets: int = 16) -> Library:
    """An empty library; ``blocks`` and ``buckets`` as in ``create_index``, for the chunks that are expected."""
    library = Library(spark, root.rstrip("/"))
    create_index(spark.createDataFrame([], "doc_id string, text string"), f"{library.root}/index", blocks=blocks, buckets=buckets)
    return library


def chunk_id(url: Column, index: Column) -> Column:
    return F.concat(url, F.lit("#"), index.cast("string"))


def ingest_pages(
    library: Library, pages: DataFrame, version: int, now: Column, *, intervals: dict[str, int] | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None, **sizes: int,
) -> bool:
    """Applies a batch of pages (``url, title, source_type, text``, one row a URL) as change ``version`` (from 1).

    ``embed`` gives ``chunk_id, embedding`` of ``chunk_id, content``; ``sizes`` go to the chunker.
    Says whether the change was applied now.
    """
    segments = library.segments
    if version in segments.versions():
        return False
    known = library.sources(below=version)
    # Written once and without the texts, which move again only where they are cut and are too many to be found by a broadcast.
    decided = materialize(ingest.ingest_decision(pages.withColumn("has_text", ~ingest.is_blank("text")), known.drop("chunk_count")).drop("text"), "decided")
    written = F.col("action").isin("new", "replace")
    cut = decided.where(written & F.col("has_text")).select(F.col("url").alias("own_url"), F.col("new_hash").alias("own_hash"))
    texts = pages.select("url", "text")
    # A batch that came before reads no texts here.
    texts = texts.limit(0) if cut.isEmpty() else texts.withColumn("new_hash", content_hash("text")).join(
        cut.distinct(), F.col("url").eqNullSafe(F.col("own_url")) & (F.col("new_hash") == F.col("own_hash")), "left_semi")
    fresh = ingest.chunk_texts(texts, ["url"], "text", **sizes)
    added = segments.write(fresh.select(chunk_id(F.col("url"), F.col("chunk_index")).alias("chunk_id"), *list(CHUNKS)[1:]), "chunks", version)
    counts = added.groupBy("url").agg(F.count(F.lit(1)).alias("chunk_count"))
    before = known.select("url", F.col("chunk_count").alias("held"))
    told = segments.write(decided.select("url", "action", "has_text").join(counts, "url", "left").join(
        before, "url", "left").select("url", "action", F.coalesce(F.when(written, F.col("chunk_count")).otherwise(F.col("held")), F.lit(0)).alias(
            "chunk_count"), "has_text"), "decisions", version)
    replaced = told.where("action = 'replace'").select("url")
    _apply(library, version, added, library.chunks(below=version, of=replaced), embed)
    touched = decided.where(written)
    sources = ingest.apply_ingest(touched, known.drop("chunk_count").join(touched.select("url"), "url", "left_semi"), now, intervals)
    segments.write(sources.join(told.select("url", "chunk_count"), "url").withColumn("gone", F.lit(False)).select(*SOURCES), "sources", version)
    _commit(library, version)
    return True


def forget_sources(library: Library, urls: DataFrame, version: int) -> bool:
    """Takes sources (``url``) out, and with them their chunks, vectors and postings."""
    segments = library.segments
    if version in segments.versions():
        return False
    gone = library.sources(below=version).join(urls.select("url").distinct(), "url", "left_semi")
    chunks = library.chunks(below=version)
    _apply(library, version, segments.write(chunks.limit(0), "chunks", version), library.chunks(below=version, of=gone.select("url")), None)
    segments.write(gone.withColumn("gone", F.lit(True)).select(*SOURCES), "sources", version)
    segments.write(gone.select("url", F.lit("forgotten").alias("action"), "chunk_count", F.lit(True).alias("has_text")), "decisions", version)
    _commit(library, version)
    return True


def _apply(library: Library, version: int, added: DataFrame, removed: DataFrame, embed: Callable[[DataFrame], DataFrame] | None) -> None:
    """Removed list, vectors and postings of one change set of chunks."""
    segments = library.segments
    removed = materialize(removed.select("chunk_id", "content"), "removed")
    segments.write(removed.select("chunk_id"), "removed", version)
    made = embed(added.select("chunk_id", "content")) if embed else feature_hash_embedding(added, "chunk_id", "content")
    segments.write(made.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")), "vectors", version)
    text = [F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")]
    change_index(library.index, version, added=added.select(*text), removed=removed.select(*text))


def _commit(library: Library, version: int) -> None:
    library.segments.commit(version, library.spark.range(1).select(F.lit(version).alias("version")))
