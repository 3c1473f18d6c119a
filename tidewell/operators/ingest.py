"""Corpus ingest: chunks, incremental decisions, duplicates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import fixed
from tidewell.functions.scoring import base_trust
from tidewell.functions.text import check_interval, content_hash, is_blank
from tidewell.plans.blocked import with_neighbours
from tidewell.plans.slices import SLICE_CHARS, slices, text_sizes
from tidewell.plans.spread import spread

CHARS_PER_TOKEN = 4

# --- fixed values: where a text may be cut, coarsest first: (cut, text put back
# --- before the following part, joiner when parts are merged again)
BOUNDARIES = (
    (re.compile("\n## "), "## ", "\n"),
    (re.compile("\n### "), "### ", "\n"),
    (re.compile("\n\n"), "", "\n\n"),
    (re.compile("\n"), "", "\n"),
    (re.compile(r"(?<=\.) "), "", " "),
    (re.compile(" "), "", " "),
)
HEADINGS = 2


def _cut(text: str, level: int) -> list[str]:
    pattern, prefix, _ = BOUNDARIES[level]
    head, *tail = pattern.split(text)
    return [p for p in (head, *(prefix + t for t in tail)) if p.strip()]


def _pieces(text: str, budget: int) -> Iterator[str]:
    """Pieces of at most ``budget`` characters, in order, with an explicit stack of (text, level)."""
    stack = [(text, 0)]
    while stack:
        part, level = stack.pop()
        fits = len(part) < budget + CHARS_PER_TOKEN
        last = HEADINGS if fits else len(BOUNDARIES)
        parts: list[str] = []
        while level < last:
            parts = _cut(part, level)
            level += 1
            if len(parts) > 1:
                break
        if len(parts) <= 1:
            if fits:
                yield part
            else:
                yield from (part[i:i + budget] for i in range(0, len(part), budget))
        elif fits:
            # A text within the limit is still cut at its headings.
            stack.extend((p, level) for p in reversed(parts))
        else:
            stack.extend((p, level) if len(p) >= budget + CHARS_PER_TOKEN else (p, len(BOUNDARIES))
                         for p in reversed(_packed(parts, BOUNDARIES[level - 1][2], budget)))


def _packed(parts: list[str], joiner: str, budget: int) -> list[str]:
    """Neighbouring parts joined while they stay within the budget."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(joiner) + len(part) < budget + CHARS_PER_TOKEN:
            out[-1] = out[-1] + joiner + part
        else:
            out.append(part)
    return out


def chunk_one(text: str, max_tokens: int, min_tokens: int, overlap_tokens: int) -> list[str]:
    """Chunks of one text; the helper run per row by :func:`chunk_texts`."""
    pieces = [p.strip() for p in _pieces(text.strip(), max_tokens * CHARS_PER_TOKEN) if p.strip()]
    merged: list[str] = []
    for piece in pieces:
        if merged and len(merged[-1]) < min_tokens * CHARS_PER_TOKEN:
            merged[-1] += "\n\n" + piece
        else:
            merged.append(piece)
    out = merged[:1]
    for before, chunk in zip(merged, merged[1:], strict=False):
        lead = before[-overlap_tokens * CHARS_PER_TOKEN:].split(" ", 1)[-1] + " " if overlap_tokens > 0 else ""
        out.append(lead + chunk)
    return [c.strip() for c in out if c.strip()]


def chunk_texts(
    docs: DataFrame, id_cols: list[str], text_col: str, *, max_tokens: int = fixed.CHUNK_MAX, min_tokens: int = fixed.CHUNK_MIN,
    overlap_tokens: int = fixed.CHUNK_OVERLAP,
) -> DataFrame:
    """``id_cols, chunk_index, content, char_count, token_estimate``.

    Rows stay where they are: cutting a text needs only that text. A task holds the chunks of a
    bounded slice of its texts.
    """
    schema = T.StructType([*[docs.schema[c] for c in id_cols], T.StructField("chunk_index", T.IntegerType()),
                           T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_sizes(whole.column(len(id_cols))), SLICE_CHARS)):
            chunks = [chunk_one(t, max_tokens, min_tokens, overlap_tokens) if t else [] for t in batch.column(len(id_cols)).to_pylist()]
            row = pa.array([i for i, c in enumerate(chunks) for _ in c], pa.int64())
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i).take(row) for i in range(len(id_cols))), pa.array([i for c in chunks for i in range(len(c))], pa.int32()),
                pa.array([x for c in chunks for x in c], pa.string())], names=schema.names)

    cut = spread(docs.select(*id_cols, text_col), id_cols[0]).mapInArrow(run, schema)
    return cut.withColumns({"char_count": F.length("content"), "token_estimate": F.floor(F.length("content") / CHARS_PER_TOKEN)})


def with_overlap(pieces: DataFrame, key: str, seq: str, text: str, block: Column, chars: int = fixed.CHUNK_OVERLAP * CHARS_PER_TOKEN) -> DataFrame:
    """Pieces with the end of the previous piece in front, cut after its first space."""
    prev = with_neighbours(pieces, [key], [seq], block, lag={"_tail": F.right(F.col(text), F.lit(chars))})
    lead = F.concat(F.regexp_replace("_tail", "^[^ ]* ", ""), F.lit(" "))
    return prev.withColumn("with_overlap", F.concat(F.coalesce(lead, F.lit("")), F.col(text))).drop("_tail")


def chunk_counts(sources: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Sources with their number of chunks, 0 when none."""
    n = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"))
    return sources.drop("chunk_count").join(n, key, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


# --- incremental ingest ------------------------------------------------------
SOURCE_COLUMNS = (
    "url", "title", "source_type", "content_hash", "content_hash_previous", "change_count", "is_stale", "trust_score",
    "check_interval_hours", "fetched_at", "last_checked",
)


def ingest_decision(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """What to do with each incoming page: ``new``, ``unchanged``, ``refused`` or ``replace``.

    ``incoming``: ``url, title, source_type, text``, one row per URL.
    """
    known = sources.select("url", F.col("content_hash").alias("known_hash"), F.lit(True).alias("_known"))
    # Read off before the join, so that a text that nobody asks for does not move.
    fresh = incoming.withColumns({"new_hash": content_hash("text"), "_blank": is_blank("text")})
    action = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("known_hash") == F.col("new_hash"), "unchanged")
        .when(F.col("_blank"), "refused")
        .otherwise("replace")
    )
    return fresh.join(known, "url", "left").withColumn("action", action).drop("_known", "_blank")


def apply_ingest(decisions: DataFrame, sources: DataFrame, now: Column, intervals: dict[str, int] | None = None) -> DataFrame:
    """The source table after the ingest.

    A replaced source keeps its trust and check interval. One full outer join
    serves known and new sources.
    """
    d = decisions.select("url", F.col("title").alias("_title"), F.col("source_type").alias("_type"), "new_hash", "action")
    j = sources.select(*SOURCE_COLUMNS).join(d, "url", "full")
    new, rep = F.coalesce(F.col("action") == "new", F.lit(False)), F.coalesce(F.col("action") == "replace", F.lit(False))
    written = new | rep
    pick = lambda fresh, old: F.when(written, fresh).otherwise(F.col(old)).alias(old)
    return j.select(
        "url", pick(F.col("_title"), "title"), pick(F.col("_type"), "source_type"), pick(F.col("new_hash"), "content_hash"),
        F.when(rep, F.col("content_hash")).otherwise(F.col("content_hash_previous")).alias("content_hash_previous"),
        F.when(new, F.lit(0)).when(rep, F.col("change_count") + 1).otherwise(F.col("change_count")).alias("change_count"),
        F.when(written, F.lit(False)).otherwise(F.col("is_stale")).alias("is_stale"),
        F.when(new, base_trust("_type")).otherwise(F.col("trust_score")).alias("trust_score"),
        F.when(new, check_interval("url", intervals)).otherwise(F.col("check_interval_hours")).alias("check_interval_hours"),
        pick(now, "fetched_at"), pick(now, "last_checked"),
    )


def changed_texts(decisions: DataFrame) -> DataFrame:
    """Pages whose chunks must be written anew."""
    return decisions.where(F.col("action").isin("new", "replace") & ~is_blank("text"))


def replace_chunks(old: DataFrame, fresh: DataFrame, decisions: DataFrame) -> DataFrame:
    """Chunk table after the ingest: chunks of replaced sources go, new ones come."""
    gone = decisions.where(F.col("action") == "replace").select("url")
    return old.join(gone, "url", "left_anti").unionByName(fresh.select(*old.columns))


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per distinct text: the id that is kept and the number of copies.

    A map-side combined aggregate on the hash, so a text with very many copies
    costs one row per task.
    """
    return docs.select(id_col, F.sha2(text_col, 256).alias("content_hash")).groupBy("content_hash").agg(
        F.min(id_col).alias("kept_id"), F.count(F.lit(1)).alias("copies"))


def without_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first document of every distinct text.

    Ids and hashes decide; the texts themselves move only when the list of kept ids is
    too large for Spark to broadcast.
    """
    kept = exact_duplicates(docs, id_col, text_col).select(F.col("kept_id").alias(id_col))
    return docs.join(kept, id_col, "left_semi")
