"""Keyword, vector and hybrid search for whole tables of queries.

Every search takes a query *table*, so thousands of queries share one plan.
Conventions: documents carry ``doc_id``; queries carry ``query_id``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.functions import fixed
from tidewell.functions.text import is_blank, tokens
from tidewell.plans.slices import SLICE_ENTRIES, list_sizes, slices
from tidewell.plans.spread import spread
from tidewell.plans.topk import top_k
from tidewell.session import materialize

# Queries held by each task in one pass over the vectors (bytes of float64).
QUERY_SLICE_BYTES = 64 * 1024 * 1024
# Words, beyond those of a slice, whose buckets a task remembers.
KNOWN_WORDS = 1 << 18
# Queries multiplied at once inside a task.
QUERY_BLOCK = 512


# --- keyword search ----------------------------------------------------------
def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, toks, doc_len``; large tables are not shuffled."""
    out = spread(docs.select(id_col, text_col), id_col).select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("toks"))
    return out.withColumn("doc_len", F.size("toks"))


def build_postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index ``term, doc_id, doc_len, positions, tf`` to be stored by term.

    A task turns bounded slices of its token lists into postings with numpy, so nothing
    is shuffled to build the index; a posting belongs to one document and cannot
    outgrow it, however common its term is.
    """
    toks = tokenized(docs, id_col, text_col).select("doc_id", "toks")
    schema = T.StructType([
        T.StructField("term", T.StringType()), toks.schema["doc_id"], T.StructField("doc_len", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, list_sizes(whole.column(1)), SLICE_ENTRIES)):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            sizes = list_sizes(lists)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype("int32")
            # By term and row, and then as they stand in the text, as the sort is stable; what sorts by term later finds long runs.
            rank = np.empty(len(coded.dictionary), dtype="int64")
            rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
            order = np.argsort(rank[code] * batch.num_rows + row, kind="stable")
            row, code, place = row[order], code[order], place[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])] if len(code) else np.zeros(0, dtype=bool)
            start = np.flatnonzero(new)
            offsets = pa.array(np.r_[start, len(code)].astype("int32"))
            yield pa.RecordBatch.from_arrays([
                coded.dictionary.take(pa.array(code[start])), batch.column(0).take(pa.array(row[start])),
                pa.array(sizes[row[start]].astype("int32")), pa.ListArray.from_arrays(offsets, pa.array(place)),
            ], names=["term", "doc_id", "doc_len", "positions"])

    return toks.mapInArrow(run, schema).withColumn("tf", F.size("positions"))


def query_phrases(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_id, phrase, terms``: one row per distinct phrase of a query.

    A query splits at white space; a word with inner punctuation becomes a
    phrase of several terms, a word of punctuation only is ignored.
    """
    words = F.filter(F.split(F.col(text_col), r"(?U)\s+"), lambda w: w != "")
    parsed = F.array_distinct(F.filter(F.transform(words, lambda w: tokens(w)), lambda t: F.size(t) > 0))
    return queries.select(F.col(id_col).alias("query_id"), F.explode(parsed).alias("terms")).select(
        "query_id", F.array_join("terms", " ").alias("phrase"), "terms"
    )


def phrase_hits(toks: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase, doc_id, doc_len, tf`` for the distinct phrases of all queries.

    One pass over the tokens. A phrase of several terms counts the starting
    positions at which every term stands in its place; one of a single term counts
    all its positions at once, which the partial aggregate next to the scan does. The
    empty phrase stands once in every document: its rows give the number and the
    mean length of the documents.
    """
    placed = toks.select("doc_id", "doc_len", F.posexplode(F.concat(F.array(F.lit("")), "toks")).alias("pos", "term"))
    every = phrases.sparkSession.range(1).select(F.lit("").alias("phrase"), F.array(F.lit("")).alias("terms"))
    terms = phrases.select("phrase", "terms").distinct().unionByName(every).select(
        "phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term"))
    start = F.when(F.col("n") > 1, F.col("pos") - F.col("offset")).otherwise(F.lit(-1))
    at = placed.join(terms, "term").groupBy("phrase", "doc_id", "doc_len", "n", start.alias("start")).agg(
        F.count(F.lit(1)).alias("matched"))
    found = F.when(F.col("n") == 1, F.col("matched")).when(F.col("matched") == F.col("n"), F.lit(1)).otherwise(F.lit(0))
    return at.groupBy("phrase", "doc_id", "doc_len").agg(F.sum(found).alias("tf")).where(F.col("tf") > 0)


def bm25(
    docs: DataFrame, queries: DataFrame, *, doc_id: str, doc_text: str, query_id: str, query_text: str
) -> DataFrame:
    """``query_id, doc_id, score`` of documents that hold *every* phrase of a query.

    Higher is better. The rarest phrase of a query proposes its candidates and the
    other phrases are looked up for those only, so a query with a very common word
    does not bring in every document that has it.
    """
    phrases = query_phrases(queries, query_id, query_text)
    # Written once: document frequencies, candidates and scores all read it, and the
    # texts are tokenised a single time.
    hits = materialize(phrase_hits(tokenized(docs, doc_id, doc_text), phrases), "phrase-hits")
    corpus = hits.where(F.col("phrase") == "").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    df_ = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))

    per_query = phrases.select("query_id", "phrase").join(df_, "phrase", "left")
    plan = per_query.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("needed"),
        F.min_by("phrase", F.struct(F.coalesce("df", F.lit(0)), "phrase")).alias("rarest"),
        F.min(F.coalesce("df", F.lit(0))).alias("least"),
    ).where(F.col("least") > 0)
    candidates = (
        plan.join(hits.select("phrase", "doc_id"), F.col("rarest") == F.col("phrase"))
        .select("query_id", "needed", "doc_id")
    )
    n, d = corpus.select("n_docs").scalar(), F.col("df")
    raw_idf = F.log((n - d + 0.5) / (d + 0.5))
    idf = F.when(raw_idf <= 0, F.lit(fixed.BM25_IDF_FLOOR)).otherwise(raw_idf)
    weighted = per_query.where(F.col("df").isNotNull()).select("query_id", "phrase", idf.alias("idf"))
    k1, b = F.lit(fixed.BM25_K1), F.lit(fixed.BM25_B)
    tf, norm = F.col("tf"), F.col("doc_len") / corpus.select("avg_len").scalar()
    part = F.col("idf") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * norm))
    return (
        candidates.join(weighted, "query_id")
        .join(hits, ["phrase", "doc_id"])
        .groupBy("query_id", "doc_id")
        .agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("got"), F.first("needed").alias("needed"))
        .where(F.col("got") == F.col("needed"))
        .select("query_id", "doc_id", "score")
    )


# --- vectors -----------------------------------------------------------------
def _hashed(word: str, dim: int) -> int:
    """Twice the bucket of a word, and 1 more where it counts as negative."""
    digest = hashlib.md5(word.encode()).digest()
    # Two hex digits reach 256 buckets; wider vectors take the eight after the third.
    place = digest[0] if dim <= 256 else int.from_bytes(digest[1:6], "big") >> 4 & 0xFFFFFFFF
    return place % dim << 1 | digest[1] >> 7


def feature_hash_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """Default embedder: signed token counts in ``dim`` hashed buckets.

    Tokens are cut by Spark; a task hashes the distinct tokens of a bounded slice of its
    rows and adds up the buckets with numpy. No token is shuffled.
    """
    cut = spread(df.select(id_col, text_col), id_col).select(F.col(id_col), tokens(text_col).alias("toks"))
    schema = T.StructType([cut.schema[id_col], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}  # words come back in later slices
        # The vectors of a slice are bounded as its tokens are.
        for batch in (part for whole in batches for part in slices(whole, list_sizes(whole.column(1)) + dim, SLICE_ENTRIES)):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            if len(known) > KNOWN_WORDS:
                known.clear()
            words = coded.dictionary.to_pylist()
            places = np.fromiter((known[t] if t in known else known.setdefault(t, _hashed(t, dim)) for t in words), "int64", len(words))
            bucket, sign = places >> 1, 1.0 - 2.0 * (places & 1)
            code = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), list_sizes(lists))
            flat = np.zeros(batch.num_rows * dim)
            if len(code):
                flat = np.bincount(row * dim + bucket[code], weights=sign[code], minlength=batch.num_rows * dim)
            offsets = pa.array(np.arange(0, len(flat) + 1, dim), type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[id_col, "embedding"])

    return cut.mapInArrow(run, schema)


def embed_batches(
    df: DataFrame, text_col: str, embed_fn: Callable[[pd.Series], list], *, batch: int = 64, out: str = "embedding"
) -> DataFrame:
    """Vectors by a user function that gets at most ``batch`` texts per call.

    A call that returns another number of vectors than texts fails the job.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            vectors: list = []
            for at in range(0, len(pdf), batch):
                texts = pdf[text_col].iloc[at:at + batch]
                got = embed_fn(texts)
                if len(got) != len(texts):
                    raise ValueError(f"embedding count mismatch: {len(got)} for {len(texts)} texts")
                vectors.extend([np.asarray(v, dtype="float32") for v in got])
            yield pdf.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def _keep_best(q: np.ndarray, doc: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (similarity, then id) rows of every query number in ``q``."""
    order = np.lexsort((doc, -sim, q))
    q, doc, sim = q[order], doc[order], sim[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype="int64")
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = rank < k
    return q[keep], doc[keep], sim[keep]


def _sortable(ids: pa.Array) -> np.ndarray:
    """Ids as an array that numpy can sort; strings by code point, as Spark orders them."""
    values = ids.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def knn(
    vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "doc_id", vec_col: str = "embedding",
    query_id: str = "query_id", query_vec: str = "query_embedding", exclude_self: bool = False,
) -> DataFrame:
    """Exact cosine neighbours: ``query_id, doc_id, similarity, rank0``.

    Each task multiplies its vectors with one bounded slice of the queries and
    passes on k rows per query, so no pair table exists. More queries than fit the
    bound mean more passes over the vectors, one after the other, never a larger
    broadcast. Ids keep their types. Rows without a vector take no part; a vector of
    another length than the queries' fails the job.
    """
    spark = vectors.sparkSession
    # Written once: the count, every slice and the vectors' width read the same files.
    asked = materialize(queries.where(F.size(query_vec) > 0).select(
        F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("v")), "knn-queries")
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"),
                      F.min(F.size("v")).alias("least")).first()
    dim = shape["dim"] or 0
    if shape["least"] != shape["dim"]:
        raise ValueError("query vectors differ in length")
    passes = max(1, -(-shape["n"] // max(1, QUERY_SLICE_BYTES // (8 * max(dim, 1)))))
    other = F.raise_error(F.concat(F.lit(f"a vector is not of the queries' length {dim}: id "), F.col(id_col).cast("string")))
    fits = F.lit(dim == 0) | (F.size(vec_col) == dim)
    base = vectors.where(F.size(vec_col) > 0).select(
        F.col(id_col).alias("doc_id"), F.when(fits, F.col(vec_col).cast("array<double>")).otherwise(other).alias("v"))
    schema = T.StructType([asked.schema["query_id"], base.schema["doc_id"], T.StructField("similarity", T.DoubleType())])
    if exclude_self and isinstance(asked.schema["query_id"].dataType, T.StringType) != isinstance(
            base.schema["doc_id"].dataType, T.StringType):
        raise ValueError("exclude_self needs ids of one type")

    def one_pass(part: DataFrame) -> tuple[DataFrame, Broadcast]:
        held = part.toArrow()
        q_mat = held.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, max(dim, 1))
        shared = spark.sparkContext.broadcast(
            (held.column("query_id").combine_chunks(), q_mat, np.sqrt((q_mat * q_mat).sum(axis=1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_ids, mat, norms = shared.value
            ids = _sortable(asked_ids)
            best: dict[int, tuple] = {}  # by block of queries: query number, document, similarity
            parts = (part for whole in batches for part in slices(whole, np.full(whole.num_rows, dim + QUERY_BLOCK), 4 * SLICE_ENTRIES))
            for batch in parts:
                if not len(ids):
                    continue
                doc = _sortable(batch.column(0))
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(doc), dim)
                x_norm = np.sqrt((x * x).sum(axis=1))
                for at in range(0, len(ids), QUERY_BLOCK):
                    stop = at + QUERY_BLOCK
                    scale = x_norm[:, None] * norms[None, at:stop]
                    sim = np.zeros_like(scale)
                    np.divide(x @ mat[at:stop].T, scale, out=sim, where=scale > 0)
                    sim = np.round(sim, 9)
                    if exclude_self:
                        sim[doc[:, None] == ids[None, at:stop]] = -np.inf
                    floor = np.partition(sim, -k, axis=0)[-k] if len(doc) > k else np.full(sim.shape[1], -2.0)
                    d, q = np.nonzero(sim >= np.maximum(floor, -2.0)[None, :])
                    found = q + at, doc[d], sim[d, q]
                    held_best = best.get(at)
                    best[at] = _keep_best(*(found if held_best is None else map(np.concatenate, zip(held_best, found))), k)
            for q, doc, sim in best.values():
                yield pa.RecordBatch.from_arrays(
                    [asked_ids.take(pa.array(q)), pa.array(doc.tolist(), batch.schema.field(0).type), pa.array(sim)],
                    names=["query_id", "doc_id", "similarity"])

        return base.mapInArrow(run, schema), shared

    if passes == 1:
        found, _ = one_pass(asked)
    else:
        # One slice at a time is held by the driver and the executors; each pass is written.
        parts = []
        for i in range(passes):
            rows, shared = one_pass(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i))
            parts.append(materialize(top_k(rows, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], k).drop("rank0"), "knn-pass"))
            shared.destroy()
        found = reduce(DataFrame.unionByName, parts)
    return top_k(found, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], k)


# --- fusion ------------------------------------------------------------------
def fuse(lists: list[DataFrame], k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``query_id, doc_id, rank0`` lists."""
    all_ranks = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "rank0") for x in lists])
    return all_ranks.groupBy("query_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank0"))).alias("rrf_score"))


def merge_ranks(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Full outer merge of two ranked lists, keeping both ranks."""
    f = keyword.select("query_id", "doc_id", F.col("rank0").alias("keyword_rank"))
    v = vector.select("query_id", "doc_id", F.col("rank0").alias("vector_rank"))
    return f.join(v, ["query_id", "doc_id"], "full")


def live(ranked: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Ranked rows whose source is not stale, with source columns attached.

    ``docs`` gives ``doc_id, source``; ``sources`` gives ``source, is_stale`` and more.
    """
    alive = sources.where(~F.col("is_stale")).drop("is_stale")
    return ranked.join(docs.select("doc_id", "source"), "doc_id").join(alive, "source")


def keyword_ranks(scores: DataFrame, fetch_k: int = fixed.FETCH_K) -> DataFrame:
    """Best ``fetch_k`` keyword hits per query with 0-based ranks."""
    return top_k(scores.withColumn("score", F.round("score", 9)), ["query_id"],
                 [F.desc("score"), F.asc("doc_id")], fetch_k)


def _final(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, ["query_id"], [F.desc("rrf_score"), F.asc("doc_id")], k, rank="position")


def hybrid_search(
    keyword: DataFrame, vector: DataFrame, docs: DataFrame, sources: DataFrame, *, top: int = fixed.TOP_K,
) -> DataFrame:
    """Fuse both candidate lists, then drop stale sources, then keep the best.

    Ranks are fixed before the stale filter. Trust is reported but does not order.
    """
    return _final(live(fuse([keyword, vector]), docs, sources), top)


def vector_search(vector: DataFrame, docs: DataFrame, sources: DataFrame, *, top: int = fixed.TOP_K) -> DataFrame:
    """Vector-only search: ranks are counted after the stale filter."""
    kept = live(vector.drop("rank0"), docs, sources)
    ranked = top_k(kept, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], top, rank="position")
    return ranked.withColumn("rrf_score", F.lit(1.0) / (F.lit(float(fixed.RRF_K)) + F.col("position")))


def keyword_search(keyword: DataFrame, docs: DataFrame, sources: DataFrame, *, top: int = fixed.TOP_K) -> DataFrame:
    """Keyword-only search over live sources."""
    kept = live(keyword.drop("rank0"), docs, sources)
    return top_k(kept, ["query_id"], [F.desc("score"), F.asc("doc_id")], top, rank="position")


def search(
    queries: DataFrame, keyword: DataFrame, vector: DataFrame, docs: DataFrame, sources: DataFrame, *, top: int = fixed.TOP_K,
) -> DataFrame:
    """Search as a user asks: hybrid, or vector-only for blank text, or nothing without a vector.

    ``queries``: ``query_id, text, query_embedding``.
    """
    asked = queries.where(F.coalesce(F.size("query_embedding"), F.lit(0)) > 0)
    blank = asked.where(is_blank("text")).select("query_id")
    worded = asked.where(~is_blank("text")).select("query_id")
    columns = ["query_id", "doc_id", "source", "rrf_score", "position"]
    fused = hybrid_search(keyword.join(worded, "query_id", "left_semi"), vector.join(worded, "query_id", "left_semi"), docs, sources, top=top)
    only = vector_search(vector.join(blank, "query_id", "left_semi"), docs, sources, top=top)
    return fused.select(*columns).unionByName(only.select(*columns))


def rerank(
    results: DataFrame, *, score: Column, prior: str, top: int = fixed.TOP_K, ids: str = "doc_id"
) -> DataFrame:
    """Best ``top`` results per query by ``score``.

    A query with no more than ``top`` results keeps its prior order, and so does a
    query for which any score is missing (the scorer failed). Candidate lists are
    bounded by the fetch limit, so the window holds a bounded group.
    """
    group = Window.partitionBy("query_id")
    judged = results.withColumn("rerank_score", score).withColumn("_n", F.count(F.lit(1)).over(group)).withColumn(
        "_missing", F.sum(F.when(F.col("rerank_score").isNull(), 1).otherwise(0)).over(group))
    use_prior = (F.col("_n") <= top) | (F.col("_missing") > 0)
    key = F.when(use_prior, F.col(prior).cast("double")).otherwise(-F.col("rerank_score"))
    return top_k(judged.withColumn("_key", key), ["query_id"], [F.asc("_key"), F.asc(prior), F.asc(ids)], top,
                 rank="position").drop("_n", "_missing", "_key")


def rerank_with(
    results: DataFrame, score_fn: Callable[[list[str], list[str]], list], *, query_text: str, content: str, prior: str,
    top: int = fixed.TOP_K, ids: str = "doc_id", batch: int = 32,
) -> DataFrame:
    """``rerank`` by a function that scores at most ``batch`` pairs of (query text, content) per call.

    Pairs of one query are scored together, in their prior order. A call that fails, gives another
    number of scores than pairs, or a score that is null or not a number, leaves the scores of its
    query null; that query keeps its prior order, and the others are not touched. A query with no
    more than ``top`` results is not scored at all.
    """
    schema = T.StructType([*results.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([prior, ids])
        scores: list = []
        if len(pdf) > top:
            try:
                for at in range(0, len(pdf), batch):
                    part = pdf.iloc[at:at + batch]
                    got = list(score_fn(part[query_text].tolist(), part[content].tolist()))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} scores for {len(part)} pairs")
                    scores += [float("nan") if x is None else float(x) for x in got]
            except Exception:  # noqa: BLE001 - the query keeps its prior order
                scores = []
        whole = len(scores) == len(pdf) and all(np.isfinite(scores))
        return pdf.assign(_score=pd.Series(scores if whole else [None] * len(pdf), index=pdf.index, dtype="Float64"))

    # Candidate lists are bounded by the fetch limit.
    scored = results.groupBy("query_id").applyInPandas(run, schema)
    return rerank(scored, score=F.col("_score"), prior=prior, top=top, ids=ids).drop("_score")


def fetch_size(top: int = fixed.TOP_K) -> int:
    """Candidates to fetch so that reranking can reorder."""
    return max(fixed.FETCH_K, top * fixed.FETCH_MULTIPLIER)
