"""A stored keyword index: tables of postings that are read by the words of a query and changed document by document.

An index is a folder of Parquet tables. Each change adds one segment to them, and is visible from
the moment its commit row is written:

* ``postings``: term, document, its length, positions; a folder for each bucket of terms, sorted by term.
* ``blocks``: by term and block of documents, the change in the number of documents, the largest
  count of the term and the shortest document. Blocks are dealt by a hash of the document id.
* ``removed``: documents whose postings in earlier segments no longer count.
* ``commits``: by change, the change in the number of documents and of their tokens.

A search reads the buckets of its terms and the commits, never the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.operators.retrieval import build_postings, query_phrases
from tidewell.plans.segments import Segments, without_removed
from tidewell.plans.topk import top_k
from tidewell.session import materialize

#: Folders of terms by default; documents of a block, and of a stripe (terms of a bucket are dealt over as many tasks as stripes).
BUCKETS = 64
BLOCK_DOCS = 4096
STRIPE_DOCS = 1_000_000
#: Tasks, at least, that postings are dealt to where there are as many blocks and buckets.
LEAST_TASKS = 256
#: Documents whose postings a task sorts, so that it does not spill them; up to FEW_TASKS tasks Spark deals by itself.
#: To more than MOST_TASKS a sending task would sort and spill them too (spark.shuffle.sort.bypassMergeThreshold).
TASK_DOCS = 2048
FEW_TASKS, MOST_TASKS = 8, 200
#: Pieces of a stripe of a bucket, which lie side by side in a task or in neighbouring ones.
PIECES = 32
#: Blocks of a query that are scored first, to learn what the others must reach.
FIRST_BLOCKS = 2
#: Scores are compared after rounding to so many digits.
DIGITS = 9

COLUMNS = {
    "postings": {"term": "string", "block": "int", "doc_id": "", "doc_len": "int", "positions": "array<int>", "tf": "int", "bucket": "int"},
    "blocks": {"term": "string", "block": "int", "docs": "bigint", "max_tf": "int", "min_len": "int", "tokens": "bigint", "bucket": "int"},
    "removed": {"doc_id": ""},
}


@dataclass(frozen=True)
class Corpus:
    """Live documents and their tokens."""

    n_docs: int
    total_len: int

    def weight(self, df: Column) -> Column:
        raw = F.log((self.n_docs - df + 0.5) / (df + 0.5))
        return F.when(raw <= 0, F.lit(fixed.BM25_IDF_FLOOR)).otherwise(raw)

    def part(self, idf: Column, tf: Column, doc_len: Column) -> Column:
        k1, b = F.lit(fixed.BM25_K1), F.lit(fixed.BM25_B)
        norm = doc_len / F.lit(self.total_len / self.n_docs if self.n_docs else 1.0)
        return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * norm))


@dataclass(frozen=True)
class SearchIndex:
    """Where an index lies, the numbers of blocks and buckets it was made with, and the type of its document ids."""

    spark: SparkSession
    root: str
    blocks: int
    buckets: int
    id_type: str

    @property
    def segments(self) -> Segments:
        return Segments(self.spark, self.root)

    def read(self, table: str) -> DataFrame:
        """One table of all committed segments."""
        return self.segments.read(table, {name: kind or self.id_type for name, kind in COLUMNS[table].items()})

    def corpus(self) -> Corpus:
        row = self.segments.notes().agg(F.sum("n_docs").alias("n"), F.sum("total_len").alias("w")).first()
        return Corpus(row["n"], row["w"])

    def bucket_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def live_postings(self, terms: DataFrame, *columns: str) -> DataFrame:
        """Postings that count, of the terms in ``terms`` (``term, bucket`` and more), beside its columns."""
        buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most as many as there are
        held = self.read("postings").where(F.col("bucket").isin(buckets)).select("segment", "bucket", "term", "block", "doc_id", "doc_len", *columns)
        return without_removed(held.join(terms, ["bucket", "term"]), self.read("removed"), "doc_id").drop("segment", "bucket")


def create_index(docs: DataFrame, root: str, *, doc_id: str = "doc_id", doc_text: str = "text", blocks: int | None = None,
                 buckets: int = BUCKETS) -> SearchIndex:
    """An index of ``docs`` (ids are unique; null texts do not count) in the folder ``root``, as its change 0.

    ``blocks`` is the number of parts that documents are dealt to, now and later; by default one for
    each ``BLOCK_DOCS`` documents. A search reads the folders (``buckets``) of its terms.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    index = SearchIndex(docs.sparkSession, root.rstrip("/"), blocks or max(1, -(-docs.count() // BLOCK_DOCS)), buckets, kind)
    change_index(index, 0, added=rows, removed=rows.limit(0))
    return index


def open_index(spark: SparkSession, root: str) -> SearchIndex:
    """The index that lies in ``root``."""
    row = spark.read.parquet(f"{root.rstrip('/')}/commits/v0").first()
    return SearchIndex(spark, root.rstrip("/"), row["blocks"], row["buckets"], row["id_type"])


def change_index(index: SearchIndex, version: int, *, added: DataFrame, removed: DataFrame) -> bool:
    """Adds ``added`` and takes out ``removed`` (``doc_id, text`` as it was indexed); says whether anything was done.

    A replaced document is in both. A change with the number of a committed one is not applied
    again; one that was not finished is written anew. Only the changed documents are read and written.
    """
    segments = index.segments
    if version in segments.versions():
        return False
    added, removed = (x.select("doc_id", "text").where(F.col("text").isNotNull()) for x in (added, removed))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(index.blocks)).cast("int").alias("block")

    def postings(rows: DataFrame) -> DataFrame:
        return build_postings(rows, "doc_id", "text").select("term", block, "doc_id", "doc_len", "positions", "tf", index.bucket_of(F.col("term")).alias("bucket"))

    n_added = added.count()
    written = segments.write(_dealt(index, postings(added), n_added), "postings", version, ["bucket"])
    gone = postings(removed).select("bucket", "term", "block", F.lit(-1).alias("one"), "tf", "doc_len")
    blocks = segments.write(_blocks(written.select("bucket", "term", "block", F.lit(1).alias("one"), "tf", "doc_len").unionByName(gone)), "blocks", version, ["bucket"])
    segments.write(removed.select("doc_id").distinct(), "removed", version)
    _commit(index, version, n_added - removed.count(), blocks)
    return True


def compact(index: SearchIndex, root: str) -> SearchIndex:
    """The same index as a single segment in a new folder; texts are not read again."""
    whole = replace(index, root=root.rstrip("/"))
    live = without_removed(index.read("postings"), index.read("removed"), "doc_id").drop("segment")
    n_docs = index.corpus().n_docs
    written = whole.segments.write(_dealt(index, live, n_docs), "postings", 0, ["bucket"])
    blocks = whole.segments.write(_blocks(written.withColumn("one", F.lit(1))), "blocks", 0, ["bucket"])
    whole.segments.write(index.read("removed").select("doc_id").limit(0), "removed", 0)
    _commit(whole, 0, n_docs, blocks)
    return whole


def _dealt(index: SearchIndex, postings: DataFrame, docs: int = 0) -> DataFrame:
    """Postings of a bucket side by side, in as many tasks as there are stripes of documents.

    An index of few buckets has as many tasks as one of many: a task that sorts a large share of all postings spills them.
    The number of tasks follows that of the documents (``docs``), whatever the session's shuffle partitions and the blocks are.
    """
    stripes = min(index.blocks, max(-(-index.blocks * BLOCK_DOCS // STRIPE_DOCS), -(-LEAST_TASKS // index.buckets)))
    # What follows from other columns does not travel.
    follows = {"tf": F.size(F.col("positions")), "bucket": index.bucket_of(F.col("term"))}
    again = {c: x for c, x in follows.items() if c in postings.columns}
    bucket, stripe = index.bucket_of(F.col("term")), F.pmod("block", F.lit(stripes))
    # A hash of its own, as the documents of a stripe share some of the bits of theirs.
    piece = F.pmod(F.xxhash64("doc_id", F.lit(PIECES)), F.lit(PIECES)).cast("int")
    tasks, sent = -(-docs // TASK_DOCS), postings.drop(*again)
    if tasks > FEW_TASKS:
        pieces = index.buckets * stripes * PIECES
        of_task = -(-pieces // min(tasks, MOST_TASKS))
        sent = sent.repartitionById(-(-pieces // of_task), F.floor(((bucket * stripes + stripe) * PIECES + piece) / of_task).cast("int"))
    else:
        sent = sent.repartition(bucket, stripe)
    return sent.withColumns(again).select(*postings.columns).sortWithinPartitions("bucket", "term", "block", "doc_id")


def _blocks(postings: DataFrame) -> DataFrame:
    """Sums by term and block; ``one`` is -1 for documents that go, which bound nothing."""
    comes = F.col("one") > 0
    return postings.groupBy("term", "block", "bucket").agg(
        F.sum("one").cast("long").alias("docs"), F.max(F.when(comes, F.col("tf"))).alias("max_tf"),
        F.min(F.when(comes, F.col("doc_len"))).alias("min_len"), F.sum(F.col("one") * F.col("tf")).cast("long").alias("tokens"),
    ).select("term", "block", "docs", "max_tf", "min_len", "tokens", "bucket").repartition("bucket").sortWithinPartitions("bucket", "term")


def _commit(index: SearchIndex, version: int, n_docs: int, blocks: DataFrame) -> None:
    note = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_len"))
    index.segments.commit(version, note.select(
        F.lit(n_docs).cast("long").alias("n_docs"), "total_len", F.lit(index.blocks).alias("blocks"), F.lit(index.buckets).alias("buckets"),
        F.lit(index.id_type).alias("id_type")))


# --- searching -----------------------------------------------------------------
def _terms(index: SearchIndex, phrases: DataFrame) -> DataFrame:
    """``phrase, n, offset, term, bucket`` of distinct phrases (``phrase, terms``)."""
    return phrases.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term")).withColumn("bucket", index.bucket_of(F.col("term")))


def _together(found: DataFrame) -> DataFrame:
    """Documents that hold the terms of a phrase side by side, from postings beside ``phrase, n, offset``."""
    parts = found.groupBy("phrase", "n", "block", "doc_id", "doc_len").agg(
        F.collect_list(F.transform("positions", lambda p: p - F.col("offset"))).alias("starts"))  # at most n lists
    shared = F.reduce(F.slice("starts", F.lit(2), F.size("starts")), F.get("starts", F.lit(0)), F.array_intersect)
    return parts.where(F.size("starts") == F.col("n")).select("phrase", "block", "doc_id", "doc_len", F.size(shared).alias("tf")).where(F.col("tf") > 0)


def hits(index: SearchIndex, phrases: DataFrame) -> DataFrame:
    """``phrase, block, doc_id, doc_len, tf`` of the distinct ``phrase, terms``; positions are read for phrases of several terms only."""
    terms = _terms(index, phrases)
    alone = index.live_postings(terms.where("n = 1").select("phrase", "term", "bucket"), "tf").select("phrase", "block", "doc_id", "doc_len", "tf")
    several = index.live_postings(terms.where("n > 1").select("phrase", "n", "offset", "term", "bucket"), "positions")
    return alone.unionByName(_together(several))


def _plans(phrases: DataFrame, df_: DataFrame, corpus: Corpus) -> DataFrame:
    """``query_id, rarest, held``: a row for each query all of whose phrases are met; ``held`` lists its phrases and their weights."""
    per_query = phrases.select("query_id", "phrase").join(df_, "phrase", "left")
    return per_query.groupBy("query_id").agg(
        F.min_by("phrase", F.struct(F.coalesce("df", F.lit(0)), "phrase")).alias("rarest"), F.min(F.coalesce("df", F.lit(0))).alias("least"),
        F.collect_list(F.struct("phrase", corpus.weight(F.col("df")).alias("idf"))).alias("held")).where("least > 0").drop("least")


def _scored(asked: DataFrame, found: DataFrame, corpus: Corpus) -> DataFrame:
    """``query_id, doc_id, score``: the documents of the rarest phrase, looked up for the others; from ``query_id, rarest, held`` (and ``block``)."""
    by_block = "block" in asked.columns
    proposed = found.select(F.col("phrase").alias("rarest"), "block", "doc_id")
    candidates = asked.join(proposed if by_block else proposed.drop("block"), ["rarest", "block"] if by_block else ["rarest"])
    wanted = candidates.select("query_id", "doc_id", F.size("held").alias("needed"), F.explode("held").alias("p")).select("query_id", "doc_id", "needed", "p.*")
    part = corpus.part(F.col("idf"), F.col("tf"), F.col("doc_len"))
    return wanted.join(found.select("phrase", "doc_id", "doc_len", "tf"), ["phrase", "doc_id"]).groupBy("query_id", "doc_id", "needed").agg(
        F.sum(part).alias("score"), F.count(F.lit(1)).alias("got")).where("got = needed").select("query_id", "doc_id", "score")


def search_scores(index: SearchIndex, queries: DataFrame, *, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """``query_id, doc_id, score`` of every document that holds *every* phrase of a query; as ``retrieval.bm25`` gives them."""
    phrases = query_phrases(queries, query_id, query_text)
    found = materialize(hits(index, phrases.select("phrase", "terms").distinct()), "phrase-hits")
    corpus = index.corpus()
    return _scored(_plans(phrases, found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")), corpus), found, corpus)


def _bounds(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """``phrase, block, docs, tf, len``: no document of the block has more, or is shorter; blocks without one of the terms have no row."""
    buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most as many as there are
    held = index.read("blocks").where(F.col("bucket").isin(buckets)).join(terms, ["bucket", "term"])
    held = held.groupBy("phrase", "n", "offset", "block").agg(
        F.sum("docs").alias("docs"), F.max("max_tf").alias("tf"), F.min("min_len").alias("len"))
    return held.where("docs > 0").groupBy("phrase", "n", "block").agg(
        F.count(F.lit(1)).alias("got"), F.min("docs").alias("docs"), F.min("tf").alias("tf"), F.max("len").alias("len")).where("got = n").drop("got")


def search_top(index: SearchIndex, queries: DataFrame, k: int, *, query_id: str = "query_id", query_text: str = "text",
               first_blocks: int = FIRST_BLOCKS, read: list | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank0``: the ``k`` best of ``search_scores`` (score to 9 digits, then id), reading fewer postings.

    A block of documents is left out if it lacks a phrase of the query, or if even a document with
    the largest counts and the smallest length of the block would stay behind the k-th best score
    of the blocks that promise most. ``read`` collects (pairs of query and block scored, pairs that
    hold all phrases) for tests.
    """
    phrases = materialize(query_phrases(queries, query_id, query_text), "phrases")
    distinct = phrases.select("phrase", "terms").distinct()
    terms, corpus = _terms(index, distinct), index.corpus()
    bounds = materialize(_bounds(index, terms), "bounds")
    several = materialize(_together(index.live_postings(terms.where("n > 1").select("phrase", "n", "offset", "term", "bucket"), "positions")), "phrase-hits")
    df_ = bounds.where("n = 1").groupBy("phrase").agg(F.sum("docs").alias("df")).unionByName(
        several.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")))
    # Blocks of the rarest phrase only, so that a common word brings in nothing.
    plans = _plans(phrases, df_, corpus)
    there = plans.join(bounds.select(F.col("phrase").alias("rarest"), "block"), "rarest")
    looked = there.select("query_id", "block", F.size("held").alias("needed"), F.explode("held").alias("p")).select("query_id", "block", "needed", "p.*")
    reach = looked.join(bounds.select("phrase", "block", "tf", "len"), ["phrase", "block"]).groupBy("query_id", "block", "needed").agg(
        F.sum(corpus.part(F.col("idf"), F.col("tf"), F.col("len"))).alias("most"), F.count(F.lit(1)).alias("got")).where("got = needed")
    pairs = materialize(there.join(reach.select("query_id", "block", "most"), ["query_id", "block"]), "pairs")

    def score(asked: DataFrame, label: str) -> DataFrame:
        need = asked.select("block", F.explode("held.phrase").alias("phrase")).distinct()
        single = terms.where("n = 1").select("phrase", "term", "bucket")
        alone = index.live_postings(single, "tf").select("phrase", "block", "doc_id", "doc_len", "tf")
        found = materialize(alone.unionByName(several).join(need, ["phrase", "block"], "left_semi"), label)
        return _scored(asked.select("query_id", "block", "rarest", "held"), found, corpus).withColumn("score", F.round("score", DIGITS))

    order = [F.desc("score"), F.asc("doc_id")]
    promising = materialize(top_k(pairs, ["query_id"], [F.desc("most"), F.asc("block")], first_blocks), "promising")
    best = materialize(top_k(score(promising, "first-hits"), ["query_id"], order, k), "first")
    floor = best.where(F.col("rank0") == k - 1).select("query_id", F.col("score").alias("floor"))
    rest = pairs.join(promising.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
    rest = materialize(rest.where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - 10.0**-DIGITS)), "rest")
    if read is not None:
        read.append((promising.count() + rest.count(), pairs.count()))
    return top_k(best.drop("rank0").unionByName(score(rest, "more-hits")), ["query_id"], order, k)
