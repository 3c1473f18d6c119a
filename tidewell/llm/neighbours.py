"""Operator 4: nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize

#: Trees, and bits of the hash string of a vector in each.
TREES = 64
BITS = 24
#: A query ascends until the trees together offer this share of a block's rows (with repetition), or LEAST rows.
SHARE = 0.9
LEAST = 2000
#: Rows of an index block and queries of a slice; a task holds one of each.
BLOCK = 8192
SLICE = 8192
SEED = 20240117


def projections(dim: int, trees: int, bits: int) -> np.ndarray:
    """Random hyperplanes; with one more component than the vectors, see ``HashForest``."""
    return np.random.default_rng(SEED).standard_normal((dim + 1, trees * bits))


class HashForest:
    """Sorted arrays of hash strings, one for each tree, over the vectors of a block.

    A string has one bit for each side of a random hyperplane. Vectors get one more component
    that brings all of them to one length, so that the largest inner product is the smallest
    angle; queries have 0 there.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.ids, self.vectors, self.trees, self.bits = ids, vectors, trees, bits
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.planes = projections(vectors.shape[1], trees, bits)
        hashes = self._hash(vectors, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0)))
        self.order = np.argsort(hashes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=0)

    def _hash(self, vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash strings as numbers, a column for each tree; the first bit weighs most."""
        out = np.zeros((len(vectors), self.trees), np.int64)
        for at in range(0, len(vectors), 2048):
            part = slice(at, at + 2048)
            sides = (vectors[part] @ self.planes[:-1] + last[part, None] * self.planes[-1]) > 0
            out[part] = sides.reshape(-1, self.trees, self.bits) @ (1 << np.arange(self.bits - 1, -1, -1))
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float = SHARE, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, k columns, best first; missing ones have the score minus infinity.

        Descends to the longest prefix that a query shares with rows of a tree and ascends in all
        trees at once, bit by bit, until they hold enough rows; these are compared exactly.
        """
        n, best = len(self.ids), (np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, np.int64))
        if not n or not len(queries):
            return best
        own = self._hash(queries, np.zeros(len(queries)))
        wanted, level, open_ = max(least, int(share * n)), np.zeros(len(queries), np.int64), np.ones(len(queries), bool)
        for depth in range(self.bits, 0, -1):
            if not open_.any():
                break
            shift = self.bits - depth
            held = np.zeros(open_.sum(), np.int64)
            for t in range(self.trees):
                low = own[open_, t] >> shift << shift
                held += np.searchsorted(self.sorted[:, t], low + (1 << shift)) - np.searchsorted(self.sorted[:, t], low)
            enough = np.flatnonzero(open_)[held >= wanted]
            level[enough], open_[enough] = depth, False
        # A query that no prefix gives enough rows meets all rows, once.
        for t in range(self.trees):
            ids, vectors = self.ids[self.order[:, t]], self.vectors[self.order[:, t]]
            shift = self.bits - level
            low = own[:, t] >> shift << shift
            first = np.searchsorted(self.sorted[:, t], low)
            last = np.searchsorted(self.sorted[:, t], low + (np.int64(1) << shift))
            if t:
                last = np.where(level == 0, first, last)
            else:
                first, last = np.where(level == 0, 0, first), np.where(level == 0, n, last)
            by_node = np.lexsort((last, first))
            cuts = np.flatnonzero(np.r_[True, (np.diff(first[by_node]) != 0) | (np.diff(last[by_node]) != 0), True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                q = by_node[a:b]
                x, y = first[q[0]], last[q[0]]
                if x < y:
                    for at in range(0, len(q), 512):
                        self._keep(best, q[at:at + 512], query_ids, queries[q[at:at + 512]] @ vectors[x:y].T, ids[x:y], k)
        return best

    @staticmethod
    def _keep(best, q: np.ndarray, query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        scores = np.where(ids[None, :] == query_ids[q][:, None], -np.inf, scores)
        if scores.shape[1] > k:
            # Rows tied with the k-th must all be seen: the smallest ids among them count.
            kth = np.partition(scores, -k, axis=1)[:, -k]
            wide = int((scores >= kth[:, None]).sum(1).max())
            top = np.argpartition(scores, -wide, axis=1)[:, -wide:] if wide < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(q), 1))
            scores, ids = np.take_along_axis(scores, top, axis=1), ids[top]
        else:
            ids = np.tile(ids, (len(q), 1))
        merge_best(best, q, scores, ids, k)


def merge_best(best, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Keep the k best of what was kept and what is new; an id counts once, ties go to the smaller id."""
    s, i = np.concatenate([best[0][q], scores], axis=1), np.concatenate([best[1][q], ids], axis=1)
    order = np.lexsort((i, -s), axis=1)
    s, i = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
    # A row met in two trees may differ in the last place of its score, but then stands next to itself or a tie of it.
    by_id = np.argsort(i, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(i, by_id, axis=1)
    twice = np.zeros(i.shape, bool)
    np.put_along_axis(twice, by_id, np.concatenate([np.zeros((len(q), 1), bool), sorted_ids[:, 1:] == sorted_ids[:, :-1]], axis=1), axis=1)
    s = np.where(twice, -np.inf, s)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    best[0][q], best[1][q] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision, the same for equal vectors wherever they stand."""
    return np.fromiter((float(np.dot(x, y)) for x, y in zip(a, b, strict=True)), np.float64, len(a))


def _long(value: int):
    return F.lit(value).cast("long")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            share: float = SHARE, least: int = LEAST, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """``query_id long, rank int, vec_id long, score double``: the k rows of largest inner product found for each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's
    own. Rows with a null id, and vectors that are null, zero or hold null, NaN or infinite
    components take no part; vectors of another length than the query's are no candidates.
    Repeated rows count once; of different vectors under one id the smallest counts. Of equal
    vectors only the k + 1 smallest ids can be among the k nearest, so the others are left out
    of the index: that loses nothing. An empty table gives no rows.

    Rows are dealt into blocks, each with its own forest, and queries into slices; every slice
    meets every block in a task of its own, which returns k rows a query.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    rows = materialize(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")), "vectors")
    from pyspark.sql.window import Window

    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    index = rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1).select("id", "v", "d")
    asked = rows.filter(F.col("id") % every == 0)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    blocks, slices = max(1, -(-size.n // block)), max(1, -(-size.q // slice_))
    placed = index.select("d", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("x"),
                          F.explode(F.sequence(_long(0), _long(slices - 1))).alias("y"), F.lit(False).alias("ask"), "id", "v")
    sent = asked.select("d", F.explode(F.sequence(_long(0), _long(blocks - 1))).alias("x"),
                        F.pmod(F.xxhash64("id"), F.lit(slices)).alias("y"), F.lit(True).alias("ask"), "id", "v")

    def search(group: pa.Table) -> pa.Table:
        ask, ids = group.column("ask").to_numpy(zero_copy_only=False), group.column("id").to_numpy()
        values = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids[~ask])
        own_ids, own = ids[~ask][order], values[~ask][order]
        query_ids, queries = ids[ask], values[ask]
        scores, found = HashForest(own_ids, own).search(query_ids, queries, k, share, least)
        q, c = np.nonzero(np.isfinite(scores))
        hit = found[q, c]
        return pa.table({"query_id": query_ids[q], "vec_id": hit, "score": exact(queries[q], own[np.searchsorted(own_ids, hit)])})

    found = placed.unionByName(sent).groupBy("d", "x", "y").applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id"), "score")
