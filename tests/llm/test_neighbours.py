"""Operator 4 against all inner products."""

import pathlib

import numpy as np
import pytest

from tidewell.llm import neighbours

DATA = pathlib.Path("/root/testdata/sf0.1/embeddings.parquet")
INF, NAN = float("inf"), float("nan")


def brute(ids, vectors, k, every=20):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % every == 0:
            ranked = sorted((-float(np.dot(v, w)), j) for j, w in zip(ids, vectors, strict=True) if j != i)
            out[i] = [(j, -s) for s, j in ranked[:k]]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize(("block", "slice_"), [(8192, 8192), (50, 4)])
def test_small_tables_are_exact(spark, block, slice_):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.integers(-3, 4, 6)] for _ in range(200)]
    vectors = [v if any(v) else [1.0] * 6 for v in vectors]
    for i in range(100, 160):
        vectors[i] = vectors[7]  # a large group of equal vectors
    ids = [int(i) for i in rng.permutation(400)[:200]]
    rows = [(i, v, "x") for i, v in zip(ids, vectors, strict=True)]
    rows += rows[:5] + [(1000, None, "x"), (1020, [0.0] * 6, "x"), (1040, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (1060, [NAN] + [1.0] * 5, "x"),
                        (1080, [INF] + [1.0] * 5, "x"), (None, [1.0] * 6, "x"), (1100, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    assert collected(neighbours.nearest(df, block=block, slice_=slice_)) == brute(ids, vectors, 20)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    got = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 2.0]), (2, [1.0, 2.0, 3.0])], schema)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.5)]


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
def test_recall_on_the_table(spark):
    df = spark.read.parquet(str(DATA))
    rows = df.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = collected(neighbours.nearest(df))
    hits = 0
    for i, found in got.items():
        scores = vectors @ vectors[ids == i][0]
        scores[ids == i] = -np.inf
        hits += len({j for j, _ in found} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert len(got) == 100 and hits / (20 * len(got)) >= 0.93
