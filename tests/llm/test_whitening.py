"""Operator 11 against a dense eigensolver, and its solver on difficult matrices."""

import math
import pathlib
from fractions import Fraction

import numpy as np
import pytest

from tidewell.llm import qd, whitening
from tidewell.llm.queries import QUERIES

DATA = pathlib.Path("/root/testdata/sf0.01")
INF, NAN = float("inf"), float("nan")
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, most=16):
    """``{(id, component): (n, deviation, |whitened|, explained)}``, with exact means."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    wide = max({len(v) for _, v in fine}, key=lambda w: (sum(len(v) == w for _, v in fine), w), default=0)
    fine = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in fine if len(v) == wide]
    fit = sorted({x for _, x in fine})
    if not fit:
        return {}
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, total, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in fine:
        own = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, total, strict=True)])
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total, strict=True))
        for k in range(min(most, wide)):
            if values[k] > 1e-10 * max(values[0], 1e-300) and values[0] > 0:
                out.setdefault((i, k + 1), []).append((n, deviation, abs(own @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def check(df, rows, places=8):
    assert df.columns == NAMES
    want, got = brute(rows), {}
    for r in df.collect():
        assert r.identity_error < 1e-4
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert got.keys() == want.keys()
    for key, found in got.items():
        for a, b in zip(sorted(found), sorted(want[key]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=10.0**-places) and a[3] == pytest.approx(b[3], rel=1e-6)


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
def test_the_query_against_a_dense_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, str(DATA)), rows)


def test_odd_rows_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 7) * [9, 4, 2, 1, 1, 1, 0]]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 420)] + rows[:20]  # equal vectors under other ids, and repeated rows
    rows += [(500, None), (501, []), (502, [1.0, None] + [0.0] * 5), (503, [NAN] * 7), (504, [INF] + [0.0] * 6), (505, [0.0] * 7), (None, [0.5] * 7), (506, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "a", 1.0, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, x string, whitened double, id int, component int")
    kept = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    check(whitening.whiten(table.repartition(40)), kept)


def test_tables_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, [])]):
        found = whitening.whiten(spark.createDataFrame(rows, schema))
        assert found.columns == NAMES and found.count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in two) == [(1, 1, 2, 128**2, 1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0)]


def test_very_large_entries(spark):
    """Entries are held at 2^53, and a deviation beyond a long is null."""
    rows = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [1e300, 3.0])]
    found = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found[0, 1].deviation is None and all(math.isfinite(r.whitened) for r in found.values())


def test_deviation_at_the_edge_of_a_long():
    centre = whitening.Centre(3, np.array([0]), np.array([0]))
    root = math.isqrt(2**63 - 1) // 3
    assert centre.deviation(np.array([[root], [root + 1], [-root]])).to_pylist() == [(3 * root) ** 2, None, (3 * root) ** 2]


def matrices():
    rng = np.random.default_rng(0)
    turned = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    yield rng.standard_normal((500, 64))
    yield rng.standard_normal((200, 30)) * 10.0 ** (-0.3 * np.arange(30))
    yield rng.standard_normal((9, 40))
    yield np.eye(20)
    yield np.zeros((4, 6))
    yield np.diag([5.0] * 12 + [1.0] * 18) @ turned
    yield np.diag([5.0] * 3 + [4.9999999] * 10 + [1e-9] * 17) @ turned
    yield np.diag(1 + np.arange(30) * 1e-13) @ turned
    yield rng.standard_normal((5, 1))


@pytest.mark.parametrize("number", range(9))
def test_values_and_directions(number):
    m = list(matrices())[number]
    r = whitening._fold(None, m)
    a, b, right = qd.bidiagonal(r)
    want = np.sort(np.linalg.svd(r, compute_uv=False) ** 2)[::-1]
    top = want[0] or 1.0
    found = np.sort(np.concatenate([qd.dqds(a[s:e], b[s:e - 1]) for s, e in qd._blocks(a, b)]))[::-1]
    assert np.abs(found - want).max() < 1e-13 * top and np.abs(right.T @ right - np.eye(len(a))).max() < 1e-13
    values, vectors = qd.directions(r, 16)
    k = len(values)
    assert k == min(16, int((want > 1e-26 * top).sum())) and np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-13
    assert np.linalg.norm(m.T @ (m @ vectors) - vectors * values, axis=0).max(initial=0) < 1e-12 * top


def test_small_values_are_relatively_accurate():
    """Squares of singular values of a graded bidiagonal matrix, against exact arithmetic's determinant and trace of the inverse."""
    a, b = 10.0 ** -np.arange(12.0), 10.0 ** -np.arange(11.0) * 0.3
    found = qd.dqds(a, b)
    assert np.prod(found) == pytest.approx(np.prod(a) ** 2, rel=1e-12)
    inverse = np.zeros((12, 12))
    for j in range(12):  # columns of the inverse by back substitution, without subtraction of like signs
        inverse[j, j] = 1 / a[j]
        for i in range(j - 1, -1, -1):
            inverse[i, j] = -b[i] * inverse[i + 1, j] / a[i]
    assert np.sum(1 / found) == pytest.approx((inverse**2).sum(), rel=1e-12)
