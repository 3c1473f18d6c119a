"""Operator 9 against all pairs."""

import random

import numpy as np
import pytest

from tidewell.llm import jaccard as J
from tidewell.llm.components import components


def brute(texts, ids, width, p, q):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * q >= p * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted(((ids[i], len(s), least.get(find(i)) if s else ids[i]) for i, s in enumerate(sets)), key=str)


def corpus(rng, n, vocabulary=400, lengths=(1, 60)):
    words = [f"w{i}" for i in range(vocabulary)] + ["Été", "ABC", "x\x1cy"]
    texts = [None, "", " \n\t ", "one", "one two", "ONE TWO", "one  two\n", "tie"]
    passage = " ".join(rng.choice(words) for _ in range(50))
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.3 or len(texts) < 12:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(*lengths)))
            texts.append(t + " " + passage if rng.random() < 0.3 else t)
        else:
            w = (rng.choice(texts) or "z").split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("width", "p", "q", "block", "lengths"), [
    (3, 9, 10, 4096, (1, 60)), (3, 9, 10, 7, (1, 60)), (5, 4, 5, 4096, (5, 150)), (5, 4, 5, 20, (5, 150)), (1, 4, 5, 4096, (1, 25))])
def test_components_against_all_pairs(spark, width, p, q, block, lengths):
    rng = random.Random(width * 100 + block)
    texts = corpus(rng, 350, lengths=lengths)
    ids = [i * 7 % 1000 for i in range(len(texts))]
    ids[20], ids[30], ids[40] = None, ids[29], None
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, key int, hub string")
    got = J.jaccard_components(df, width=width, p=p, q=q, block_sets=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(texts, ids, width, p, q)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(600):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r) for r in J.jaccard_components(df, block_sets=100).collect()), key=str)
    assert got == brute(texts, list(range(600)), 3, 9, 10)


@pytest.mark.parametrize("tasks", [1, 2])
def test_links_of_sets_behind_different_hubs(spark, tasks):
    # Two linked texts in two batches; in each, texts with smaller keys that link to nothing share all of their parts.
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]

    def key(t):
        return J.short_key(J.set_key(J.shingles(t, 3, J._words())))

    linked = sorted((" ".join([*base, f"k{i}"]) for i in range(200)), key=key)[-2:]
    hubs = []
    while len(hubs) < 60:
        w = list(base)
        for at in rng.sample(range(5, 295), 11):
            w[at] = f"e{len(hubs)}x{at}"
        if key(" ".join(w)) < min(map(key, linked)):
            hubs.append(" ".join(w))
    texts = [linked[0], *hubs[:30], linked[1], *hubs[30:]]
    want = brute(texts, list(range(62)), 3, 9, 10)
    assert [r for r in want if r[0] != r[2]] == [(31, 299, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "31")
    try:
        df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), tasks), "doc_id long, text string")
        got = sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_every_linked_pair_shares_a_part():
    rng = np.random.default_rng(4)
    for p, q in ((9, 10), (4, 5)):
        for _ in range(600):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = int(rng.integers(0, max(1, len(a) * (q - p) // q) + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1))).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if len(b) and shared * q >= p * (len(a) + len(b) - shared):
                assert len(np.intersect1d(J.signatures(a, p, q), J.signatures(b, p, q)))


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = []
    for _ in range(300):
        if sets and rng.random() < 0.7:
            s = sets[rng.integers(len(sets))]
            sets.append(np.unique(np.concatenate([s[rng.random(len(s)) > 0.04], rng.choice(pool, 2)])))
        else:
            sets.append(np.unique(rng.choice(pool, int(rng.integers(1, 300)))))
    for blocks in ([sets], [sets[:130], sets[130:]]):
        forest, all_pairs = J.Forest(300), J.Forest(300)
        for i, j in J.tree_links(blocks, 9, 10):
            forest.union(i, j)
        for i in range(300):
            for j in range(i):
                if len(blocks) == 2 and (i < 130) == (j < 130):
                    continue
                shared = len(np.intersect1d(sets[i], sets[j]))
                if shared * 10 >= 9 * (len(sets[i]) + len(sets[j]) - shared):
                    all_pairs.union(i, j)
        assert np.array_equal(forest.roots(), all_pairs.roots())


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(300, 300), (None, 4), (200, 201), (201, 202), (202, 200)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {i: 200 for i in (200, 201, 202)}
