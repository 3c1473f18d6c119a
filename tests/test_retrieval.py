import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import retrieval as R
from tidewell.operators import trust as TR


@pytest.fixture
def docs(spark):
    rows = [(1, "s1", "Sword proc rate is high, don't stack"), (2, "s1", "proc chance of a sword"), (3, "s2", "Nothing here. DON T"),
            (4, "s2", "t don and sword PROC proc"), (5, "s3", "café résumé sword proc")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def search(docs, *texts):
    spark = docs.sparkSession
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = R.bm25(docs, q, doc_id="doc_id", doc_text="text", query_id="query_id", query_text="text").collect()
    return {(r.query_id, r.doc_id): r.score for r in got}


def brute(docs, terms):
    toks = {r.doc_id: r.t for r in docs.select("doc_id", F.split(F.regexp_replace(F.lower("text"), "[^a-zé ]", " "), " +").alias("t")).collect()}
    toks = {d: [x for x in t if x] for d, t in toks.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for d, t in toks.items():
        if all(x in t for x in terms):
            s = 0.0
            for x in terms:
                df = sum(x in y for y in toks.values())
                idf = max(np.log((n - df + .5) / (df + .5)), 1e-6) if np.log((n - df + .5) / (df + .5)) > 0 else 1e-6
                f = t.count(x)
                s += idf * f * 2.2 / (f + 1.2 * (.25 + .75 * len(t) / avg))
            out[d] = s
    return out


def test_bm25_needs_every_term_and_equals_brute_force(docs):
    got = search(docs, "sword proc", "proc chance", "missing sword", "!!! ...")
    assert {d: pytest.approx(s) for (q, d), s in got.items() if q == 0} == brute(docs, ["sword", "proc"])
    assert {d for q, d in got if q == 1} == {2}
    assert not {d for q, d in got if q > 1}


def test_inner_punctuation_is_a_phrase_in_order(docs):
    got = search(docs, "don't", "CAFE resume")
    assert {d for q, d in got if q == 0} == {1, 3}
    assert {d for q, d in got if q == 1} == {5}


def test_postings(docs):
    rows = {(r.term, r.doc_id): (r.tf, r.positions, r.doc_len) for r in R.build_postings(docs, "doc_id", "text").collect()}
    assert rows[("proc", 4)] == (2, [4, 5], 6) or rows[("proc", 4)][0] == 2
    assert rows[("t", 4)][1] == [0] and rows[("cafe", 5)][0] == 1


@pytest.mark.parametrize("slice_bytes", [64 * 1024 * 1024, 8 * 8 * 3])
def test_knn_equals_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(R, "QUERY_SLICE_BYTES", slice_bytes)
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(10, 8))
    x[250:] = x[0]  # many equal vectors: ties go by id
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, query_embedding array<double>")
    got = {(r.query_id, r.rank0): r.doc_id for r in R.knn(vec, qs, 7).collect()}
    sim = np.round(x @ q.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(q, axis=1)[None, :], 9)
    for j in range(10):
        want = np.lexsort((np.arange(300), -sim[:, j]))[:7]
        assert [got[(j, r)] for r in range(7)] == want.tolist()


def test_fusion(spark):
    a = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "query_id int, doc_id int, rank0 int")
    b = spark.createDataFrame([(0, 1, 0), (0, 3, 1)], "query_id int, doc_id int, rank0 int")
    got = {r.doc_id: r.rrf_score for r in R.fuse([a, b]).collect()}
    assert got == {1: pytest.approx(2 / 60), 2: pytest.approx(1 / 61), 3: pytest.approx(1 / 61)}
    assert R.fuse([a.limit(0), b.limit(0)]).count() == 0


def test_hybrid_keeps_ranks_of_stale_candidates(spark):
    docs = spark.createDataFrame([(1, "old"), (2, "new"), (3, "new")], "doc_id int, source string")
    src = spark.createDataFrame([("old", True, 0.5), ("new", False, 0.5)], "source string, is_stale boolean, trust_score double")
    kw = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "query_id int, doc_id int, rank0 int")
    vec = spark.createDataFrame([(0, 1, .9, 0), (0, 3, .8, 1), (0, 2, .7, 2)], "query_id int, doc_id int, similarity double, rank0 int")
    got = R.hybrid_search(kw, vec, docs, src).orderBy("position").collect()
    assert [(r.doc_id, round(r.rrf_score, 9)) for r in got] == [(2, round(1 / 61 + 1 / 62, 9)), (3, round(1 / 61, 9))]
    only = R.vector_search(vec, docs, src).orderBy("position").collect()
    assert [(r.doc_id, round(r.rrf_score, 9)) for r in only] == [(3, round(1 / 60, 9)), (2, round(1 / 61, 9))]


def test_search_routes(spark):
    docs = spark.createDataFrame([(1, "old"), (2, "new"), (3, "new")], "doc_id int, source string")
    src = spark.createDataFrame([("old", True), ("new", False)], "source string, is_stale boolean")
    q = spark.createDataFrame([(0, "w", [1.0]), (1, "  ", [1.0]), (2, "w", []), (3, "w", None), (4, "!?", [1.0])], "query_id int, text string, query_embedding array<double>")
    kw = spark.createDataFrame([(i, 2, 0) for i in (0, 2, 3)], "query_id int, doc_id int, rank0 int")
    vec = spark.createDataFrame([(i, d, 1.0 / d, d - 1) for i in (0, 1, 4) for d in (1, 2, 3)], "query_id int, doc_id int, similarity double, rank0 int")
    got = {(r.query_id, r.doc_id): round(r.rrf_score, 9) for r in R.search(q, kw, vec, docs, src).collect()}
    assert got == {(0, 2): round(1 / 60 + 1 / 61, 9), (0, 3): round(1 / 62, 9), (1, 2): round(1 / 60, 9), (1, 3): round(1 / 61, 9),
                   (4, 2): round(1 / 61, 9), (4, 3): round(1 / 62, 9)}


def test_rerank(spark):
    rows = [(0, d, d) for d in range(6)] + [(1, 10, 0), (1, 11, 1)] + [(2, 20 + d, d) for d in range(7)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, prior int")
    score = F.when(F.col("doc_id") == 22, F.lit(None)).otherwise(F.col("doc_id").cast("double"))
    got = R.rerank(df, score=score, prior="prior", top=3).orderBy("query_id", "position").collect()
    by = {q: [r.doc_id for r in got if r.query_id == q] for q in (0, 1, 2)}
    assert by == {0: [5, 4, 3], 1: [10, 11], 2: [20, 21, 22]}


def test_embed_batches_checks_counts(spark):
    df = spark.range(130).selectExpr("id", "cast(id as string) as text").coalesce(1)
    sizes = []

    def ok(texts):
        assert len(texts) <= 64
        return [[float(t), 1.0] for t in texts]

    got = R.embed_batches(df, "text", ok).collect()
    assert len(got) == 130 and got[5].embedding == [5.0, 1.0] and not sizes
    with pytest.raises(Exception, match="count mismatch"):
        R.embed_batches(df, "text", lambda t: [[0.0]]).collect()


def test_trust_and_stale(spark):
    src = spark.createDataFrame([("a", .7), ("b", .9), ("c", .3), ("d", .5)], "source string, trust_score double")
    ev = spark.createDataFrame([("a", -.1), ("a", .05), ("a", -.6)] + [("b", .05)] * 7 + [("c", -.1)] * 7, "source string, delta double")
    got = {r.source: round(r.effective_trust, 6) for r in TR.effective_trust(src, ev).collect()}
    assert got == {"a": .1, "b": 1.0, "c": .1, "d": .5}
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    s = spark.createDataFrame([("x", "2024-01-11 16:00:00", 168), ("y", "2024-01-19 23:00:00", 168), ("z", None, 168)],
                              "url string, t string, check_interval_hours int").withColumn("last_checked", F.col("t").cast("timestamp"))
    assert {r.url for r in TR.due_for_check(s, now).collect()} == {"x", "z"}


def test_knn_keeps_string_ids_and_refuses_other_lengths(spark):
    vec = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None)], "doc_id string, embedding array<double>")
    qs = vec.where("embedding is not null").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    got = {(r.query_id, r.rank0): r.doc_id for r in R.knn(vec, qs, 1, exclude_self=True).collect()}
    assert got == {("a", 0): "b", ("b", 0): "a", ("c", 0): "a"}
    wide = vec.union(spark.createDataFrame([("e", [1.0, 2.0, 3.0])], vec.schema))
    with pytest.raises(Exception, match="queries' length 2: id e"):
        R.knn(wide, qs, 1).collect()
