import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.text import tokens
from tidewell.operators import retrieval as R
from tidewell.operators import search_index as S


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        text = " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(0, 50)))
        if rng.random() < 0.3:
            text += " don't stop"
        rows.append((i, text if i % 50 else None))
    return rows


QUERIES = [(0, "w0 w1"), (1, "w5"), (2, "don't"), (3, "W3 w3 don't stop"), (4, "nowhere"), (5, "w50 w2"), (6, "..."), (7, None), (8, "w0"), (9, "w1-w2 w0"), (10, "t-don")]


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, text string")


def frame(spark, rows, kind="bigint"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)


def by_scan(docs, asked):
    got = R.bm25(docs, asked, doc_id="doc_id", doc_text="text", query_id="query_id", query_text="text").collect()
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in got}


def by_index(index, asked):
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in S.search_scores(index, asked).collect()}


def best(scores, k):
    out = {}
    for (q, d), s in scores.items():
        out.setdefault(q, []).append((-s, d))
    return {(q, rank): (d, -s) for q, found in out.items() for rank, (s, d) in enumerate(sorted(found)[:k])}


def test_an_index_equals_the_scan(spark, asked, tmp_path):
    docs = frame(spark, corpus())
    index = S.create_index(docs, f"{tmp_path}/ix", blocks=10, buckets=4)
    want = by_scan(docs, asked)
    assert len(want) > 200 and by_index(index, asked) == pytest.approx(want)
    assert S.open_index(spark, f"{tmp_path}/ix") == index


def test_the_best_are_those_of_the_full_scores_and_blocks_are_left_out(spark, asked, tmp_path):
    # One block has short documents full of a word that documents of all blocks hold.
    block = F.pmod(F.xxhash64("id"), F.lit(8))
    full = [r.id for r in spark.range(5000, 6000).where(block == 3).limit(12).collect()]
    rows = [(i, f"{t or ''} w77") for i, t in corpus(500)] + [(i, "w77 " * 20) for i in full]
    docs = frame(spark, rows)
    index = S.create_index(docs, f"{tmp_path}/ix", blocks=8, buckets=4)
    queries = asked.union(spark.createDataFrame([(20, "w77")], asked.schema))
    read = []
    got = {(r.query_id, r.rank0): (r.doc_id, r.score) for r in S.search_top(index, queries, 7, first_blocks=1, read=read).collect()}
    want = best(by_scan(docs, queries), 7)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert {d for (q, _), (d, _) in got.items() if q == 20} <= set(full)
    # Seven of its eight blocks were not scored.
    assert read[0][1] - read[0][0] >= 7


def test_two_updates_and_a_deletion(spark, asked, tmp_path):
    before = dict(corpus())
    index = S.create_index(frame(spark, list(before.items())), f"{tmp_path}/ix", blocks=7, buckets=4)
    now, version = dict(before), 0
    for changed in ({3: "w0 w1 w0", 7: None, 900: "w5 don't"}, {3: "w50 w2", 900: "w5 stop", 901: "w0"}):
        version += 1
        old = [(d, now[d]) for d in changed if d in now]
        args = dict(added=frame(spark, list(changed.items())), removed=frame(spark, old))
        assert S.change_index(index, version, **args) and not S.change_index(index, version, **args)
        now |= changed
    gone = [(d, now.pop(d)) for d in [0, 1, 2, 901]]
    S.change_index(index, 3, added=frame(spark, []), removed=frame(spark, gone))
    docs = frame(spark, list(now.items()))
    want = by_scan(docs, asked)
    assert by_index(index, asked) == pytest.approx(want)
    got = {(r.query_id, r.rank0): r.doc_id for r in S.search_top(index, asked, 5, first_blocks=1).collect()}
    assert got == {k: d for k, (d, _) in best(want, 5).items()}
    whole = S.compact(index, f"{tmp_path}/one")
    assert whole.segments.versions() == [0] and whole.corpus() == index.corpus()
    assert by_index(whole, asked) == pytest.approx(want)


def test_an_unfinished_change_is_not_seen(spark, asked, tmp_path):
    docs = frame(spark, corpus(60))
    index = S.create_index(docs, f"{tmp_path}/ix", buckets=4)
    want = by_index(index, asked)
    # Postings were written, the commit was not.
    source = spark.read.parquet(f"{tmp_path}/ix/postings/segment=0")
    source.write.partitionBy("bucket").parquet(f"{tmp_path}/ix/postings/segment=1")
    assert by_index(index, asked) == want
    S.change_index(index, 1, added=frame(spark, [(999, "w0 w1")]), removed=frame(spark, []))
    assert (0, 999) in by_index(index, asked)


def test_a_search_reads_the_buckets_of_its_terms_and_no_documents(spark, tmp_path):
    docs = frame(spark, corpus(50))
    docs.write.parquet(f"{tmp_path}/docs.parquet")
    index = S.create_index(spark.read.parquet(f"{tmp_path}/docs.parquet"), f"{tmp_path}/ix")
    terms = S._terms(index, R.query_phrases(spark.createDataFrame([(0, "w1 w2")], "q int, t string"), "q", "t").select("phrase", "terms").distinct())
    found = index.live_postings(terms.select("phrase", "term", "bucket"), "tf")
    plan = found._jdf.queryExecution().executedPlan().toString()
    buckets = {r.bucket for r in terms.collect()}
    assert "docs.parquet" not in plan and "positions" not in plan and "PartitionFilters: [bucket#" in plan
    read = {int(f.split("bucket=")[1].split("/")[0]) for f in found.inputFiles() if "bucket=" in f}
    assert len(buckets) == 2 and buckets <= {r.bucket for r in index.read("postings").select("bucket").distinct().collect()} and read


def test_ids_may_be_strings_and_an_index_empty(spark, asked, tmp_path):
    rows = [(f"d{i}", t) for i, t in corpus(80)]
    index = S.create_index(frame(spark, rows, "string"), f"{tmp_path}/a", buckets=4)
    assert by_index(index, asked) == pytest.approx(by_scan(frame(spark, rows, "string"), asked))
    empty = S.create_index(frame(spark, []), f"{tmp_path}/b", buckets=4)
    assert by_index(empty, asked) == {} and S.search_top(empty, asked, 3).count() == 0
    S.change_index(empty, 1, added=frame(spark, [(1, "w0 w1"), (2, "x")]), removed=frame(spark, []))
    assert set(by_index(empty, asked)) == {(0, 1), (8, 1)}


def test_folding_of_letters(spark):
    cases = {"Łódź ŻÓŁĆ": ["łodz", "zołc"], "Dvořák Čech": ["dvorak", "cech"], "café": ["cafe"], "İstanbul": ["istanbul"], "Ởớ ẫ": ["oo", "a"],
             "ñandú Ærø": ["nandu", "ærø"], "Ёж": ["еж"], "ά": ["α"], "straße": ["straße"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", tokens("t").alias("k")).orderBy("i")
    assert [r.k for r in df.collect()] == list(cases.values())
