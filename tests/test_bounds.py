"""What a task holds, and what is shuffled or written, stays in bounds that do not depend on the size of a table."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.catalog import corpus as C
from tidewell.operators import extraction as X
from tidewell.operators import library as L
from tidewell.operators import search_index as S
from tidewell.plans import slices as SL
from tidewell.plans.segments import Segments
from tidewell.sources import reports as RP


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slices_are_bounded_and_whole():
    lists = [list(range(n)) for n in (3, 0, 500, 40, 50, 0, 9)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.int64()))], names=["id", "x"])
    parts = list(SL.slices(batch, SL.list_sizes(batch.column(1)), 100))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5], [6, 7]]
    assert [p.column(1).to_pylist() for p in parts] == [lists[:2], lists[2:3], lists[3:6], lists[6:]]
    assert not list(SL.slices(batch.slice(0, 0), np.zeros(0, "int64"), 100))
    assert SL.text_sizes(pa.array(["é", None, ""])).tolist() == [2, 0, 0]


def test_postings_and_vectors_of_many_slices(spark):
    from tidewell.operators import retrieval as R

    # A single task with several times as many words as a slice.
    rows = spark.range(0, 300, numPartitions=1).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.concat(F.lit("w"), (i % 50 + F.col("id") % 3).cast("string")))).alias("text"))
    got = R.build_postings(rows, "id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).collect()
    want = {}
    for i in range(300):
        for w in range(50):
            want.setdefault(f"w{w + i % 3}", []).append(80)
    assert {r.term: (r.df, r.cf) for r in got} == {t: (len(v), sum(v)) for t, v in want.items()}
    vectors = {r.id: tuple(r.embedding) for r in R.feature_hash_embedding(rows, "id", "text").collect()}
    assert len(vectors) == 300 and all(vectors[i] == vectors[i % 3] for i in vectors) and any(vectors[0])


def test_postings_of_a_slice_come_by_term(spark):
    from tidewell.operators import retrieval as R
    from tidewell.session import SPREAD_CONF

    rows = spark.createDataFrame([(i, " ".join(f"{w}{i % 3}" for w in "zß b Ä 9".split())) for i in range(50)], "id int, text string").coalesce(1)
    tasks = spark.conf.get(SPREAD_CONF)
    spark.conf.set(SPREAD_CONF, "0")
    try:
        got = [(r.term, r.doc_id) for r in R.build_postings(rows, "id", "text").collect()]
    finally:
        spark.conf.set(SPREAD_CONF, tasks)
    assert len(got) == 200 and got == sorted(got, key=lambda x: (x[0].encode(), x[1]))


def test_a_repeated_batch_moves_no_texts(spark, tmp_path, monkeypatch):
    from tidewell.operators import ingest, library as L

    cut, chunk_texts = [], ingest.chunk_texts

    def watched(docs, *args, **sizes):
        cut.append(docs._jdf.queryExecution().optimizedPlan().toString())
        return chunk_texts(docs, *args, **sizes)

    monkeypatch.setattr(ingest, "chunk_texts", watched)
    spark.createDataFrame([(f"u{i}", "t", "web", f"text {i}") for i in range(9)], "url string, title string, source_type string, text string").write.parquet(f"{tmp_path}/pages")
    library, pages = L.create_library(spark, f"{tmp_path}/library", blocks=2, buckets=2), spark.read.parquet(f"{tmp_path}/pages")
    for version in (1, 2):
        L.ingest_pages(library, pages, version, F.lit("2024-05-01").cast("timestamp"))
    assert "Relation [url" in cut[0] and cut[1].startswith("LocalRelation <empty>")
    assert library.chunks().count() == 9 and {r.action for r in library.decisions(2).collect()} == {"unchanged"}


def test_neighbours_of_many_slices(spark):
    from tidewell.operators import retrieval as R

    # More vectors in a task than a slice holds.
    vectors = spark.range(0, 5000, numPartitions=1).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.col("id") / 5000).alias("embedding"))
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, [1.0, 0.0])], "query_id int, query_embedding array<double>")
    got = {(r.query_id, r.rank0): r.doc_id for r in R.knn(vectors, asked, 3).collect()}
    assert got == {(7, 0): 4999, (7, 1): 4998, (7, 2): 4997, (8, 0): 0, (8, 1): 1, (8, 2): 2}


def test_scanned_answers_are_written_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "fresh_path", lambda _, label: f"{tmp_path}/{label}")
    answers = spark.createDataFrame([('{"code":"a","fights":[{"id":1,"encounterID":2,"name":"x"}]}',)], "value string")
    got = C.scanned(type("T", (), {"spark": spark}), answers)
    assert [(r.report_code, r.fight_id) for r in RP.fight_rows(got).collect()] == [("a", 1)]
    assert {p.suffix for p in (tmp_path / "reports").glob("part-*")} == {".gz"}


def test_stored_tables_move_new_rows_once(spark, tmp_path, monkeypatch):
    store, plans = Segments(spark, str(tmp_path)), []
    own = Segments.write
    monkeypatch.setattr(Segments, "write", lambda self, df, *a, **b: (plans.append(plan_of(df)), own(self, df, *a, **b))[1])
    fights = spark.createDataFrame([("A", 1, "x", 10), ("A", 1, "x", 12), ("B", None, "y", None)], "report_code string, fight_id long, name string, duration_ms long")
    for version in (1, 2):
        RP.store_tables(store, {"fights": fights}, version)
    assert [p.count("Exchange") for p in plans] == [1, 1]
    assert store.read("fights").where("segment = 2").count() == 0
    assert sorted(tuple(r) for r in RP.stored_table(store, "fights").collect()) == [("A", 1, "x", 12), ("B", None, "y", None)]


def test_pending_texts_are_found_by_their_ids(spark, tmp_path):
    store = X.ExtractionStore(spark, str(tmp_path / "store"))

    def extract(text):
        if text == "bad":
            raise ValueError("bad")
        return {"entities": [], "relationships": []}

    rows = [("a", 1, "good"), ("b", 2, "bad"), (None, 3, "good"), ("a", 1, "good")]
    spark.createDataFrame(rows, "chunk_id string, seq long, content string").write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    X.run_extraction(store, chunks, 1, extract)
    left = X._pending(store, chunks, 2)
    assert sorted((r.chunk_id or "", r.seq) for r in left.collect()) == [("", 3), ("b", 2)]
    assert "Exchange hashpartitioning" not in plan_of(left)


def test_pages_are_decided_without_their_texts(spark, tmp_path, monkeypatch):
    library, seen = L.create_library(spark, f"{tmp_path}/library", blocks=16, buckets=2), {}
    own = L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, label: (seen.setdefault(label, []).append((df.columns, plan_of(df))), own(df, label))[1])

    def pages(*rows):
        return spark.createDataFrame([(u, "t", "guide", x) for u, x in rows], "url string, title string, source_type string, text string")

    now = F.lit("2024-05-01").cast("timestamp")
    L.ingest_pages(library, pages(("a", "swords"), ("b", "maces"), (None, "axes")), 1, now)
    L.ingest_pages(library, pages(("a", "swords"), ("b", "more maces"), ("c", " ")), 2, now)
    assert sorted(r.content for r in library.chunks().collect()) == ["axes", "more maces", "swords"]
    assert {(r.url, r.action, r.chunk_count) for r in library.decisions(2).collect()} == {("a", "unchanged", 1), ("b", "replace", 1), ("c", "new", 0)}
    assert len(seen["decided"]) == 2 and all("text" not in columns for columns, _ in seen["decided"])


def test_few_buckets_are_dealt_to_many_tasks(spark):
    postings = spark.createDataFrame([], "term string, block int, doc_id string, bucket int")
    for blocks, buckets, stripes in ((16, 8, 16), (100, 8, 32), (100, 64, 4), (1, 64, 1), (2000, 64, 9)):
        index = S.SearchIndex(spark, "", blocks, buckets, "string")
        assert f", {stripes})" in S._dealt(index, postings)._jdf.queryExecution().analyzed().toString().split("pmod(block")[1][:12]


def test_repeated_parts_of_stored_tables_are_not_moved(spark, tmp_path, monkeypatch):
    store, seen = Segments(spark, str(tmp_path)), []
    own = RP._open_parts
    monkeypatch.setattr(RP, "_open_parts", lambda *a: (seen.append(own(*a)), seen[-1])[1])
    schema = "report_code string, fight_id long, name string, duration_ms long"
    first = [("A", 1, "x", 10), ("A", 1, "x", 10), ("A", 1, "x", 12), ("B", None, "y", None), ("C", 3, "z", 3)]
    other = [("A", 1, "x", 9), *first[3:]]
    for version, rows in enumerate((first, first, other, first[:1], first, first[3:]), 1):
        RP.store_tables(store, {"fights": spark.createDataFrame(rows, schema)}, version)
    assert [len(x["fights"]) for x in seen] == [3, 0, 1, 1, 1, 0]
    assert sorted(tuple(r) for r in RP.stored_table(store, "fights").collect()) == [("A", 1, "x", 12), ("B", None, "y", None), ("C", 3, "z", 3)]
    once = Segments(spark, f"{tmp_path}/once")
    for version in (1, 2):
        RP.store_tables(once, {"fights": spark.createDataFrame(first, schema)}, version)
    assert RP.stored_table(once, "fights").count() == 3 and "Exchange" not in plan_of(RP.stored_table(once, "fights"))


def test_mentions_of_many_slices(spark):
    from tidewell.operators import graph as G

    # Texts of which one alone has more words than a slice, and a single task.
    n = SL.SLICE_ENTRIES // 4
    texts = spark.createDataFrame([(1, "a b c " * n), (2, None), (3, "b"), (None, "c a b a b c")], "id long, text string").coalesce(1)
    names = spark.createDataFrame([("a b", "x"), ("b c", "x"), ("b", "y"), ("a b c", "z"), ("", "w")], "canonical_name string, entity_type string")
    found = G.longest_mentions(texts, names, id_col="id", text_col="text")
    got = {(r.id, r.position): (r.canonical_name, r.entity_type) for r in found.collect()}
    assert got == {(3, 0): ("b", "y"), (None, 1): ("a b", "x"), (None, 3): ("a b c", "z")} | {(1, 3 * i): ("a b c", "z") for i in range(n)}
    assert "aggregate(" not in plan_of(found)


def test_postings_travel_without_what_follows(spark):
    postings = spark.createDataFrame([("a", 1, 7, 3, [0, 2], 2, 0)], "term string, block int, doc_id long, doc_len int, positions array<int>, tf int, bucket int")
    index = S.SearchIndex(spark, "", 8, 4, "bigint")
    dealt = S._dealt(index, postings)
    bucket = spark.range(1).select(index.bucket_of(F.lit("a"))).first()[0]
    assert dealt.columns == postings.columns and [tuple(r) for r in dealt.collect()] == [("a", 1, 7, 3, [0, 2], 2, bucket)]
    sent = dealt._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "Project [term" in sent and "tf" not in sent.split("Project [")[1].split("]")[0]


def test_postings_of_many_documents_are_dealt_to_more_tasks_than_shuffles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "TASK_DOCS", 4)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("all w"), (F.col("id") % 3).cast("string")).alias("text"))
    index = S.create_index(docs, str(tmp_path), blocks=2, buckets=1)
    held = index.read("postings")
    files = held.select(F.input_file_name().alias("f"), "doc_id").groupBy("f").agg(F.count_distinct("doc_id").alias("n")).collect()
    assert len(files) > 8 and max(r.n for r in files) <= 12  # session: 8 shuffle partitions; before, 2 tasks, one a block
    assert {r.term: r.n for r in held.groupBy("term").agg(F.count_distinct("doc_id").alias("n")).collect()} == {"all": 100, "w0": 34, "w1": 33, "w2": 33}
    S.change_index(index, 1, added=docs.where("doc_id < 2").withColumn("text", F.lit("new")), removed=docs.where("doc_id < 2"))
    whole = S.compact(index, f"{tmp_path}-whole")
    assert sorted((r.term, r.doc_id) for r in whole.read("postings").where("term <> 'all'").collect())[:3] == [("new", 0), ("new", 1), ("w0", 3)]
