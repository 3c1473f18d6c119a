import pytest
from pyspark.sql import functions as F

from tidewell.operators import ingest as I
from tidewell.operators import library as L
from tidewell.operators import search_index as S



def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


LONG = "\n".join(f"Line {i} of a guide that goes on for some time, with words such as hit{i}." for i in range(80))


def pages(spark, *rows):
    return spark.createDataFrame([(u, f"title {u}", "guide", t) for u, t in rows], "url string, title string, source_type string, text string")


def state(library):
    sources = {r.url: (r.chunk_count, r.change_count, r.content_hash_previous is not None) for r in library.sources().collect()}
    chunks = {r.chunk_id: r.content for r in library.chunks().collect()}
    vectors = sorted(r.chunk_id for r in library.vectors().collect())
    return sources, chunks, vectors


def found(library, text):
    asked = library.spark.createDataFrame([(0, text)], "query_id int, text string")
    return {r.doc_id for r in S.search_scores(library.index, asked).collect()}


@pytest.fixture
def library(spark, tmp_path):
    return L.create_library(spark, f"{tmp_path}/library", blocks=3, buckets=2)


def test_one_change_set_drives_all_tables(spark, library):
    assert L.ingest_pages(library, pages(spark, ("a", LONG), ("b", "short text about swords"), ("c", " \n ")), 1, now())
    sources, chunks, vectors = state(library)
    want = [c for c in I.chunk_one(LONG, 400, 50, 50)]
    assert sources == {"a": (len(want), 0, False), "b": (1, 0, False), "c": (0, 0, False)} and len(want) > 3
    assert chunks == {f"a#{i}": c for i, c in enumerate(want)} | {"b#0": "short text about swords"}
    assert vectors == sorted(chunks) and found(library, "swords") == {"b#0"} and found(library, "hit79") == {f"a#{len(want) - 1}"}
    assert {(r.url, r.action, r.chunk_count, r.has_text) for r in library.decisions(1).collect()} == {
        ("a", "new", len(want), True), ("b", "new", 1, True), ("c", "new", 0, False)}


def test_replaced_pages_refused_pages_and_repeats(spark, library):
    first = pages(spark, ("a", LONG), ("b", "about swords"))
    L.ingest_pages(library, first, 1, now())
    before = state(library)
    # The same pages under another number change nothing; the same number is not applied again.
    assert L.ingest_pages(library, first, 2, now()) and state(library) == before
    assert not L.ingest_pages(library, pages(spark, ("a", "x")), 2, now()) and state(library) == before
    L.ingest_pages(library, pages(spark, ("a", "now about maces"), ("b", "  "), ("d", "axes")), 3, now())
    sources, chunks, vectors = state(library)
    assert sources == {"a": (1, 1, True), "b": (1, 0, False), "d": (1, 0, False)}
    assert chunks == {"a#0": "now about maces", "b#0": "about swords", "d#0": "axes"} and vectors == sorted(chunks)
    assert found(library, "hit3") == set() and found(library, "maces") == {"a#0"} and found(library, "about") == {"a#0", "b#0"}
    assert {(r.url, r.action, r.chunk_count) for r in library.decisions(3).collect()} == {("a", "replace", 1), ("b", "refused", 1), ("d", "new", 1)}


def test_forgotten_sources_take_everything_with_them_and_may_come_back(spark, library):
    L.ingest_pages(library, pages(spark, ("a", LONG), ("b", "about swords")), 1, now())
    L.forget_sources(library, spark.createDataFrame([("a",), ("a",), ("nowhere",)], "url string"), 2)
    sources, chunks, vectors = state(library)
    assert set(sources) == {"b"} and set(chunks) == {"b#0"} and vectors == ["b#0"] and found(library, "hit3") == set()
    L.ingest_pages(library, pages(spark, ("a", "back again")), 3, now())
    assert state(library)[0]["a"] == (1, 0, False) and found(library, "again") == {"a#0"}


def test_a_broken_change_is_not_seen_and_can_be_repeated(spark, library):
    L.ingest_pages(library, pages(spark, ("a", LONG)), 1, now())
    before = state(library)

    def fails(chunks):
        return chunks.select("chunk_id", F.raise_error(F.lit("no model")).cast("array<double>").alias("embedding"))

    with pytest.raises(Exception, match="no model"):
        L.ingest_pages(library, pages(spark, ("a", "new words"), ("e", "more")), 2, now(), embed=fails)
    assert state(library) == before and found(library, "more") == set()
    assert L.ingest_pages(library, pages(spark, ("a", "new words"), ("e", "more")), 2, now())
    assert set(state(library)[1]) == {"a#0", "e#0"} and found(library, "hit3") == set()


def test_an_empty_library(spark, library):
    assert state(library) == ({}, {}, [])
    assert L.ingest_pages(library, pages(spark), 1, now()) and state(library) == ({}, {}, [])
