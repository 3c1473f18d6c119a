"""Operator 13 against plain grouping of texts."""

import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import exact

INPUT = "doc_id long, text string, k string, own string, size int, t double"
NAMES = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows, keep):
    """Result rows; of repeated rows of one id, which one is kept does not show."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, pick = [], (max if keep == "largest" else min)
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        best = pick(named) if named else None
        first = True
        for i in ids:
            kept = first and i == best
            first = first and not kept
            out.append((i, best, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2.0) for i, t in rows], INPUT)


ODD = [(1, "a"), (2, "a"), (3, "A"), (4, "a "), (5, None), (6, ""), (7, None), (8, "ä"), (9, "ä"), (10, "x" * 2_000_000), (11, "x" * 2_000_000),
       (12, "x" * 1_999_999), (13, "\0"), (14, "lone"), (15, "twice"), (15, "twice"), (15, "thrice"), (None, "lone"), (None, "none"), (None, "none"), (None, None)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_plain_groups(spark, keep):
    rows = ODD + [(100 + i, "hot" if i % 3 else f"t{i}") for i in range(600)]
    for parts in (1, 13):
        found = exact.exact_dedup(frame(spark, rows).repartition(parts), keep=keep)
        assert found.columns == NAMES and sorted(map(tuple, found.collect()), key=repr) == brute(rows, keep)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_texts_behind_one_hash_are_told_apart(spark, keep):
    """With a hash of two values every group holds several texts."""
    rows = ODD + [(100 + i, f"t{i % 7}") for i in range(200)]
    found = exact.exact_dedup(frame(spark, rows).repartition(5), keep=keep, digest=lambda t: F.pmod(F.length(t), F.lit(2)))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, keep)


def test_normalised_texts_and_empty_tables(spark):
    found = exact.exact_dedup(frame(spark, [(1, " A  b"), (2, "a b"), (3, None)]), normalise=lambda t: F.lower(F.regexp_replace(F.trim(t), " +", " ")))
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()} == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)}
    empty = exact.exact_dedup(frame(spark, []))
    assert empty.columns == NAMES and empty.count() == 0
    with pytest.raises(ValueError):
        exact.exact_dedup(frame(spark, []), keep="any")


def test_a_large_group_meets_its_rows_split_by_split(spark):
    """No key of the join that tells rows their group has more rows than one split of the input."""
    rows = [(i, "same") for i in range(4000)]
    found = exact.exact_dedup(frame(spark, rows).repartition(8))
    assert found.filter("kept").count() == 1 and found.agg(F.min("group_size"), F.count("*")).first()[:] == (4000, 4000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "g_split" in plan and "Window" not in plan and "Python" not in plan


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.01").exists(), reason="test tables not present")
def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, exact.exact_dedup(docs, keep="largest").collect()), key=repr) == brute(rows, "largest")
