import pathlib
import re

import pytest

import __spark_entry__ as entry
from tidewell import catalog

DATA = "/root/testdata/sf0.001"
HEAVY = ("i04", "d07", "c12", "e02", "e06", "d13", "b06", "f03", "d20", "d21", "j02", "j04", "d22", "d23")


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 170
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert all(re.fullmatch(r"[a-k]\d\d_[a-z0-9_]+", name) for name in catalog.QUERIES)


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith(HEAVY)])
def test_plans_have_no_cross_join_and_no_row_python(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|FlatMapGroups", plan)


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="test tables not present")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "source", "trust_score", "rrf_score", "position"] and df.count() > 0


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="test tables not present")
def test_scans_read_only_what_is_needed(spark):
    plan = catalog.QUERIES["e02_snapshot_changes"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ts" not in re.findall(r"ReadSchema: struct<([^>]*)>", plan)[0]
    plan = catalog.QUERIES["b10_relation_type_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_returnflag" in plan
