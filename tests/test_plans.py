import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.plans import merge as M
from tidewell.plans import snapshots as S
from tidewell.plans.blocked import row_numbers, seq_block, with_neighbours
from tidewell.plans.quantile import exact_median
from tidewell.plans.topk import top_k


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; values have gaps."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((key, i, rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(rows, "k string, seq bigint, v int").cache()


@pytest.mark.parametrize("width", [1, 7, 500, 10_000])
def test_blocked_windows_equal_plain_windows(skewed, width):
    got = with_neighbours(
        skewed, ["k"], ["seq"], seq_block("seq", width), lag={"lag": "v"}, lead={"lead": "v"}, last_before={"lb": "v"},
        first_after={"fa": "v"}, last_until={"lu": "v"}, running_sum={"rs": "v"})
    w = Window.partitionBy("k").orderBy("seq")
    plain = skewed.select(
        "*", F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("lb"),
        F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("fa"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lu"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"))
    assert sorted(map(tuple, got.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_blocked_windows_split_the_hot_key(skewed):
    plan = with_neighbours(skewed, ["k"], ["seq"], seq_block("seq", 100), lag={"lag": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_block" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_row_numbers(skewed):
    got = row_numbers(skewed, ["k"], ["seq"], seq_block("seq", 50), "n").groupBy("k").agg(
        F.count(F.lit(1)).alias("c"), F.max("n").alias("m"), F.countDistinct("n").alias("d")).collect()
    assert all(r.c == r.m == r.d for r in got)


def test_exact_median(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(500) / 7) for _ in range(2001)] + [("even", float(x)) for x in (4, 1, 3, 2)] + [("one", 9.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx(want)


def test_top_k_limits_before_the_shuffle(skewed):
    df = top_k(skewed, ["k"], [F.desc("seq")], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert df.count() == 2 * skewed.select("k").distinct().count()


def test_upsert_and_insert_absent(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (3, "f", 2)], "id int, v string, seq int")
    assert sorted((r.id, r.v) for r in M.upsert(old, new, ["id"], "seq").collect()) == [(1, "a"), (2, "d"), (3, "f")]
    assert sorted((r.id, r.v) for r in M.insert_absent(old, new, ["id"], "seq").collect()) == [(1, "a"), (2, "b"), (3, "e")]


def test_last_known_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, None)], "k int, seq int, v string")
    got = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(M.last_known("v", F.col("seq")).alias("a"), M.first_known("v", F.col("seq")).alias("b")).collect()}
    assert got == {1: ("x", "x"), 2: (None, None)}


def test_versions_and_backups(spark, tmp_path):
    root = str(tmp_path / "t")
    assert S.read_latest(spark, root) is None
    for v in (0, 1, 2):
        S.write_version(spark.range(v + 1), root, v)
    assert S.read_latest(spark, root).count() == 3 and S.read_latest(spark, root, below=2).count() == 2
    tables = {"a": spark.range(10), "b": spark.range(3).selectExpr("id", "cast(id as string) s")}
    backups = str(tmp_path / "b")
    for stamp in ("20240101-000000", "20240102-000000", "20240103-000000"):
        S.create_backup(tables, backups, stamp)
    assert all(r.intact for r in S.verify_backup(tables, backups, "20240102-000000").collect())
    changed = {"a": spark.range(1, 11), "b": tables["b"]}
    assert [r.intact for r in S.verify_backup(changed, backups, "20240102-000000").orderBy("table_name").collect()] == [False, True]
    assert S.prune_backups(spark, backups, 2) == ["20240101-000000"]
    assert S.list_backups(spark, backups) == ["20240103-000000", "20240102-000000"]


def test_work_folder(spark, monkeypatch):
    from tidewell import session

    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.work_dir(spark) == configured.rstrip("/")
    monkeypatch.setattr(session, "CHECKPOINT_CONF", "spark.tidewell.unset")
    assert session.work_dir(spark) == session.work_dir(spark) and session.work_dir(spark).startswith("/tmp/run-")
    df = session.materialize(spark.range(5), "t")
    assert df.count() == 5 and "Scan parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_a_group_with_an_outlier_stays_spread(spark):
    from tidewell.plans.quantile import around_middle, exact_median

    df = spark.range(40_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") == 1, 1e300).otherwise(F.col("id") * 1.5).alias("v"))
    near = around_middle(df, ["k"], "v").groupBy("k").count().collect()
    assert all(r["count"] < 40 for r in near)
    values = {k: sorted(r.v for r in df.where(F.col("k") == k).collect()) for k in (0, 1)}
    got = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
    assert got == {k: (v[9_999] + v[10_000]) / 2 for k, v in values.items()}


def test_segments_show_committed_changes_only(spark, tmp_path):
    from tidewell.plans.segments import Segments, last_of, without_removed

    store = Segments(spark, str(tmp_path / "s"))
    make = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    schema = make(("a", 1)).schema
    assert store.versions() == [] and store.read("t", schema).count() == 0
    store.write(make(("a", 1), ("b", 1)), "t", 1)
    assert store.read("t", schema).count() == 0
    store.commit(1, make(("note", 1)))
    store.write(make(("a", 9)), "t", 2)
    store.write(make(("a", 2), ("c", 2)), "t", 2)
    store.commit(2, make(("note", 2)))
    assert {tuple(r) for r in last_of(store.read("t", schema), "k").collect()} == {("a", 2), ("b", 1), ("c", 2)}
    gone = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "k string, segment int")
    assert {tuple(r) for r in without_removed(store.read("t"), gone, "k").drop("segment").collect()} == {("a", 1), ("a", 2), ("c", 2)}
    assert store.notes().count() == 2 and store.read("t", schema, below=2).count() == 2
