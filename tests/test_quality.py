import pytest
from pyspark.sql import functions as F

from tidewell.operators import editorial as ED
from tidewell.operators import evals as EV
from tidewell.operators import memory as ME
from tidewell.plans import snapshots as S
from tidewell.plans.blocked import seq_block
from tidewell.sources import exports as EX
from tidewell.streaming import jobs as J


def call_rows(spark, runs):
    return spark.createDataFrame([(k, i, c) for k, calls in runs.items() for i, c in enumerate(calls)], "q string, step int, tool_name string")


def test_faithfulness(spark):
    rows = [("a", "supported"), ("a", "supported"), ("a", "not_supported"), ("b", "unclear"), ("c", "supported"), ("c", "unclear"), ("c", "not_supported")]
    got = {r.q: r.faithfulness for r in EV.faithfulness(spark.createDataFrame(rows, "q string, judgment string"), "q").collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": 1.0, "c": 0.5}


def test_trajectory(spark):
    calls = call_rows(spark, {"a": "rrr", "b": "rw", "c": "rgr"})
    expected = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "r"), ("c", "g")], "q string, tool_name string")
    qs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "q string")
    got = {r.q: r.trajectory_precision for r in EV.trajectory_precision(qs, calls, expected, "q", "step", seq_block("step", 2)).collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": .5, "c": 1.0, "d": 1.0}


def test_loops(spark):
    calls = call_rows(spark, {"a": "xyyy", "b": "yyyx", "c": "yy", "d": "zzzzzzz"})
    got = {r.q: r.run_length for r in EV.tail_runs(calls, "q", "step", seq_block("step", 2), F.col("tool_name"), 3).collect()}
    assert got == {"a": 3, "d": 7}
    assert {r.q: r.times for r in EV.total_repeats(calls, "q", F.col("tool_name")).collect()} == {"a": 3, "b": 3, "d": 7}


def test_gate(spark):
    rows = [("a", "t", .9, .8, .7, .7), ("b", "", .7, .8, .7, .7)]
    df = spark.createDataFrame(rows, "q string, tier string, faithfulness double, relevancy double, trajectory double, accuracy double")
    assert EV.gate_report(df).first().passed and not EV.gate_report(df.where("q = 'b'")).first().passed
    empty = EV.gate_report(df.limit(0)).first()
    assert not empty.passed and empty.faithfulness == 0.0
    assert {r.tier for r in EV.tier_breakdown(df).collect()} == {"t", "unknown"}


def test_reported_rate(spark):
    ans = spark.createDataFrame([("a", "mean DPS: 100"), ("b", "none"), ("c", "none")], "q string, output string")
    obs = spark.createDataFrame([("b", 1, "DPS: 5"), ("b", 2, "7 dps"), ("b", 3, "x"), ("c", 1, "x")], "q string, step int, observation string")
    assert {r.q: r.rate for r in EV.reported_rate(ans, obs, "q", "step").collect()} == {"a": 100.0, "b": 7.0, "c": None}


def test_article_confidence(spark):
    rows = [("a", "verified", .8), ("a", "contradicted", .6), ("b", None, .9), ("c", "contradicted", .1)]
    got = {r.p: round(r.confidence, 6) for r in ED.with_all_articles(
        ED.article_confidence(spark.createDataFrame(rows, "p string, status string, confidence double"), "p"),
        spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "p string"), "p").collect()}
    assert got == {"a": .55, "b": .3, "c": 0.0, "none": 0.0}


def test_transitions(spark):
    art = spark.createDataFrame([("d", "draft"), ("r", "review"), ("p", "published")], "path string, status string").withColumns(
        {"updated_at": F.lit("2024-01-01").cast("timestamp"), "rejection_reason": F.lit(None).cast("string")})
    req = [("d", "status", "review", ""), ("r", "reject", None, "thin"), ("p", "update", None, ""), ("n", "create", None, ""), ("m", "status", "review", "")]
    dec = ED.transitions(spark.createDataFrame(req, "path string, action string, target string, reason string"), art)
    assert {r.path: r.reject_reason for r in dec.collect()} == {"d": None, "r": None, "p": "not a draft", "n": None, "m": "not found"}
    after = {r.path: (r.status, r.rejection_reason) for r in ED.apply_transitions(art, dec, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert after == {"d": ("review", None), "r": ("draft", "thin"), "p": ("published", None), "n": ("draft", None)}


def test_findings(spark):
    rows = [("t", "c1", 2, .5, ["http://a", "x"]), ("t", "c1", 1, .9, ["http://b"]), ("t", "c2", 3, .1, ["http://a", "http://b"])]
    f = spark.createDataFrame(rows, "k string, claim string, seq int, confidence double, evidence array<string>")
    assert {r.claim: r.confidence for r in ED.merge_findings(f, ["k"], "claim", F.col("seq")).collect()} == {"c1": .9, "c2": .1}
    assert {r.url: r.trust for r in ED.article_sources(f, "k", F.col("seq")).collect()} == {"http://a": .5, "http://b": .9}
    firsts = ED.distinct_in_order(f.select("k", "seq", F.explode("evidence").alias("v")), "k", "v", F.col("seq"))
    assert {r.v for r in firsts.collect()} == {"http://a", "http://b", "x"}


def test_budget_and_trim(spark):
    rows = spark.createDataFrame([("s", i, "x" * 900) for i in range(5)] + [("t", 0, "x" * 3000), ("t", 1, "y")], "s string, i int, text string")
    kept = ME.within_budget(rows, "s", "i", "text", seq_block("i", 2)).collect()
    assert sorted((r.s, r.i) for r in kept) == [("s", 0), ("s", 1)]
    assert sorted((r.s, r.i) for r in ME.newest(rows, "s", "i", 2).collect()) == [("s", 3), ("s", 4), ("t", 0), ("t", 1)]


def test_scored_traces(spark):
    tr = spark.createDataFrame([(i, "q", "a") for i in range(4)], "trace_id int, input string, output string")
    sc = spark.createDataFrame([(0, "user_feedback", 1.0, 0), (0, "trajectory_precision", .7, 0), (1, "user_feedback", 1.0, 0),
                                (2, "user_feedback", 1.0, 0), (2, "user_feedback", 0.0, 1), (2, "trajectory_precision", 1.0, 0)],
                               "trace_id int, name string, value double, seq int")
    assert [r.trace_id for r in EX.scored_traces(tr, sc).collect()] == [0]


# --- streams: several micro-batches give the batch result ---------------------
@pytest.fixture
def log_parts(spark, tmp_path):
    kinds = ["start", "damage", "cast", "damage", "end", "damage", "start", "damage", "start", "damage", "end", "end", "start", "damage"]
    rows = [(u, n * 3 + u, 1000 * n, k, "a", 10 + n) for u in range(3) for n, k in enumerate(kinds * 3)]
    df = spark.createDataFrame(rows, "log_id long, seq long, ts_ms long, kind string, ability string, amount long")
    folder = tmp_path / "in"
    for i, (lo, hi) in enumerate([(0, 25), (25, 26), (26, 80), (80, 1000)]):
        df.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(str(folder))
    return df, str(folder)


def test_streamed_encounters_equal_batch(spark, tmp_path, log_parts):
    from tidewell.operators import combat as C

    df, folder = log_parts
    stream = J.stream_table(spark, folder, files_per_batch=1)
    totals, abilities = J.stream_encounters(spark, stream, str(tmp_path / "out"), lambda: seq_block("seq", 16))
    marked = C.with_markers(df, seq_block("seq", 16))
    inside = C.inside_encounters(marked)
    want = C.encounter_totals(C.completed_encounters(marked), inside).select(*totals.columns)
    assert len(S.complete_versions(spark, str(tmp_path / "out" / "totals"))) == 4
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, want.collect()))
    cols = ["log_id", "enc_seq", "ability", "damage", "casts"]
    assert sorted(map(tuple, abilities.select(*cols).collect())) == sorted(map(tuple, C.ability_breakdown(inside).select(*cols).collect()))


def test_running_aggregates_and_restart(spark, tmp_path):
    folder, root = str(tmp_path / "ev"), str(tmp_path / "st")
    make = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('s', id % 3) source", "id / 10.0D delta")
    make(0, 10).coalesce(1).write.parquet(folder)
    make(10, 25).coalesce(1).write.mode("append").parquet(folder)
    first = J.running_trust(spark, J.stream_table(spark, folder, 1), root)
    total = {r.source: (round(r.delta_sum, 6), r.n_events) for r in first.collect()}
    want = {r.source: (round(r.d, 6), r.n) for r in make(0, 25).groupBy("source").agg(F.sum("delta").alias("d"), F.count(F.lit(1)).alias("n")).collect()}
    assert total == want
    make(25, 30).coalesce(1).write.mode("append").parquet(folder)
    again = J.running_trust(spark, J.stream_table(spark, folder, 1), root)
    assert sum(r.n_events for r in again.collect()) == 30


def test_repeated_batch_counts_once(spark, tmp_path):
    root = str(tmp_path / "r")
    step = J.running_step(spark, root, lambda b: b.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], lambda: [F.sum("n").alias("n")])
    a, b = spark.createDataFrame([("x",)] * 3, "k string"), spark.createDataFrame([("x",)] * 2, "k string")
    step(a, 0)
    step(b, 1)
    step(b, 1)
    assert S.read_latest(spark, f"{root}/state").first().n == 5


def test_state_of_an_encounter_that_never_ends_stays_small(spark, tmp_path):
    root = str(tmp_path / "out")
    step = J.encounter_step(spark, root, lambda: seq_block("seq", 16))
    schema = "log_id long, seq long, ts_ms long, kind string, ability string, amount long"
    rows = [(1, 0, 0, "start", None, None)] + [(1, i, 1000 * i, "damage", f"a{i % 3}", 1) for i in range(1, 400)]
    for number, at in enumerate(range(0, 400, 100)):
        step(spark.createDataFrame(rows[at:at + 100], schema), number)
        assert S.read_latest(spark, f"{root}/open").count() == 1 and S.read_latest(spark, f"{root}/sums").count() == 3
    # A repeated batch counts once, and the end gives the sums of all batches.
    step(spark.createDataFrame(rows[300:400], schema), 3)
    step(spark.createDataFrame([(1, 400, 400_000, "end", None, None)], schema), 4)
    assert [tuple(r) for r in J.all_versions(spark, f"{root}/totals").collect()] == [(1, 0, 400_000, 399, 399 / 400.0)]
    assert {(r.ability, r.damage) for r in J.all_versions(spark, f"{root}/abilities").collect()} == {("a0", 133), ("a1", 133), ("a2", 133)}
    assert S.read_latest(spark, f"{root}/open").count() == S.read_latest(spark, f"{root}/sums").count() == 0


def test_encounters_are_given_up_after_a_while_or_dropped_by_a_new_start(spark, tmp_path):
    schema = "log_id long, seq long, ts_ms long, kind string, ability string, amount long"
    batches = [[(1, 0, 0, "start", None, None), (1, 1, 10, "damage", "a", 5), (2, 0, 0, "start", None, None), (2, 1, 5, "damage", "a", 7)],
               [(2, 2, 900, "start", None, None), (2, 3, 950, "damage", "b", 1)], [(1, 5, 1900, "end", None, None), (2, 4, 1950, "end", None, None)]]
    found = {}
    for expire in (None, 500):
        root = str(tmp_path / f"out{expire}")
        step = J.encounter_step(spark, root, lambda: seq_block("seq", 16), expire_ms=expire)
        for number, rows in enumerate(batches):
            step(spark.createDataFrame(rows, schema), number)
        found[expire] = sorted((r.log_id, r.enc_seq, r.total_damage) for r in J.all_versions(spark, f"{root}/totals").collect())
    assert found == {None: [(1, 0, 5), (2, 2, 1)], 500: [(2, 2, 1)]}


def test_a_running_aggregate_writes_changed_groups_only(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    for i, keys in enumerate([("a", "b", "c"), ("b",), ("b", "d")]):
        spark.createDataFrame([(k, float(i)) for k in keys], "source string, delta double").coalesce(1).write.mode("append").parquet(folder)
        got = J.running_trust(spark, J.stream_table(spark, folder), root)
    assert {r.source: (r.delta_sum, r.n_events) for r in got.collect()} == {"a": (0.0, 1), "b": (3.0, 3), "c": (0.0, 1), "d": (2.0, 1)}
    from tidewell.plans.segments import Segments
    rows = Segments(spark, root).read("state", got.schema).groupBy("segment").count().collect()
    assert sorted(r["count"] for r in rows if r["count"]) == [1, 2, 3]


def test_a_library_follows_a_stream(spark, tmp_path):
    from tidewell.operators import library as L

    folder, library = str(tmp_path / "in"), L.create_library(spark, str(tmp_path / "lib"), blocks=2, buckets=2)
    now = F.lit("2024-01-01").cast("timestamp")
    schema = "url string, title string, source_type string, text string, seq long"
    for rows in ([("a", "A", "guide", "one", 0), ("a", "A", "guide", "two", 1), ("b", "B", "guide", "words " * 700, 2)], [("a", "A", "guide", "two", 3)], [("b", "B", "guide", "x", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        J.run_to_end(J.stream_table(spark, folder), J.ingest_step(library, lambda b: now), library.root)
    assert {(r.url, r.chunk_count, r.change_count) for r in library.sources().collect()} == {("a", 1, 0), ("b", 1, 1)}
    assert {(r.chunk_id, r.content) for r in library.chunks().collect()} == {("a#0", "two"), ("b#0", "x")}
