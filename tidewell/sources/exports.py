"""Evaluation questions in, scored traces out as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "id string, question string, complexity string, category string, ground_truth string, expected_tools array<string>, "
    "key_facts array<string>, spec string, tier string"
)


# --- questions ---------------------------------------------------------------
def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON files, each an array of objects.

    A file that is no such array gives one row with its text in ``unread``.
    """
    read = spark.read.schema(QUESTION + ", unread string").json(path, multiLine=True, columnNameOfCorruptRecord="unread")
    return question_defaults(read)


def parse_questions(raw: DataFrame, text_col: str) -> DataFrame:
    """Questions out of a column with JSON arrays; a text that is none gives one row with it in ``unread``."""
    entry = "array<struct<" + QUESTION.replace(", ", ",").replace(" ", ":") + ">>"
    read = F.from_json(text_col, entry)
    broken = read.isNull() | F.exists(F.coalesce(read, F.array()), lambda q: q.isNull())
    rows = raw.select(F.when(broken, F.coalesce(F.col(text_col), F.lit(""))).alias("unread"), F.when(~broken, read).alias("list"))
    rows = rows.where(F.col("unread").isNotNull() | (F.size("list") > 0)).select("unread", F.explode_outer("list").alias("q"))
    return question_defaults(rows.select("q.*", "unread"))


def question_defaults(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "ground_truth": F.coalesce("ground_truth", F.lit("")), "category": F.coalesce("category", F.lit("")),
        "spec": F.coalesce("spec", F.lit("")), "expected_tools": F.coalesce("expected_tools", none), "key_facts": F.coalesce("key_facts", none)})


# --- traces ------------------------------------------------------------------
def scored_traces(traces: DataFrame, scores: DataFrame, min_feedback: float = 1.0, min_trajectory: float = 0.7) -> DataFrame:
    """Traces with good feedback and tool use; a missing score counts as -1.

    ``scores``: ``trace_id, name, value`` rows, the last value of a name by ``seq``.
    """
    last = lambda name: F.max_by("value", F.when(F.col("name") == name, F.col("seq")))
    pivot = scores.groupBy("trace_id").agg(last("user_feedback").alias("feedback"), last("trajectory_precision").alias("trajectory"))
    joined = traces.join(pivot, "trace_id", "left").withColumns({
        "feedback": F.coalesce("feedback", F.lit(-1.0)), "trajectory": F.coalesce("trajectory", F.lit(-1.0))})
    return joined.where((F.col("feedback") >= min_feedback) & (F.col("trajectory") >= min_trajectory))


def _complete(traces: DataFrame) -> DataFrame:
    filled = (F.coalesce("input", F.lit("")) != "") & (F.coalesce("output", F.lit("")) != "")
    return traces.where(filled)


def to_sharegpt(traces: DataFrame, system: str) -> DataFrame:
    """One JSON line per trace: system prompt, question, answer."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    turns = F.array(turn("system", F.lit(system)), turn("human", F.col("input")), turn("gpt", F.col("output")))
    return _complete(traces).select("trace_id", F.to_json(F.struct(turns.alias("conversations"))).alias("value"))


def to_function_calling(traces: DataFrame, system: str) -> DataFrame:
    """One JSON line per trace with its tool calls.

    ``observations`` is the trace's own array of ``type, name, input, output`` (input
    as JSON text). A call's id counts all observations, not only tools.
    """
    def msg(role: str, content: Column | None = None, calls: Column | None = None, call_id: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(role).alias("role"), (none if content is None else content).cast("string").alias("content"),
            (none if calls is None else calls).cast(
                "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"),
            (none if call_id is None else call_id).cast("string").alias("tool_call_id"))

    def pair(o: Column, i: Column) -> Column:
        call_id = F.concat(F.lit("call_"), i.cast("string"))
        call = F.struct(call_id.alias("id"), F.lit("function").alias("type"), F.struct(
            F.coalesce(F.nullif(o["name"], F.lit("")), F.lit("unknown")).alias("name"),
            F.coalesce(F.nullif(o["input"], F.lit("")), F.lit("{}")).alias("arguments")).alias("function"))
        both = F.array(msg("assistant", calls=F.array(call)), msg("tool", F.coalesce(o["output"], F.lit("")), call_id=call_id))
        return F.when(o["type"] == "tool", both)

    calls = F.flatten(F.filter(F.transform(F.coalesce("observations", F.array()), pair), lambda p: p.isNotNull()))
    messages = F.concat(F.array(msg("system", F.lit(system)), msg("user", F.col("input"))), calls, F.array(msg("assistant", F.col("output"))))
    return _complete(traces).select("trace_id", F.to_json(F.struct(messages.alias("messages"))).alias("value"))


def write_jsonl(lines: DataFrame, path: str) -> None:
    """JSON lines, written in parallel."""
    lines.select("value").write.mode("errorifexists").text(path)
