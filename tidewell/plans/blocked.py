"""Ordered windows that survive a hot key.

``Window.partitionBy(key)`` sends every row of a key to one task. Here each
key is cut into consecutive blocks of its order column (a time slot, or a range
of sequence numbers), the window runs per (key, block), and one summary row per
block carries the missing context across block borders. The summaries come from
a map-side combined aggregate and are tiny: one row per (key, block).

The block column must be a non-decreasing function of the order columns, and
neither keys nor block may be null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "_block"


def time_block(ts: str | Column, seconds: int = 6 * 3600) -> Column:
    """Block number of a timestamp column."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(seconds * 1_000_000))


def seq_block(seq: str | Column, width: int = 1 << 20) -> Column:
    """Block number of an integer sequence column."""
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(col / F.lit(width))


# Blocks over the whole range of a sequence, and the least width of one.
BLOCKS, LEAST_WIDTH = 1 << 16, 4096


def balanced_block(df: DataFrame, seq: str) -> Column:
    """Block of a sequence column whose width follows the range of the data.

    At most ``BLOCKS`` blocks exist, which bounds the summary rows of a key, and a
    block holds at most 1/``BLOCKS`` of the range, which bounds the rows of a key in
    one window. Reads the column once.
    """
    ends = df.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).first()
    span = (ends["hi"] - ends["lo"] + 1) if ends["lo"] is not None else 1
    return seq_block(seq, max(LEAST_WIDTH, -(-span // BLOCKS)))


def _as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    lag: dict[str, str | Column] | None = None,
    lead: dict[str, str | Column] | None = None,
    last_before: dict[str, str | Column] | None = None,
    first_after: dict[str, str | Column] | None = None,
    last_until: dict[str, str | Column] | None = None,
    running_sum: dict[str, str | Column] | None = None,
) -> DataFrame:
    """Add ordered-window columns to ``df``, one keyword per kind of column.

    ``lag`` / ``lead``
        value of the previous / next row of the key (null at the edges).
    ``last_before`` / ``first_after``
        latest / earliest non-null value strictly before / after the row.
    ``last_until``
        latest non-null value up to and including the row.
    ``running_sum``
        sum over all rows of the key up to and including the row.
    """
    lag, lead = lag or {}, lead or {}
    last_before, first_after = last_before or {}, first_after or {}
    last_until, running_sum = last_until or {}, running_sum or {}

    keys, order = list(keys), list(order)
    position = F.struct(*[F.col(c) for c in order])
    # A one-field struct tells "the neighbour is null" from "no neighbour".
    boxed = {n: F.struct(_as_col(v).alias("v")) for n, v in {**lag, **lead}.items()}
    values = {n: _as_col(v) for n, v in {**last_before, **first_after, **last_until, **running_sum}.items()}

    df = df.withColumn(BLOCK, block)
    rows = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    until = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    # "After" is "before" in reverse order: a frame that reaches to the end of the
    # partition would be evaluated anew for every row.
    after = Window.partitionBy(*keys, BLOCK).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)

    inner: dict[str, Column] = {}
    summary: list[Column] = []
    for n in lag:
        inner[n] = F.lag(boxed[n]).over(rows)
        summary.append(F.max_by(boxed[n], position).alias(f"_s_{n}"))
    for n in lead:
        inner[n] = F.lead(boxed[n]).over(rows)
        summary.append(F.min_by(boxed[n], position).alias(f"_s_{n}"))
    for n in last_before:
        inner[n] = F.last(values[n], ignorenulls=True).over(before)
    for n in last_until:
        inner[n] = F.last(values[n], ignorenulls=True).over(until)
    for n in (*last_before, *last_until):
        summary.append(F.max_by(values[n], F.when(values[n].isNotNull(), position)).alias(f"_s_{n}"))
    for n in first_after:
        inner[n] = F.last(values[n], ignorenulls=True).over(after)
        summary.append(F.min_by(values[n], F.when(values[n].isNotNull(), position)).alias(f"_s_{n}"))
    for n in running_sum:
        inner[n] = F.sum(values[n]).over(until)
        summary.append(F.sum(values[n]).alias(f"_s_{n}"))

    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry: list[Column] = []
    for n in lag:
        carry.append(F.lag(f"_s_{n}").over(blocks).alias(f"_c_{n}"))
    for n in lead:
        carry.append(F.lead(f"_s_{n}").over(blocks).alias(f"_c_{n}"))
    for n in (*last_before, *last_until):
        carry.append(F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}"))
    for n in first_after:
        carry.append(F.last(f"_s_{n}", ignorenulls=True).over(later).alias(f"_c_{n}"))
    for n in running_sum:
        carry.append(F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}"))

    carried = df.groupBy(*keys, BLOCK).agg(*summary).select(*keys, BLOCK, *carry)
    joined = df.select("*", *[c.alias(f"_i_{n}") for n, c in inner.items()]).join(carried, [*keys, BLOCK], "left")

    out: list[Column] = []
    for n in inner:
        i, c = F.col(f"_i_{n}"), F.col(f"_c_{n}")
        if n in boxed:
            out.append(F.coalesce(i, c).getField("v").alias(n))
        elif n in running_sum:
            out.append(F.when(i.isNull() & c.isNull(), F.lit(None)).otherwise(
                F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))).alias(n))
        else:
            out.append(F.coalesce(i, c).alias(n))
    kept = [F.col(c) for c in df.columns if c != BLOCK and c not in inner]
    return joined.select(*kept, *out)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """Dense 1-based row numbers per key without a single-key window."""
    return with_neighbours(df, keys, order, block, running_sum={name: F.lit(1)})


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction of conditions; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
