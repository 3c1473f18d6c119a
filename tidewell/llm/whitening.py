"""Operator 11: whitening of embeddings, from a blockwise QR and a bidiagonal qd solver (``qd``)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tidewell.llm import qd
from tidewell.session import materialize

#: An entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64.0, 1_000_000
#: Scaled entries beyond this are held at it: up to here doubles are exact integers.
LARGEST = float(2**53)
COMPONENTS = 16
#: Triangular factors that one task folds into one.
FAN = 16


@dataclass(frozen=True)
class Centre:
    """The number of fitted vectors and their means, as whole numbers and rests: mean = whole + rest / n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def steps(self, x: np.ndarray) -> np.ndarray:
        """x - whole, exactly."""
        return x - self.whole

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """sum((n x - sum)^2) of each row, exactly; null beyond the range of a long."""
        steps = self.steps(x)
        rough = ((self.n * steps.astype(np.float64) - self.rest) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            apart = np.int64(self.n) * steps - self.rest
            out = (apart * apart).sum(axis=1)
        close = np.flatnonzero(np.abs(rough / 2.0**63 - 1) < 1e-9)
        fits = rough < 2.0**63
        for i in close.tolist():
            exact = sum((self.n * int(s) - int(r)) ** 2 for s, r in zip(steps[i], self.rest, strict=True))
            fits[i], out[i] = exact < 2**63, exact if exact < 2**63 else 0
        return pa.array(out, mask=~fits)


def integral(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, x array<long>`` of the vectors without null or non-finite entries and of the width that most of them have."""
    rows = embeddings.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    held = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))) + F.lit(OFFSET))
    return rows.filter(F.size("v") == (width["w"] if width else 0)).select("id", held.cast("array<long>").alias("x"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _centre(fit: DataFrame) -> Centre | None:
    """Exact sums by dimension; each task sends one row for each dimension."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), batch.num_rows)
                n, upper, lower = n + len(x), upper + (x >> 26).sum(axis=0), lower + (x & (2**26 - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(upper))), pa.array(np.full(len(upper), n)), pa.array(upper), pa.array(lower)], names=["d", "n", "u", "l"])

    wide = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("u", "l")}
    sums = fit.mapInArrow(part, "d long, n long, u long, l long").groupBy("d").agg(F.sum("n").alias("n"), *wide.values()).orderBy("d").collect()
    if not sums:
        return None
    n = sums[0]["n"]
    totals = [(int(r["u"]) << 26) + int(r["l"]) for r in sums]
    return Centre(n, np.array([t // n for t in totals], np.int64), np.array([t % n for t in totals], np.int64))


def _fold(factor: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """The triangular factor of what is above and below each other, square."""
    stacked = block if factor is None else np.vstack([factor, block])
    out = np.linalg.qr(stacked, mode="r")
    return out if len(out) == out.shape[1] else np.vstack([out, np.zeros((out.shape[1] - len(out), out.shape[1]))])


def _triangle(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred rows: a factor for each task, folded in groups until one is left."""
    width = len(centre.whole)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for batch in batches:
            if batch.num_rows:
                factor = _fold(factor, centre.centred(_matrix(batch.column(0), batch.num_rows)))
        if factor is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([factor.tobytes()], pa.binary())], names=["part", "r"])

    def meet(group: pa.Table) -> pa.Table:
        factor = None
        for row in group.sort_by("part").to_pylist():
            factor = _fold(factor, np.frombuffer(row["r"]).reshape(width, width))
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN], pa.int64()), "r": pa.array([factor.tobytes()], pa.binary())})

    factors = materialize(fit.mapInArrow(part, "part long, r binary"), "factors")
    while factors.count() > 1:
        factors = materialize(factors.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(meet, "part long, r binary"), "factors")
    return np.frombuffer(factors.first()["r"]).reshape(width, width)


def _identity_error(fit: DataFrame, centre: Centre, project: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = project.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = centre.centred(_matrix(batch.column(0), batch.num_rows)) @ project
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "x"])

    sums = np.zeros((k + 1, k))
    for r in fit.mapInArrow(part, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        sums[r["i"], r["j"]] = r["x"] / centre.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component int, n long, deviation long, whitened, explained, identity_error``: by row and component, up to ``components``.

    An entry c counts as x = floor(64 c) + 1000000. The fit list holds every distinct x vector once;
    means, covariance (divisor n) and components come from it. Components are numbered from 1 by
    falling eigenvalue; those whose eigenvalue is zero to rounding are left out, so fewer vectors
    than ``components`` give fewer components, and a single distinct vector or an empty table no rows.

    Rows whose vector is null or empty, holds null or non-finite entries, or has another width than
    most vectors (ties: the wider) are left out; zero vectors take part. Repeated rows have rows each
    and are fitted once; a null id stays null. Scaled entries beyond 2^53 are held there. A
    ``deviation`` beyond the range of a long is null. Other columns are not read.

    Every task reduces its rows to one triangular factor, and factors are folded in groups; what
    reaches the driver is bounded by the width: means, one factor, a covariance of ``components``.
    """
    rows = integral(embeddings, vec_id, vector)
    fit = materialize(rows.select("x").distinct(), "fit")
    centre = _centre(fit)
    schema = StructType([
        StructField(vec_id, embeddings.schema[vec_id].dataType), StructField("component", IntegerType()), StructField("n", LongType()),
        StructField("deviation", LongType()), *[StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    if centre is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    factor = _triangle(fit, centre)
    values, vectors = qd.directions(factor, components)
    if not len(values):
        return embeddings.sparkSession.createDataFrame([], schema)
    project = vectors / np.sqrt(values / centre.n)
    explained = values / float((factor * factor).sum())
    error = _identity_error(fit, centre, project)
    k, names = len(values), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                x = _matrix(batch.column(1), m)
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)),
                    centre.deviation(x).take(row), pa.array((centre.centred(x) @ project).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error))], names=names)

    return rows.mapInArrow(run, schema)
