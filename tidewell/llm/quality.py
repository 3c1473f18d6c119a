"""Operator 3: quality from compressed sizes under dictionaries of good and bad text."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewell.llm.workers import kept, map_texts
from tidewell.session import materialize

#: Bound of the training sample: labelled documents of each class, and pieces of each document.
SAMPLE_DOCS = 1500
SAMPLE_PIECES = 8
PIECE_BYTES = 4096
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: Range of the hash that draws the sample.
HASHES = 1 << 40
REJECT_BELOW = 0.3


def in_fold(doc_id: Column, fold: int = 0, folds: int = 5) -> Column:
    """Whether crc32 of the id as text has this remainder; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds == fold


def pieces_of(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too little text for training, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Compressors:
    """Compressed sizes under the bad and under the good dictionary."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        self.both = [self._compressor(d) for d in (bad, good)]

    @staticmethod
    def _compressor(content: bytes):
        if not content:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, pieces: list[bytes]) -> tuple[float, float, float]:
        """Bytes that the good dictionary saves against the bad one, by byte of text; how far the
        better one squeezes the text beyond what prose allows; and how short the text is (0 to 1).
        """
        bad, good = (sum(len(c.compress(p)) for p in pieces) for c in self.both)
        size = sum(map(len, pieces))
        saved = float(np.clip((bad - good) / (size + 64), -0.05, 0.1))
        return saved, max(0.0, 0.25 - min(bad, good) / (size + 16)), float(np.exp(-size / 64))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
    return w


@dataclass(frozen=True)
class QualityModel:
    bad: bytes
    good: bytes
    weights: tuple[float, float, float, float]

    def score(self, compressors: Compressors, text: str | None) -> float:
        x = sum(w * f for w, f in zip(self.weights, (1.0, *compressors.features(pieces_of(text))), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _draw(ids: DataFrame, sample_docs: int) -> list[tuple]:
    """``i, y, h`` of at most ``sample_docs`` ids of each label: those with the smallest hashes, from rows of ``i, y``.

    A threshold from the number of ids keeps all but about twice as many in their tasks, so what
    reaches the driver is bounded, however many ids and tasks there are.
    """
    hashed = ids.select("i", "y", F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(HASHES)).alias("h"))
    out = []
    for row in sorted(ids.groupBy("y").count().collect(), key=lambda r: r["y"]):
        below = min(HASHES, HASHES * (2 * sample_docs + 50) // row["count"])
        own = hashed.filter((F.col("y") == row["y"]) & (F.col("h") < below))
        out += [(r["i"], r["y"], r["h"]) for r in own.orderBy("h", "i").limit(sample_docs).collect()]
    return out


def _sample(texts: DataFrame, drawn: list[tuple], sample_pieces: int) -> list[tuple[int, list[bytes]]]:
    """``label, pieces`` of the drawn ids, in the order of their hashes, from rows of ``i, t``; of an id's texts one is taken."""
    if not drawn:
        return []
    kind = texts.schema["i"].dataType.simpleString()
    chosen = F.broadcast(texts.sparkSession.createDataFrame(drawn, f"own_id {kind}, y int, h long"))  # as many as were drawn
    rows = texts.join(chosen, F.col("i") == F.col("own_id")).select("h", "y", F.col("t").cast("string").alias("t"))

    def cut(batches):
        for batch in batches:
            hashes, labels, held = batch.column(0), batch.column(1), []
            for t in batch.column(2).to_pylist():
                found = pieces_of(t)
                every = max(1, -(-len(found) // sample_pieces))
                held.append(found[::every])
            yield pa.RecordBatch.from_arrays([hashes, labels, pa.array(held, pa.list_(pa.binary()))], names=["h", "y", "p"])

    found = rows.mapInArrow(cut, "h long, y int, p array<binary>").groupBy("y", "h").agg(F.min("p").alias("p")).collect()
    return [(r["y"], [bytes(p) for p in r["p"]]) for r in sorted(found, key=lambda r: (r["y"], r["h"]))]


def fit(sample: list[tuple[int, list[bytes]]]) -> QualityModel:
    """Dictionaries and calibration from ``label, pieces`` of documents.

    The calibration sees sizes under dictionaries of the other half of the sample. Without a class,
    every score is that of the class that is there, or 0.5.
    """
    if len({y for y, _ in sample}) < 2:
        only = {y for y, _ in sample}
        return QualityModel(b"", b"", (6.0 if only == {1} else -6.0 if only == {0} else 0.0, 0.0, 0.0, 0.0))

    def dictionaries(part):
        return [_dictionary([p for y, ps in part if y == c for p in ps]) for c in (0, 1)]

    # Copies have one hash of their text, and so fall into the same half.
    halves = [[r for r in sample if int(hashlib.md5(b"".join(r[1])).hexdigest(), 16) % 2 == k] for k in (0, 1)]
    x, target = [], []
    for own, other in (halves, halves[::-1]):
        if {y for y, _ in other} == {0, 1}:
            compressors = Compressors(*dictionaries(other))
            x += [compressors.features(ps) for _, ps in own]
            target += [y for y, _ in own]
    weights = _logistic(np.array(x), np.array(target)) if len(set(target)) == 2 else np.array([0.0, 30.0, 0.0, 0.0])
    bad, good = dictionaries(sample)
    return QualityModel(bad, good, tuple(map(float, weights)))


def scores(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score double`` (0 to 1, higher: better), one row for each row.

    Whole texts are scored, piece by piece. Null and empty texts have the score of a text of no
    length; null ids stay null; repeated rows have a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    name = hashlib.sha256(repr((model.weights, model.bad, model.good)).encode()).hexdigest()

    def step():
        own = shared.value
        compressors = kept(("quality", name), lambda: Compressors(own.bad, own.good))
        return lambda columns, texts: iter([[*columns, pa.array([own.score(compressors, t) for t in texts], pa.float64())]])

    return map_texts(docs, [doc_id], text, StructType([StructField("score", DoubleType())]), step)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample_docs: int = SAMPLE_DOCS, sample_pieces: int = SAMPLE_PIECES) -> QualityModel:
    """The model of the labels (0 or 1) whose crc32(id as text) mod 5 is not 0.

    At most ``sample_docs`` documents of each class (the first by a hash of the id) and
    ``sample_pieces`` evenly spread pieces of each reach the driver. They are drawn from ids alone:
    texts are read once, beside the drawn ids, and never shuffled. A label whose id is null or met
    twice with different values is not learnt from, nor is a null text; of repeated ids one text is.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("own_id")).agg(
        F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("top")).filter("y = top and y in (0, 1)").select("own_id", "y")
    open_ = docs.filter(~in_fold(F.col(doc_id)) & F.col(text).isNotNull())
    ids = open_.select(F.col(doc_id).alias("i")).distinct().join(known, F.col("i") == F.col("own_id")).select("i", "y")
    drawn = _draw(materialize(ids, "labelled"), sample_docs)
    return fit(_sample(open_.select(F.col(doc_id).alias("i"), F.col(text).alias("t")), drawn, sample_pieces))


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
            threshold: float = REJECT_BELOW) -> DataFrame:
    """``doc_id, held_out boolean, score double, predicted int`` of every row of ``docs``, by what ``learn`` finds."""
    found = scores(docs, learn(docs, labels, doc_id, text, label), doc_id, text)
    return found.select(
        F.col(doc_id), F.coalesce(in_fold(F.col(doc_id)), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
