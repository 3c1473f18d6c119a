"""Operator 2: best-fit decreasing packing of documents into sequences of bounded length."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidewell.llm.workers import kept, map_texts
from tidewell.session import materialize

SEQUENCE = 2048
END_ID = 0


class WordEncoder(dict):
    """``encoder[piece]``: ids of a piece between blanks as little-endian 32-bit integers, found once.

    Valid for tokenizers that put texts in lower case and cut them at white space and between
    letters, digits and signs before their merges. Special tokens in a text are one id each, as in
    the library's call without options. Plain words, Latin letters and then signs, go
    straight to the merges; every other piece goes through the whole tokenizer.
    """

    OTHER = re.compile("[^\\x00-\\xff]")
    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, model: str, limit: int = 500_000) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_str(model)
        self.merge, self.limit = self.tokenizer.model.tokenize, limit
        self.words: dict[str, bytes] = {}
        # Byte-level alphabet: bytes that are no printable sign of Latin-1 stand at 256 and on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.signs = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}

    def merged(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            data = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
            found = [t.id for t in self.merge(data)]
            ids = self.words[word] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, piece: str) -> bytes:
        plain = self.PLAIN.fullmatch(piece)
        if plain:
            word, signs = plain.groups()
            ids = self.merged(word.lower()) + (self.merged(signs) if signs else b"")
        else:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        self[piece] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        """Ids of a whole text."""
        if len(self) > self.limit:
            self.clear()
            self.words.clear()
        if not text:
            return b""
        if "<|" not in text and not self.OTHER.search(text):
            # So that fewer pieces differ. Beyond Latin-1 the tokenizer's own rules count, and special tokens are met as written.
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE,
           end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth``: documents as tokens, cut to at most ``sequence``.

    ``part`` is the task that made a row and ``nth`` its number among the task's pieces of the
    same length; both are stable once the result is written.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a fixed file, under 2 MB
    name = hashlib.sha256(content.encode()).hexdigest()
    added = StructType([
        StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
        StructField("ids_crc32", LongType()), StructField("part", LongType()), StructField("nth", LongType())])

    def step():
        from pyspark import TaskContext

        encoder = kept(("words", name), lambda: WordEncoder(shared.value))
        part = TaskContext.get().partitionId()
        made = np.zeros(sequence + 1, np.int64)

        end = end_id.to_bytes(4, "little")

        def work(columns, texts):
            rows, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, t in enumerate(texts):
                ids = memoryview(encoder.text(t) + end)
                for k in range(0, len(ids), 4 * sequence):
                    own = ids[k:k + 4 * sequence]
                    n = len(own) // 4
                    rows.append(i)
                    piece.append(k // (4 * sequence))
                    start.append(k // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    nth.append(int(made[n]))
                    made[n] += 1
            taken = pa.array(rows, pa.int64())
            yield [*[c.take(taken) for c in columns], pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int64()),
                   pa.array(nth, pa.int64())]

        return work

    return map_texts(docs, [doc_id], text, added, step)


class OpenBins:
    """Segment tree over remaining capacities 0..n; a leaf holds the open bins with just that much room.

    Bins are held as ranges of consecutive numbers, so that equal bins are moved together.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, n: int) -> None:
        self.ranges.setdefault(room, []).append((first, n))
        node = room + self.leaves
        while node:
            self.count[node] += n
            node //= 2

    def tightest(self, least: int) -> int | None:
        """Smallest room of at least ``least`` that an open bin has: up to the first right neighbour that is not empty, then down."""
        node = least + self.leaves
        if least >= self.leaves:
            return None
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` consecutive bins with this room, removed from the tree."""
        first, n = self.ranges[room].pop()
        taken = min(n, most)
        if taken < n:
            self.ranges[room].append((first + taken, n - taken))
        node = room + self.leaves
        while node:
            self.count[node] -= taken
            node //= 2
        return first, taken


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> np.ndarray:
    """Best-fit decreasing over ``length -> number of pieces``; rows of (length, rank, n, bin, offset, per bin).

    Pieces of one length are interchangeable, so a row places ``n`` of them at once: piece
    ``rank + i`` goes to ``bin + i // per`` at ``offset + i % per * length``. The result is
    that of placing the pieces one by one, longest first, each into the open bin with the
    least sufficient room, or into a new one.
    """
    open_bins, rows, bins = OpenBins(capacity), [], 0
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            room = open_bins.tightest(length)
            if room is None:
                room, first = capacity, bins
                per = room // length
                n = -(-left // per)
                bins += n
            else:
                per = room // length
                first, n = open_bins.take(room, -(-left // per))
            placed = min(left, n * per)
            rows.append((length, rank, placed, first, capacity - room, per))
            full, rest = divmod(placed, per)
            if full:
                open_bins.add(room - per * length, first, full)
            if rest:
                open_bins.add(room - rest * length, first + full, 1)
            left, rank = left - placed, rank + placed
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(made: DataFrame, doc_id: str = "doc_id", sequence: int = SEQUENCE) -> DataFrame:
    """Give each row of ``pieces`` (written and read again) its ``sequence_id`` and ``offset``."""
    by_part = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most one row for each task and length; the running sum numbers the pieces of a length over all tasks.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= 2048 rows
    steps = plan(histogram, sequence)
    shared = made.sparkSession.sparkContext.broadcast(steps)  # bounded by the square of ``sequence``, whatever the input
    numbered = made.join(offsets, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select(
        F.col(doc_id), "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    schema = StructType([*numbered.schema.fields[:5], StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches):
        table = shared.value
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            # Rows of the table are in order of (length, rank); the last one not after a piece holds it.
            wide = 1 << 40
            row = np.searchsorted(table[:, 0] * wide + table[:, 1], length * wide + rank, side="right") - 1
            t = table[row]
            i = rank - t[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t[:, 3] + i // t[:, 5]), pa.array(t[:, 4] + i % t[:, 5] * length)], names=schema.names)

    return numbered.mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE,
                     end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row a piece.

    A document is its ids and then ``end_id``; only documents longer than ``sequence`` are cut.
    All pieces are packed together by best fit decreasing: what reaches the driver is the number
    of pieces of each length, and the plan made from it holds for any number of documents. Null
    and empty texts are the end id alone; a null id stays null; repeated rows are packed each;
    an empty table gives no rows.
    """
    made = materialize(pieces(docs, tokenizer, doc_id, text, sequence, end_id), "pieces")
    return pack(made, doc_id, sequence)
