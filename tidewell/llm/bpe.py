"""Operator 10: byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tidewell.llm.workers import BoundedCache, kept, map_texts
from tidewell.session import materialize

#: Buckets of the literal rank map; a lookup reads the entries of one bucket.
BUCKETS = 8192
#: A word is encoded ahead if it makes up at least this share of all words; so at most 1 / SHARE are.
SHARE = 1 / 200_000
#: Longest word, in bytes, that is encoded ahead.
LONGEST = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece -> id of a rank file (base64 piece and rank a line)."""
    with open(path, "rb") as file:
        return parse_ranks(file.read())


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rank_of(ranks: dict[bytes, int]) -> Callable[[Column], Column]:
    """Rank of a piece given as lower-case hex, null where it has none; the ranks are a literal of the plan."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    return lambda key: F.try_element_at(F.get(literal, (F.crc32(key) % BUCKETS).cast("int")), key)


def encoded_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """``word, ids`` for distinct words: ranked merges folded over the bytes of each by higher-order functions.

    A word that is itself a piece is that piece. Else the adjacent pair of least rank, the
    leftmost of these, is merged until no pair has a rank.
    """
    rank = rank_of(ranks)

    def merge(parts: Column, _: Column) -> Column:
        def best(pairs: Column) -> Column:
            return _let(F.array_position(pairs, F.array_min(pairs)).cast("int"), lambda p: F.when(
                F.coalesce(p, F.lit(0)) == 0, parts).otherwise(F.concat(
                    F.slice(parts, F.lit(1), p - 1), F.array(F.concat(F.get(parts, p - 1), F.get(parts, p))),
                    F.slice(parts, p + 2, F.greatest(F.size(parts) - p - 1, F.lit(0))))))

        pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
                            lambda right, i: rank(F.concat(F.get(parts, i), right)))
        return F.when(F.size(parts) < 2, parts).otherwise(_let(pairs, best))

    text = F.lower(F.hex(F.encode(F.col(word), "UTF-8")))
    n = F.octet_length(F.col(word))
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("h"), i * 2 - 1, F.lit(2)))
    rounds = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(rounds, single, merge)
    return words.select(word, text.alias("h")).filter(F.length("h") > 0).select(
        word, F.coalesce(F.array(rank(F.col("h"))), F.array().cast("array<int>")).alias("whole"), folded.alias("parts")
    ).select(word, F.when(F.get("whole", F.lit(0)).isNotNull(), F.col("whole")).otherwise(
        F.transform("parts", lambda p: rank(p))).alias("ids"))


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one word: for words that are rare or long."""
    if word in ranks:
        return [ranks[word]]
    return _merge_long(word, ranks) if len(word) > LONGEST else _merge_short(word, ranks)


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    none, rank = 1 << 40, ranks.get
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [rank(word[i:i + 2], none) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    # A part starts at i and ends at end[i]; the next one starts at end[i].
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or end[mid] != stop:
            continue
        alive[mid], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if before[i] >= 0 and (r := ranks.get(word[before[i]:stop])) is not None:
            heapq.heappush(heap, (r, before[i], i, stop))
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


def frequent_words(docs: DataFrame, pattern: str, text: str = "text", share: float = SHARE) -> DataFrame:
    """``word``: the distinct words that make up at least ``share`` of all words of all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit("(?U)" + pattern), F.lit(0))).alias("word"))
    counts = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return counts.filter((F.col("n") >= share * total) & (F.octet_length("word") <= LONGEST)).select("word")


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
           share: float = SHARE) -> DataFrame:
    """``doc_id, ids array<int>``: the texts as ids, each match of ``pattern`` by itself, without special tokens.

    Frequent distinct words are encoded once by Spark and sent to the tasks; there are at most
    ``1 / share`` of them, however large the corpus. A task encodes the other words itself, by
    the same merges. Null and empty texts have no ids, null ids stay null, repeated rows give a
    row each, an empty table gives no rows.
    """
    with open(ranks_path, "rb") as file:
        content = file.read()
    sc = docs.sparkSession.sparkContext
    ranks = parse_ranks(content)
    ready = {r.word: np.array(r.ids, "<i4").tobytes()
             for r in encoded_words(frequent_words(docs, pattern, text, share), ranks).collect()}
    shared_ranks, shared_words = sc.broadcast(content), sc.broadcast(ready)  # a fixed file; at most 1 / share short words
    name = hashlib.sha256(content).hexdigest()

    def step():
        own_ranks = kept(("ranks", name), lambda: parse_ranks(shared_ranks.value))

        def own(word):
            ids = merge_bytes(word.encode("utf-8", "surrogatepass"), own_ranks)
            return struct.pack(f"<{len(ids)}i", *ids)

        words = kept(("words", name), lambda: BoundedCache(own, len(shared_words.value) + 600_000, shared_words.value))
        cut = regex.compile(pattern)

        def work(columns, texts):
            for at in range(0, len(texts), 1024):
                found, ends = [], [0]
                for t in texts[at:at + 1024]:
                    found.append(b"".join(map(words.__getitem__, cut.findall(t))) if t else b"")
                    ends.append(ends[-1] + len(found[-1]) // 4)
                    words.trim()
                values = pa.array(np.frombuffer(b"".join(found), "<i4"))
                yield [*[c.slice(at, 1024) for c in columns], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]

        return work

    return map_texts(docs, [doc_id], text, StructType([StructField("ids", ArrayType(IntegerType()))]), step)


def _looked_up(values: list[str], ids: Column) -> Column:
    """The strings of ``ids`` one after another; ``values`` by id are a literal of the plan."""
    literal = F.from_json(F.lit(json.dumps(values)), "array<string>")
    return F.array_join(F.transform(ids, lambda i: F.get(literal, i)), "")


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of ``ids``: their binary pieces, one after another. Ids without a piece add nothing."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return F.unhex(_looked_up(pieces, ids))


def little_endian(ids: Column, size: int) -> Column:
    """``ids``, all below ``size``, as little-endian unsigned 32-bit integers."""
    return F.unhex(_looked_up([i.to_bytes(4, "little").hex() for i in range(size)], ids))


def decode(encoded: DataFrame, ranks_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, decoded binary``: the bytes that ``encode`` read. Null ids give null, no ids no bytes."""
    return encoded.select(doc_id, decoded(F.col(ids), read_ranks(ranks_path)).alias("decoded"))
