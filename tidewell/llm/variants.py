"""Operator 12: spelling variants, found over a reduced alphabet.

1. Words are counted by Spark; the letters of each distinct word are hashed to a few symbols.
2. Every distinct reduced word generates its full neighbourhood: itself and every reduced word that
   one inserted, deleted or replaced symbol away. Neighbours travel as 64-bit hashes, computed from
   the hashes of heads and tails, so that a word of any length costs its length in rows, not in text.
3. Neighbourhoods meet the reduced vocabulary. One edit of a word is at most one edit of its reduced
   word, so no pair of near words is lost; what meets is compared as it was written. A bitmap of
   bounded size keeps most neighbours that are no reduced word from travelling to that join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize

#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: A word's form has at least so many times its occurrences.
TIMES = 10
#: Letters (times words of one length) that one step of the generation holds.
STEP_LETTERS = 1 << 19
#: Bits for each reduced word in the bitmap, and the most bits it has (as powers of two); beyond, more neighbours travel.
BITS_PER_WORD, MOST_BITS = 4, 29
#: A form is at least ten times as frequent as its word, so chains of forms end within 19 steps: fewer than 2^5.
ROUNDS = 5

RUN = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = np.uint64(0x9E3779B97F4A7C15)


def code_of(symbol: np.ndarray) -> np.ndarray:
    """A 64-bit value for each symbol."""
    x = (symbol.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) | np.uint64(1)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word with each letter replaced by one of ``symbols`` digits."""
    letters = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]]
    return F.translate(word, "".join(letters), "".join(str(ord(c) * 40503 // 64 % symbols) for c in letters))


def final_hash(raw: np.ndarray, length: int) -> np.ndarray:
    x = raw ^ np.uint64((length + 1) * 0x94D049BB133111EB % 2**64)
    return x ^ (x >> np.uint64(31))


def heads(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length (codes, a row each): sums of their first i codes, each times a power of the base, and the powers.

    The last code counts once, the one before it times the base, and so on; the full sum is the hash.
    """
    n, length = words.shape
    power = np.r_[np.uint64(1), np.cumprod(np.full(length, BASE, np.uint64), dtype=np.uint64)]
    head = np.zeros((n, length + 1), np.uint64)
    head[:, 1:] = np.cumsum(words * power[:length][::-1], axis=1, dtype=np.uint64)
    return head, power


def neighbourhood(words: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``row, hash`` of the words themselves and of every neighbour, each once, kind of edit by kind.

    An inserted symbol moves the symbols before it up by one power of the base. A deleted one moves
    them down, which is a product with the inverse of the (odd) base. Of a run of equal symbols,
    only the first is deleted, and a symbol is not inserted before itself: that gives no new word.
    """
    n, length = words.shape
    row = np.arange(n)
    head, power = heads(words)
    whole, place = head[:, -1:], power[:length][::-1]
    tail = whole - head
    yield row, final_hash(whole[:, 0], length)
    new = np.ones((n, length), bool)
    new[:, 1:] = words[:, 1:] != words[:, :-1]
    shorter = head[:, :-1] * np.uint64(pow(int(BASE), -1, 2**64)) + tail[:, 1:]
    yield np.nonzero(new)[0], final_hash(shorter[new], length - 1)
    for code in code_of(np.arange(symbols)):
        other = words != code
        yield np.nonzero(other)[0], final_hash((whole + (code - words) * place)[other], length)
        before = np.column_stack([other, np.ones(n, bool)])
        yield np.nonzero(before)[0], final_hash((head * BASE + code * np.r_[power[length], place] + tail)[before], length + 1)


def codes(words: list[str]) -> np.ndarray:
    """Reduced words of one length as rows of codes."""
    digits = np.frombuffer("".join(words).encode("ascii"), np.uint8).reshape(len(words), -1)
    return code_of(digits - np.uint8(ord("0")))


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Positions of words of one length, few enough for one step."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        step = max(1, STEP_LETTERS // max(1, length))
        yield from (at[i:i + step] for i in range(0, len(at), step))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hash of the reduced word to ``word, n, reduced``."""
    for batch in batches:
        words, out = batch.column(2).to_pylist(), np.zeros(batch.num_rows, np.uint64)
        for at in _by_length(words):
            own = codes([words[i] for i in at])
            out[at] = final_hash(heads(own)[0][:, -1], own.shape[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=["word", "n", "reduced", "r"])


def membership(names: DataFrame) -> tuple[int, bytes]:
    """The number of leading bits of a hash that are looked up, and a bitmap of those that the column ``r`` holds.

    It is built in buckets by the tasks, and has at most 2^MOST_BITS bits (64 MB).
    """
    bits = min(MOST_BITS, max(15, names.count().bit_length() + BITS_PER_WORD))
    place = F.shiftrightunsigned("r", 64 - bits) + 1  # buckets count from 1
    found = names.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("held"))
    out = np.zeros(2**bits // 8, np.uint8)
    for row in found.collect():
        part = np.frombuffer(row["held"], np.uint8)
        out[(row["bucket"] - 1) * len(part):row["bucket"] * len(part)] = part
    return bits, out.tobytes()


def _generate(symbols: int, bits: int, held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            words, r = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at in _by_length(words):
                for row, near in neighbourhood(codes([words[i] for i in at]), symbols):
                    place = near >> np.uint64(64 - bits)
                    there = (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    yield pa.RecordBatch.from_arrays([pa.array(r[at[row[there]]]), pa.array(near[there].view(np.int64))], names=["r", "v"])

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether two different words differ by one inserted, deleted or replaced code point; takes the time of reading them."""
    if len(a) > len(b):
        a, b = b, a
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if n < len(b) else a[i + 1:] == b[i + 1:]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``word, n, near, near_n``, the pairs that are one edit apart."""
    for batch in batches:
        yield batch.filter(pa.array(map(one_edit, batch.column(0).to_pylist(), batch.column(2).to_pylist()), pa.bool_()))


def document_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7) -> DataFrame:
    """``word``: each maximal run of letters of at least ``least`` code points, A-Z lower-cased; a row for each occurrence.

    Let h be the unsigned crc32 of ``<doc_id>:<run>`` (a null id is empty). Where 31 divides h, the
    code point at h modulo the length is deleted first, and the word may become too short.
    """
    # Only runs that are long enough are met: a run is maximal, and shorter ones cannot grow.
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{RUN}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"), F.explode(found).alias("x"))
    rows = rows.select("i", F.translate("x", UPPER, LOWER).alias("x"))
    rows = rows.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "x").cast("binary")))
    at = F.pmod(F.col("h"), F.length("x").cast("long")).cast("int")
    cut = F.concat(F.substring("x", F.lit(1), at), F.substring("x", at + 2, F.length("x")))
    return rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("x")).alias("word")).filter(F.length("word") >= least)


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words of ``vocabulary`` (``word, n, reduced, r``) that are one edit apart."""
    names = materialize(vocabulary.select("reduced", "r").distinct(), "reduced")
    bits, bitmap = membership(names)
    held = vocabulary.sparkSession.sparkContext.broadcast(bitmap)
    sent = names.mapInArrow(_generate(symbols, bits, held), "r long, v long")
    met = materialize(sent.join(names.select(F.col("r").alias("s")).distinct(), F.col("v") == F.col("s"), "left_semi").distinct(), "met")
    left = vocabulary.select("word", "n", F.col("r").alias("a"))
    right = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("r").alias("b"))
    # Each pair is compared once, the smaller word first, and told to both.
    likely = (F.col("word") < F.col("near")) & (F.abs(F.length("word") - F.length("near")) <= 1)
    pairs = left.join(met, F.col("a") == F.col("r")).join(right, (F.col("v") == F.col("b")) & likely).select("word", "n", "near", "near_n")
    both = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.mapInArrow(_verified, pairs.schema).select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word reached from each word by following ``word, form``.

    Each round doubles the steps taken, over a written table; a chain has under 2^ROUNDS steps.
    """
    jumps = materialize(forms.select("word", F.col("form").alias("root")), "jumps")
    for _ in range(ROUNDS):
        further = jumps.select(F.col("word").alias("via"), F.col("root").alias("end"))
        jumps = materialize(jumps.join(further, F.col("root") == F.col("via"), "left").select("word", F.coalesce("end", "root").alias("root")), "jumps")
    return jumps


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, occurrences: int = 2, times: int = TIMES,
                      symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root string; n, n_near, form_n long``: a row for each word of at least ``least`` code points and ``occurrences``.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A
    word's form is its near word of largest n (ties: the smallest in code-point order), if that
    has at least ``times`` the word's n; else null. ``root`` follows forms to the last word. Null
    and empty texts have no words; repeated rows count again; a table without words gives no rows.
    Other columns are not read. ``times`` is at least 10, for chains to end.
    """
    if times < TIMES or not 1 <= symbols <= 10:
        raise ValueError("times is at least 10, and symbols at most 10")
    counted = document_words(docs, doc_id, text, least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= occurrences)
    vocabulary = materialize(counted.withColumn("reduced", reduced(F.col("word"), symbols)).mapInArrow(
        _hashed, "word string, n long, reduced string, r long"), "vocabulary")
    near = near_words(vocabulary, symbols)
    found = near.groupBy(F.col("word").alias("w")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    judged = vocabulary.select("word", "n").join(found, F.col("word") == F.col("w"), "left")
    fits = -F.col("best.minus") >= times * F.col("n")
    judged = materialize(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.minus")).alias("form_n")), "judged")
    ends = roots(judged.filter(F.col("form").isNotNull()).select("word", "form")).withColumnRenamed("word", "w")
    return judged.join(ends, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = """
WITH RECURSIVE bytes AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
hexed AS (SELECT x, hex(encode(i || ':' || x)) AS d FROM runs WHERE length(x) >= 7),
hashed AS (SELECT x, xor(list_reduce(list_transform(range(length(d) // 2), lambda j: ('0x' || substr(d, 2 * j + 1, 2))::BIGINT),
    lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295) AS h FROM hexed, bytes),
words AS (SELECT CASE WHEN h % 31 = 0 THEN x[:h % length(x)] || x[h % length(x) + 2:] ELSE x END AS word FROM hashed),
v AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
holes AS (SELECT word, n, j, word[:j] || word[j + 2:] AS hole FROM (SELECT word, n, unnest(range(length(word))) AS j FROM v)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (j, hole) WHERE a.word <> b.word
    UNION SELECT holes.word, v.word, v.n FROM holes JOIN v ON hole = v.word
    UNION SELECT v.word, holes.word, holes.n FROM holes JOIN v ON hole = v.word),
best AS (SELECT word, count(*) AS n_near, min(row(-near_n, near)) AS b FROM near GROUP BY word),
judged AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * v.n THEN b[2] END AS form,
    CASE WHEN -b[1] >= 10 * v.n THEN -b[1] END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM judged UNION ALL
    SELECT walk.word, judged.word, judged.form FROM walk JOIN judged ON walk.next = judged.word)
SELECT j.word, j.form, w.root, j.n::BIGINT AS n, j.n_near::BIGINT AS n_near, j.form_n::BIGINT AS form_n
FROM judged j JOIN walk w ON w.word = j.word AND w.next IS NULL
"""
