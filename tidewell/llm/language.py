"""Operator 7: language by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewell.llm.quality import in_fold
from tidewell.llm.workers import kept, map_texts

#: Bound of what is learnt, all of which is used: documents a language, spread pieces of each, and letters of a piece.
SAMPLE_DOCS = 100
SAMPLE_PIECES = 5
PIECE_LETTERS = 60
#: Range of the hash that draws the sample.
HASHES = 1 << 40
#: Texts are parsed in pieces of so many signs, side by side; a phrase ends with its piece.
PIECE = 512
UNKNOWN = "und"
#: How fast the score rises with the gap between the best two languages, in phrases by sign.
SHARPNESS = 60.0


NO_LETTER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, runs without letters as single blanks; empty without any letter."""
    out = NO_LETTER.sub(" ", text.lower()).strip()
    return out if any(map(str.isalpha, out)) else ""


class SuffixAutomaton:
    """Transitions of the smallest automaton that accepts every substring of ``codes``."""

    def __init__(self, codes: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            state = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state


class CrossParser:
    """Counts phrases: each is the longest match with a reference text, the next one starts after it.

    The automata of all languages stand in one table. From a state, a sign either goes on or,
    where nothing matches, starts a new phrase from the root; that is one look-up for each sign
    and language, done for many pieces of text at once. A sign no reference holds is a phrase.
    """

    def __init__(self, references: tuple[tuple[str, str], ...]) -> None:
        self.languages = [name for name, _ in references]
        signs = sorted({c for _, text in references for c in text} | {" "})
        self.size = len(signs) + 1  # and one for all others
        self.points = np.array([ord(c) for c in signs], np.uint32)
        self.code = np.full(1 + max(map(ord, signs), default=0), len(signs), np.int32)
        self.code[self.points] = np.arange(len(signs))
        tables, roots, base = [], [], 0
        for _, text in references:
            automaton = SuffixAutomaton([int(self.code[ord(c)]) for c in text])
            # Twice the state that follows; odd where a new phrase starts.
            first = np.zeros(self.size, np.int32)
            for c, s in automaton.next[0].items():
                first[c] = base + s
            first[first == 0] = base
            table = np.tile(2 * first + 1, (len(automaton.next), 1))
            for state, moves in enumerate(automaton.next):
                if state:
                    for c, s in moves.items():
                        table[state, c] = 2 * (base + s)
            tables.append(table)
            roots.append(base)
            base += len(automaton.next)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int64)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases by language (rows) of each text (columns)."""
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        if not texts or not self.languages:
            return out
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(points < len(self.code), self.code[np.minimum(points, len(self.code) - 1)], self.size - 1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        count = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(sizes) - sizes, count) + number * PIECE
        length = np.minimum(PIECE, np.repeat(sizes, count) - number * PIECE)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        width = int(length.max(initial=0))
        active = np.searchsorted(-length, -np.arange(width), side="left")  # pieces longer than each step
        state = np.repeat(self.roots[:, None], len(owner), axis=1).astype(np.int32)
        total = np.zeros((len(self.languages), len(owner)), np.int32)
        for i in range(width):
            n = active[i]
            after = self.table[state[:, :n] * self.size + codes[start[:n] + i]]
            total[:, :n] += after & 1
            state[:, :n] = after >> 1
        for k in range(len(self.languages)):
            out[k] = np.bincount(owner, weights=total[k], minlength=len(texts)).astype(np.int64)
        return out


def references(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS,
               sample_pieces: int = SAMPLE_PIECES, piece_letters: int = PIECE_LETTERS) -> tuple[tuple[str, str], ...]:
    """(language, text) of a bounded sample: for each language ``sample_docs`` documents, the first by a hash of the key.

    Of each document ``sample_pieces`` evenly spread pieces count, from its start to its end. A
    threshold from a language's number of documents keeps all but about twice as many in their
    tasks. The number of languages is that of the different labels.
    """
    from pyspark.sql.window import Window

    raw = 4 * piece_letters  # signs of a piece before blanks, digits and signs go
    whole = F.col(text).cast("string")
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["l"]: r["count"] for r in known.groupBy(F.col(lang).cast("string").alias("l")).count().collect()}
    if not counts:
        return ()
    below = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(HASHES, HASHES * (2 * sample_docs + 50) // n))])
    rows = known.select(F.col(lang).cast("string").alias("l"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(HASHES)).alias("h"), whole.alias("t"))
    places = F.transform(F.sequence(F.lit(0), F.lit(sample_pieces - 1)), lambda i: F.substring(
        F.col("t"), (F.greatest(F.length("t") - raw, F.lit(0)) * i / max(1, sample_pieces - 1)).cast("int") + 1, F.lit(raw)))
    rows = rows.filter(F.col("h") < F.try_element_at(below, F.col("l"))).select("l", "h", places.alias("p"))
    order = F.row_number().over(Window.partitionBy("l").orderBy("h", "p"))
    held: dict[str, list[str]] = {}
    for r in rows.withColumn("n", order).filter(F.col("n") <= sample_docs).orderBy("l", "h", "p").collect():
        held.setdefault(r.l, []).extend(plain(p)[:piece_letters] for p in r.p)
    # Copies teach nothing new.
    return tuple((name, " ".join(dict.fromkeys(t for t in texts if t))) for name, texts in sorted(held.items()))


def language(docs: DataFrame, learnt: tuple[tuple[str, str], ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred string, score double`` of every row of ``docs``.

    The language whose reference needs the fewest phrases for the whole text wins; ties go to the
    name that comes first. ``und`` with score 0 where a text is null or has no letter, or nothing
    was learnt. The score is a softmax over minus the phrases by sign. Null ids stay null;
    repeated rows have a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learnt)  # the bounded sample of each language
    name = hashlib.sha256(repr(learnt).encode()).hexdigest()

    def step():
        parser = kept(("parser", name), lambda: CrossParser(shared.value))

        def work(columns, texts):
            for at in range(0, len(texts), 512):
                own = [plain(t) if t else "" for t in texts[at:at + 512]]
                phrases = parser.phrases(own)
                langs, found = [], []
                for i, t in enumerate(own):
                    if not t or not parser.languages:
                        langs.append(UNKNOWN)
                        found.append(0.0)
                        continue
                    cost = phrases[:, i]
                    best = int(cost.argmin())
                    langs.append(parser.languages[best])
                    found.append(float(1 / np.exp(-SHARPNESS * (cost - cost[best]) / len(t)).sum()))
                yield [*[c.slice(at, 512) for c in columns], pa.array(langs, pa.string()), pa.array(found, pa.float64())]

        return work

    added = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_texts(docs, [doc_id], text, added, step)


def held_out_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learnt from rows whose crc32(id as text) mod 3 is not 1."""
    fold = in_fold(F.col(doc_id), 1, 3)
    learnt = references(docs.filter(~fold), text, lang, doc_id)
    return language(docs, learnt, doc_id, text).select(
        doc_id, F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
