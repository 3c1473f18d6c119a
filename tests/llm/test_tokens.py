"""Operators 1, 2 and 10 against the tokenizer libraries and brute force."""

import base64
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tidewell.llm import bpe, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n  \t", "Hello world, it's 2024!", "naïve café – déjà vu", "日本語のテキスト 한국어", "a\x1cb\x1d c\x85d e f　g",
    "😀😀 👩‍👩‍👧", "x" * 3000, "ab" * 5000, "word " * 5000, " ́a é", "<|endoftext|> <|startoftext|>x", "İstanbul ẞ ΑΣ", "don't WE'LL i'm",
    "1234567890" * 30, "!!!???" * 40, "\r\n\r\n a\r", "\x00\x01 \x7f", "tie tie tie",
]


def frame(spark, texts, extra=True):
    rows = [(i, t) + (("z", 1.5) if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + (", ids string, length double" if extra else ""))


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("share", [1 / 200_000, 2.0])
def test_bpe_is_what_tiktoken_gives(spark, reference, share):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcdeé ß1,\n \x1f") for _ in range(rng.randrange(60))) for _ in range(60)]
    got = {r.doc_id: r.ids for r in bpe.encode(frame(spark, texts), RANKS, public_tokenizers.PATTERN, share=share).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_bpe_round_trip_and_digests(spark, reference):
    ids = bpe.encode(frame(spark, ODD), RANKS, public_tokenizers.PATTERN)
    assert [bytes(r.decoded) for r in bpe.decode(ids, RANKS).orderBy("doc_id").collect()] == [(t or "").encode() for t in ODD]
    size = len(bpe.read_ranks(RANKS))
    for r in ids.select("ids", bpe.little_endian(ids["ids"], size).alias("b")).collect():
        assert bytes(r.b) == struct.pack(f"<{len(r.ids)}I", *r.ids)


def test_heap_merges_equal_fold(spark):
    ranks = bpe.read_ranks(RANKS)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("etaoin shrdluéü") for _ in range(rng.randrange(1, 24))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.ids for r in bpe.encoded_words(df, ranks).collect()}
    assert got == {w: bpe.merge_bytes(w.encode(), ranks) for w in words}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.best_fit_packing(empty, WORDS).count() == 0
    assert token_counts.token_counts(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def slow_count(word, scores):
    data = word.encode()
    best = [(0.0, 0)]
    for i in range(1, len(data) + 1):
        best.append(max((best[j][0] + scores[data[j:i]], best[j][1] - 1) for j in range(i) if data[j:i] in scores))
    return -best[-1][1]


@pytest.mark.parametrize("max_nodes", [10, 500_000])
def test_token_counts_against_brute_force(spark, max_nodes):
    texts = [t for t in ODD if t is None or len(t) < 400] + ["the same words again and again"] * 3
    scores = token_counts.zipf_scores(token_counts.read_ranks(RANKS))
    assert math.isclose(sum(map(math.exp, scores.values())), 1.0)
    got = token_counts.token_counts(frame(spark, texts), RANKS, public_tokenizers.PATTERN, max_nodes=max_nodes).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        words = regex.findall(public_tokenizers.PATTERN, t or "")
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(slow_count(w, scores) for w in words))


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_pretokens) for r in token_counts.token_counts(df, RANKS, public_tokenizers.PATTERN).collect()) == [
        (0, 0), (0, 2), (1, 2), (1, 2)]
    assert sorted((r.doc_id or 0, len(r.ids)) for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()) == [(0, 0), (0, 2), (1, 2), (1, 2)]
    assert packing.best_fit_packing(df, WORDS).count() == 4


def one_by_one(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - length)
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_plan_equals_best_fit_decreasing_one_by_one():
    rng = random.Random(1)
    for capacity in (1, 2, 7, 10, 64, 100):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(120))]
            if rng.random() < 0.3:
                lengths += [rng.randint(1, capacity)] * 50
            counts = {}
            for n in lengths:
                counts[n] = counts.get(n, 0) + 1
            fill, seen = {}, {}
            for length, rank, n, first, offset, per in packing.plan(counts, capacity).tolist():
                assert rank == seen.get(length, 0)
                seen[length] = rank + n
                for i in range(n):
                    place = offset + i % per * length
                    assert fill.get(first + i // per, 0) == place
                    fill[first + i // per] = place + length
            assert seen == counts and sorted(capacity - v for v in fill.values()) == one_by_one(lengths, capacity)


def test_packing_is_whole_and_gapless(spark):
    texts = ODD + ["a<|endoftext|>B <|ENDOFTEXT|> É<|startoftext|>", "<|endoftext|>" * 9] + ["one two three " * n for n in (1, 1, 1, 50, 400, 400, 683, 700, 3000)]
    tok = Tokenizer.from_file(WORDS)
    rows = packing.best_fit_packing(frame(spark, texts), WORDS).collect()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            part = ids[r.start:r.start + r.length]
            assert r.start == 2048 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = [r.length for r in rows]
    assert sorted(2048 - sum(n for _, n in s) for s in bins.values()) == one_by_one(lengths, 2048)


def test_vocabulary_must_hold_all_bytes():
    with pytest.raises(ValueError, match="single bytes"):
        token_counts.CountTrie({b"a": 0.0})
    assert hashlib.sha256(open(RANKS, "rb").read()).hexdigest()
