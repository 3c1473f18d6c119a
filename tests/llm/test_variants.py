"""Operator 12 against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import variants

INPUT = "doc_id long, text string, word string, n long, r long, form int"
NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    """Whether exactly one inserted, deleted or replaced code point makes one the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def words_of(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def brute(rows):
    words = words_of(rows)
    form, out, pairs = {}, {}, {w: [] for w in words}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            pairs[w] += [x for x in by_size.get(size, []) if near(w, x)]
    for w, n in words.items():
        best = min(pairs[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n, len(pairs[w]), words.get(form[w]))
    return sorted(out.values())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in rows], INPUT)


def collected(df):
    assert df.columns == NAMES
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("symbols", [8, 2])
def test_against_all_pairs(spark, symbols):
    rng = random.Random(5)
    stems = ["".join(rng.choices("aeéstÿ×ABz", k=rng.randint(7, 9))) for _ in range(40)]

    def word():
        w = stems[min(39, int(rng.expovariate(0.3)))]
        if rng.random() < 0.2:
            at, how = rng.randrange(len(w)), rng.random()
            w = w[:at] + (rng.choice("aest÷") if how < 0.7 else "") + w[at + (how > 0.3):]
        return w

    rows = [(i if i % 17 else None, " ".join(word() for _ in range(60)) + "-_1 Ālettersx") for i in range(120)]
    rows += [(900, None), (901, ""), (902, "1 2 3"), *rows[:10]]
    want = brute(rows)
    assert any(r[1] for r in want) and collected(variants.spelling_variants(frame(spark, rows).repartition(5), symbols=symbols)) == want


def test_chains_ties_and_short_words(spark):
    """a word's form may have a form of its own; of two forms with as many occurrences the smaller one counts."""
    chain = [("abcdefg", 1500), ("abcdefgh", 120), ("abcdefghi", 11), ("abcdefghij", 1), ("zzzzzzz", 40), ("zzzzzzzb", 2), ("zzzzzza", 40), ("abcdef", 3000)]
    # One occurrence a document, so that the planted deletions come and go with the id.
    rows, doc = [], 0
    for w, n in chain:
        for _ in range(n):
            doc += 1
            rows.append((doc, f"{w} {w}."))
    want = brute(rows)
    found = collected(variants.spelling_variants(frame(spark, rows)))
    assert found == want
    roots = {r[0]: r[2] for r in found}
    assert roots["abcdefghi"] == "abcdefg" and "abcdef" not in roots


def test_long_words_and_empty_tables(spark):
    long = "ab" * 30_000
    rows = [(1, f"{long} {long}x {long} {long}x"), (2, f"{long}x {long[:-1]} {long[:-1]}"), (3, "y" * 300_000), (4, "y" * 300_000)]
    assert collected(variants.spelling_variants(frame(spark, rows))) == brute(rows)
    assert collected(variants.spelling_variants(frame(spark, []))) == []
    with pytest.raises(ValueError):
        variants.spelling_variants(frame(spark, []), times=2)


def test_neighbourhoods_are_whole_and_hold_nothing_twice():
    """Hashes of neighbours, against the neighbours written out and hashed as words."""
    for word in ("0", "00", "0123", "1101100", "22222"):
        written = {word}
        for i in range(len(word) + 1):
            written |= {word[:i] + c + word[i:] for c in "0123"}
        for i in range(len(word)):
            written |= {word[:i] + c + word[i + 1:] for c in "0123"} | {word[:i] + word[i + 1:]}
        want = set()
        for w in written:
            own = variants.codes([w]) if w else np.zeros((1, 0), np.uint64)
            want.add(int(variants.final_hash(variants.heads(own)[0][:, -1], len(w))[0]))
        found = [int(h) for row, hashes in variants.neighbourhood(variants.codes([word, word]), 4) for r, h in zip(row, hashes, strict=True) if r == 1]
        assert len(found) == len(set(found)) == len(written) and set(found) == want
