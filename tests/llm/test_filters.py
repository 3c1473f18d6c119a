"""Operators 3, 5, 6, 7 and 8 on small fixtures: against brute force, and on odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tidewell.llm import language, lines, quality, queries, rules, urls

ODD = [None, "", " ", "\n\n", "A.", "word " * 20000, "é" * 500, "😀 #1", "1234 5678", "tie", "tie"]


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id long, text string, score double, words string")


# --- quality -------------------------------------------------------------------
def prose(rng, n):
    return " ".join(rng.choice("the house was near a river and people of town walked along it every day".split()) for _ in range(n)) + "."


def junk(rng, n):
    return " ".join(rng.choice("casino###win $$$free&&& click*** %%%now".split()) + rng.choice("!!@@") for _ in range(n))


def test_quality_separates_held_out_rows(spark):
    rng = random.Random(2)
    texts = [(prose if i % 3 else junk)(rng, rng.randint(30, 300)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 9) for i in range(240)] + [(None, 1, 0), (3, 1, 0), (7, None, 0)], "doc_id long, quality int, text int")
    got = quality.quality(frame(spark, texts), labels).collect()
    assert len(got) == 240
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(bool(r.doc_id % 3)) for r in held) >= 0.95 * len(held)


def test_quality_does_not_see_held_out_labels(spark):
    rng = random.Random(3)
    docs = frame(spark, [(prose if i % 2 else junk)(rng, 80) for i in range(80)])
    held = {i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 0}

    def scores(flip):
        rows = [(i, (i % 2) ^ (flip and i in held)) for i in range(80)]
        return {r.doc_id: r.score for r in quality.quality(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()}

    assert scores(False) == scores(True)


def plain_scores(texts, labels):
    """Quality scores from all labelled rows outside of the held-out fold, with zstandard and a logistic regression written out."""
    order = sorted((labels[i], xxhash.xxh64_intdigest(str(i).encode(), 42), i) for i in labels if zlib.crc32(str(i).encode()) % 5)
    # The hash is signed in Spark, and taken modulo 2^40.
    order = [i for _, _, i in sorted((y, h % 2**40, i) for y, h, i in order)]

    def pieces(t):
        data = t.encode()
        return [data[k:k + 4096] for k in range(0, len(data), 4096)]

    def sizes(ids):
        found = []
        for c in (0, 1):
            held = zstandard.ZstdCompressionDict(zstandard.train_dictionary(65536, [p for i in ids if labels[i] == c for p in pieces(texts[i])], k=256, d=8).as_bytes())
            found.append(zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return lambda t: [sum(len(c.compress(p)) for p in pieces(t)) for c in found]

    def features(measure, t):
        (bad, good), n = measure(t), len(t.encode())
        return [1.0, min(max((bad - good) / (n + 64), -0.05), 0.1), max(0.0, 0.25 - min(bad, good) / (n + 16)), math.exp(-n / 64)]

    half = {i: int(hashlib.md5(texts[i].encode()).hexdigest(), 16) % 2 for i in order}
    rows = [(features(sizes([j for j in order if half[j] != k]), texts[i]), labels[i]) for k in (0, 1) for i in order if half[i] == k]
    x, y, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.inv(x.T @ np.diag(p * (1 - p)) @ x + 1e-3 * np.eye(4)) @ (x.T @ (p - y) + 1e-3 * w)
    measure = sizes(order)
    return [1 / (1 + math.exp(-min(30, max(-30, float(np.dot(w, features(measure, t))))))) for t in texts]


def test_quality_against_a_plain_version(spark):
    rng = random.Random(21)
    texts = [(prose if rng.random() < 0.5 + 0.3 * (i % 2) else junk)(rng, rng.randint(5, 900)) for i in range(160)]
    labels = {i: i % 2 for i in range(0, 160) if i % 7}
    known = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    # Copies of rows are read once; the order of rows does not matter.
    docs = frame(spark, texts).repartition(5)
    got = {r.doc_id: r.score for r in quality.quality(docs.union(docs.limit(20)), known).collect()}
    want = plain_scores(texts, labels)
    assert all(got[i] == pytest.approx(w, abs=1e-6) for i, w in enumerate(want)) and 0.1 < np.std(want)


def test_the_sample_of_quality_is_bounded_and_drawn_by_ids(spark):
    ids = spark.range(20_000).select(F.col("id").alias("i"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    drawn = quality._draw(ids, 100)
    hashes = {i: xxhash.xxh64_intdigest(str(i).encode(), 42) % 2**40 for i in range(20_000)}
    for y in (0, 1):
        own = sorted((i for i in hashes if (i % 5 == 0) == y), key=hashes.get)[:100]
        assert [(i, h) for i, c, h in drawn if c == y] == [(i, hashes[i]) for i in own]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(2, 0)], [(4, 1), (6, 0)]])
def test_quality_on_odd_input(spark, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.quality(frame(spark, ODD), known).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality(frame(spark, []), known).count() == 0


# --- language ------------------------------------------------------------------
def brute_phrases(text, reference):
    """Phrases: each goes on while it is found in the reference."""
    n = 0
    for at in range(0, len(text), language.PIECE):
        phrase = ""
        for c in text[at:at + language.PIECE]:
            if phrase and phrase + c in reference:
                phrase += c
            else:
                n, phrase = n + 1, c if c in reference else ""
    return n


def test_phrases_against_brute_force():
    rng = random.Random(4)
    refs = (("a", "".join(rng.choice("abc ") for _ in range(300))), ("b", "".join(rng.choice("abd é") for _ in range(200))))
    texts = ["", "a", "zzz", "é"] + ["".join(rng.choice("abcdé z") for _ in range(rng.randint(1, 1300))) for _ in range(25)]
    got = language.CrossParser(refs).phrases(texts)
    for k, (_, ref) in enumerate(refs):
        for i, t in enumerate(texts):
            assert got[k][i] == brute_phrases(t, ref)


def test_language_of_held_out_rows(spark):
    rng = random.Random(5)
    words = {"en": "the of and with house street water light other".split(), "de": "der die und mit haus straße wasser licht andere".split()}
    langs = [rng.choice(["en", "de"]) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(20)), g, 0.5) for i, g in enumerate(langs)] + [(900, None, "en", 0.0), (901, "12 !?", None, 0.0), (None, "der und", "de", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.held_out_language(docs).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert all(got[i].lang_pred == langs[i] for i in range(150)) and got[None].held_out is False
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(150))
    assert language.held_out_language(docs.limit(0)).count() == 0


def test_language_of_repeated_rows_and_texts_of_many_pieces(spark):
    en, de = "of and with house street water light other ", "der die und mit haus straße wasser licht andere "
    rows = [(i, (en, de)[i % 2] * 5, ("en", "de")[i % 2]) for i in range(60)] + [(900, de * 3000, None), (901, en * 3000, None), (902, "1 " * 5000 + de, None)]
    docs = spark.createDataFrame(rows + rows[:7] + rows[-3:], "doc_id long, text string, lang string")
    got = {}
    for r in language.held_out_language(docs).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, round(r.score, 6)))
    assert all(len(set(v)) == 1 for v in got.values()) and sum(map(len, got.values())) == len(rows) + 10
    assert got[900][0][0] == "de" and got[902][0][0] == "de" and all(got[i][0][0] == ("en", "de")[i % 2] for i in range(60))


def test_what_language_learns_is_spread_and_bounded(spark):
    """Pieces from the start, the middle and the end of each drawn document, and no more than are asked for."""
    rows = [(i, "anfang " * 300 + "mitte " * 300 + "ende " * 300, "de") for i in range(40)] + [(i, f"word{chr(97 + i % 26)} " * 3, "en") for i in range(40, 90)]
    learnt = dict(language.references(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), sample_docs=10, sample_pieces=3, piece_letters=50))
    assert all(w in learnt["de"] for w in ("anfang", "mitte", "ende")) and len(learnt["de"]) <= 3 * 51
    assert 0 < len(learnt["en"].split()) and len(learnt["en"]) <= 10 * 3 * 51
    assert language.references(spark.createDataFrame([], "doc_id long, text string, lang string")) == ()


# --- rules ---------------------------------------------------------------------
def brute_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    held = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    at = {i + d for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(held) - len(set(held)), len(at))


def test_rules_against_brute_force(spark):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(["a", "b", "the ", " ", "\n", "\t", "\x0b", "#", "| ", "é ", "\x1c", "of "]) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    got = rules.quality_rules(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        counts = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r.kept == (not r.base_failed and not r.failed)


def test_rules_keep_prose_and_reject_junk(spark):
    rng = random.Random(7)
    words = "the river runs past old houses and of many people who live there some walk by in summer evenings with dogs".split()
    good = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(5)]
    bad = [g.upper() for g in good] + [g.replace(" ", " | ") for g in good] + [" ".join(x + "***" for x in g.split()) for g in good]
    got = [r.kept for r in rules.quality_rules(frame(spark, good + bad)).orderBy("doc_id").collect()]
    assert got == [True] * 5 + [False] * 15


def test_rules_use_no_user_function(spark):
    plan = rules.quality_rules(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_rules_with_null_ids_and_an_empty_table(spark):
    good = "the river runs past old houses and of many people who live there " * 8
    rows = [(None, good, 1.0, "x"), (1, good, 1.0, "x"), (1, good, 1.0, "x"), (None, None, 1.0, "x")]
    schema = "doc_id long, text string, n_words double, kept string"
    got = sorted((str(r.doc_id), r.n_words, r.base_failed) for r in rules.quality_rules(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 104, True), ("1", 104, True), ("None", 0, True), ("None", 104, True)]
    assert rules.quality_rules(spark.createDataFrame([], schema)).count() == 0


# --- lines ---------------------------------------------------------------------
def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        host = rng.choice(["big.org"] * 6 + ["b.org", "c.org", None])
        body = [f"line {rng.randrange(10**6)} of its own" for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.5:
            body.insert(rng.randrange(len(body) + 1), rng.choice(["Home", " Home ", "Terms of use", ""]))
        rows.append((i, host, rng.choice([None, "\n".join(body)]) if rng.random() < 0.05 else "\n".join(body), "keep", 1))
    rows += [(1000, "one.org", "x\ny", "keep", 1), (1001, "big.org", "Home\nTerms of use", "keep", 1)]
    pages = spark.createDataFrame(rows, "page_id long, host string, text string, lines string, n_lines int")
    got = {r.page_id: r for r in lines.drop_boilerplate(pages).collect()}
    total = collections.Counter(h or "" for _, h, _, _, _ in rows)
    held = collections.Counter((h or "", x) for _, h, t, _, _ in rows for x in {x.strip(" ") for x in (t.split("\n") if t is not None else [])} if x)
    for i, h, t, _, _ in rows:
        own = t.split("\n") if t is not None else []
        clean = [x for x in own if not x.strip(" ") or not (held[h or "", x.strip(" ")] >= 5 and held[h or "", x.strip(" ")] > 0.05 * total[h or ""])]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped, got[i].lines) == (None if t is None else "\n".join(clean), len(own), len(own) - len(clean), "keep")
    # A page of nothing but boilerplate loses all of it.
    assert (got[1001].n_dropped, got[1001].text) == (2, "") and sum(r.n_dropped for r in got.values()) > 50
    assert lines.drop_boilerplate(pages.limit(0)).count() == 0


def test_copies_do_not_make_their_own_text_boilerplate(spark):
    rows = [(i, "h", "menu\nsame words") for i in range(50)] + [(i, "h", f"menu\npage {i}") for i in range(50, 90)] + [(90, "h", None), (91, None, "menu")]
    got = {r.page_id: r for r in lines.drop_boilerplate(spark.createDataFrame(rows, "page_id long, host string, text string"), once_per_text=True).collect()}
    assert all(got[i].text == "same words" for i in range(50)) and all(got[i].text == f"page {i}" for i in range(50, 90))
    assert got[90].text is None and got[91].text == "menu"


def test_page_lines(spark):
    html = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><!-- no --><p>One <b>two</b><br>three</p></body></html>"
    df = spark.createDataFrame([(1, "HTTP://WWW.Ex.org/a", html), (2, None, None), (3, "nothing", "<p " + "a=1 " * 50000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in lines.page_line_dedup(df).collect()}
    assert got[1].text == "T\nHome\nOne two\nthree" and got[1].host == "www.ex.org"
    assert (got[2].text, got[2].host, got[2].n_dropped) == ("", "", 0) and got[3].n_dropped == 0


# --- URLs ----------------------------------------------------------------------
def test_url_rules_and_parts(spark):
    cases = [
        ("http://a.COM/x?y", "a.com", "/x", "com/", "allow"), ("https://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("https://www.example.com/en/1#t", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://q.net/es/5", "q.net", "/es/5", "net/es/", "block"),
        ("http://a.com", "a.com", "", None, None), ("no url", "", "", None, None), (None, "", "", None, None), ("http://", "", "", None, None),
        ("http://h?://b.com/", "h", "", None, None), ("http://a.net/de/", "a.net", "/de/", None, None),
    ]
    df = spark.createDataFrame([(i, c[0], 1.0) for i, c in enumerate(cases)] + [(None, cases[0][0], 1.0)], "page_id long, url string, score double")
    got = {r.page_id: r for r in urls.url_filter(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert got[None].verdict == "allow"


def test_url_models_against_brute_force(spark):
    rng = random.Random(9)
    good = ["news.com/" + "".join(rng.choice("abcde") for _ in range(8)) for _ in range(30)]
    bad = ["x.net/es/" + "".join(rng.choice("wxyz") for _ in range(8)) for _ in range(30)]
    free = ["h.org/abcabd", "h.org/wxyzwx", "h.org/ÄÖ"]
    df = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(good + bad + free)], "page_id int, url string")
    got = {r.page_id: r for r in urls.url_filter(df).collect()}

    def spelled(u):
        return "^^" + re.sub(r"[^a-z0/.\-_?=&%:]", "~", re.sub("[0-9]", "0", u.lower())) + "$"

    def grams(us):
        return [x[i - 2:i + 1] for u in set(us) for x in [spelled(u)] for i in range(2, len(x))]

    counts = [collections.Counter(g[2 - k:] for g in grams(us) for k in range(3)) for us in (good, bad)]
    known = set(counts[0]) | set(counts[1])

    def p(c, g):
        if not g:
            return 1 / (len(urls.LETTERS) + len(urls.OTHERS))
        context = sum(n for h, n in c.items() if len(h) == len(g) and h[:-1] == g[:-1])
        return (c[g] + 4.0 * p(c, g[1:])) / (context + 4.0)

    def ratio(g):
        while g and g not in known:
            g = g[1:]
        return math.log(p(counts[0], g) / p(counts[1], g)) if g else 0.0

    for i, u in enumerate(good + bad + free):
        x = spelled(u)
        want = sum(ratio(x[j - 2:j + 1]) for j in range(2, len(x))) / (len(x) - 2)
        assert got[i].score == pytest.approx(want, abs=2e-6)
    assert got[60].verdict == "allow" and got[61].verdict == "block"


def test_registered_url_models_read_long_contexts_of_real_signs(spark, tmp_path):
    rng = random.Random(3)

    def some(signs):
        return "".join(rng.choice(signs) for _ in range(6))

    # Kinds that differ in letters that folding hides, in digits, and only in what stands four signs before.
    good = [f"q.com/{some('абвг')}/{some('123')}/p{rng.choice('xy')}qrsu" for _ in range(40)]
    bad = [f"q.net/es/{some('дежз')}/{some('789')}/v{rng.choice('xy')}qrst" for _ in range(40)]
    free = ["q.org/абвгаб", "q.org/дежзде", "q.org/123123", "q.org/789789"]
    rows = [(i, "http://" + u) for i, u in enumerate(good + bad + free)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op5(spark, str(tmp_path)).collect()}
    counts = [collections.Counter(x[j - k:j + 1] for u in set(us) for x in ["\x02" * 5 + u + "\x03"] for j in range(5, len(x)) for k in range(6)) for us in (good, bad)]
    contexts = [collections.Counter() for _ in counts]
    for c, own in zip(counts, contexts, strict=True):
        for g, n in c.items():
            own[g[:-1], len(g)] += n
    known = set(counts[0]) | set(counts[1])
    alphabet = len({g for g in known if len(g) == 1})

    def p(i, g):
        return (counts[i][g] + 4.0 * p(i, g[1:])) / (contexts[i][g[:-1], len(g)] + 4.0) if g else 1 / alphabet

    def ratio(g):
        while g and g not in known:
            g = g[1:]
        return math.log(p(0, g) / p(1, g)) if g else 0.0

    for i, u in enumerate(good + bad + free):
        x = "\x02" * 5 + u + "\x03"
        assert got[i].score == pytest.approx(sum(ratio(x[j - 5:j + 1]) for j in range(5, len(x))) / (len(x) - 5), abs=2e-6)
    assert [got[80 + i].verdict for i in range(4)] == ["allow", "block"] * 2


@pytest.mark.parametrize("rows", [[], [("http://a.org/x",)], [("http://a.com/",)], [("http://a.net/es/",), ("http://z.org/",)]])
def test_url_filter_with_few_rows(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string")
    got = urls.url_filter(df).orderBy("page_id").collect()
    assert len(got) == len(rows)
    assert all(r.verdict == ("block" if "net" in rows[0][0] else "allow") for r in got)


def test_url_filter_with_repeated_rows_and_very_long_urls(spark):
    long = "http://h.org/" + "ab" * 30_000
    rows = [(1, "http://a.com/x"), (1, "http://a.com/x"), (2, "http://b.net/es/x"), (3, long), (3, long), (4, long + "c"), (None, None), (None, None)]
    got = sorted((str(r.page_id), r.verdict, len(r.path)) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert len(got) == len(rows) and got[0] == got[1] == ("1", "allow", 2) and got[3] == got[4] and got[3][2] == 60_001 and got[-1][2] == 0


def test_url_filter_is_native(spark):
    plan = urls.url_filter(spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)


def test_nothing_that_grows_with_the_urls_is_broadcast(spark, monkeypatch):
    plans, write = [], urls.materialize

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(urls, "materialize", lambda df, label: write(planned(df), label))
    rows = [(i, f"http://{h}/{i}") for i, h in enumerate(["a.com", "b.net/es", "c.org"] * 20)]
    pages = write(spark.createDataFrame(rows, "page_id int, url string"), "pages")  # files, whose small size Spark goes by
    planned(urls.url_filter(pages, context=urls.LONG_CONTEXT, folded=False))
    assert len(plans) > 3 and sum("Join" in p for p in plans) > 3 and not [p for p in plans if "Broadcast" in p]


def test_long_urls_do_not_travel_with_each_sign(spark):
    long = "http://h.org/" + "ab" * 500
    x = spark.createDataFrame([(long,), (long + "c",), ("http://a.com/x",)], "u string").select(urls.spelled(F.col("u")).alias("x"))
    model = [spark.createDataFrame([], "g string, ratio double")] * 3
    found = urls.scored(x, model)
    sent = re.findall(r"Exchange hashpartitioning\(g#.*", found._jdf.queryExecution().executedPlan().toString())
    assert sent and found.count() == 3 and "sha2(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.x for r in found.collect()} == {r.x for r in x.collect()} and {r.score for r in found.collect()} == {0.0}


def test_copies_of_one_page_are_dealt_over_salts(spark):
    rows = [(i, "h", "menu\nsame words on every page of this site", {"k": 1}) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, host string, text string, extra map<string,int>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lines.drop_boilerplate(pages)
        plan = got._jdf.queryExecution().toString()
        assert re.search(r"xxhash64\(t#\d+, r#\d+\.page_id", plan)
        assert got.count() == 200 and {r.n_dropped for r in got.collect()} == {2}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
