"""The pipeline, stage by stage, against versions that work document by document."""

import collections
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from test_jaccard import brute
from tidewell.llm import quality, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "the of and in river house road people water light".split() for b in ("", "s", "er", "ing", "ly", "al", "ed")]
    rows = []

    def add(text):
        rows.append((len(rows), text, "en", f"s{len(rows) % 2}", len(text or "")))

    for i in range(90):
        body = ["The " + " ".join(rng.choice(words) for _ in range(25)) + "." for _ in range(4)]
        if i % 3 == 0:
            body.append("Share this page with the people of the road.")
        add("\n".join(body))
        if i % 9 == 0:
            add(rows[-1][1])
            near = rows[-1][1].split(" ")
            near[40] = "changed"
            add(" ".join(near))
        if i % 3 == 1:
            add(" ".join(rng.choice(words).upper() + "!!" for _ in range(90)))
        if i % 10 == 2:
            add(" ".join(rng.choice(words) + "%%%" for _ in range(90)))
    for text in (None, "", "short one"):
        add(text)
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], int("!!" not in (r[1] or "") and "%%%" not in (r[1] or "")), 0) for r in rows if r[1]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = P.quality_classifier(spark, docs, folder)
    model = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    own = quality.Compressors(model.bad, model.good)
    assert ids(good) == sorted(r.doc_id for r in docs.collect() if model.score(own, r.text) >= 0.3)
    bad = [r.doc_id for r in docs.collect() if r.text and ("!!" in r.text or "%%%" in r.text)]
    assert not set(bad) & set(ids(good))

    kept = P.quality_rules(spark, good, folder)
    assert ids(kept) == ids(rules.quality_rules(good).filter("kept")) and 80 < len(ids(kept)) < 130

    clean = P.line_dedup(spark, kept, folder)
    before, after = ({r.doc_id: r for r in x.collect()} for x in (kept, clean))
    assert before.keys() == after.keys()
    total = collections.Counter(r.source for r in before.values())
    held = collections.Counter((r.source, x) for r in before.values() for x in set(r.text.split("\n")))
    for i, r in before.items():
        want = "\n".join(x for x in r.text.split("\n") if not (held[r.source, x] >= 5 and held[r.source, x] > 0.05 * total[r.source]))
        assert after[i].text == want and after[i].n_chars == len(want)
    assert "Share this page" not in " ".join(r.text for r in after.values())

    single = P.ngram_jaccard_join(spark, clean, folder)
    rows = clean.collect()
    assert ids(single) == sorted(i for i, _, c in brute([r.text for r in rows], [r.doc_id for r in rows], 5, 4, 5) if i == c)
    assert len(ids(single)) < len(rows)
    assert all(x.columns == P.COLUMNS for x in (good, kept, clean, single))

    packed = P.best_fit_packing(spark, single, folder)
    assert set(ids(packed)) == set(ids(single))


def test_run_is_the_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(P.run(spark, folder).select(*columns).collect()) == sorted(docs.select(*columns).collect())


def test_empty_and_odd_documents(spark, folder):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a b", None, None, 3), (1, "a b", None, None, 3), (2, None, "en", "s", None),
                                 (None, "x y z", None, None, 5)], SCHEMA)
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            assert stage(spark, docs, folder).count() <= 5
    assert ids(P.ngram_jaccard_join(spark, odd.filter("doc_id is not null"), folder)) == [1, 2]


def test_join_with_repeated_and_null_ids(spark, folder):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(1, a), (1, b), (1, b), (2, b), (None, a), (None, c), (None, c), (None, None), (3, d + " z"), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], SCHEMA)
    got = P.ngram_jaccard_join(spark, docs, folder)
    assert got.columns == P.COLUMNS
    # Both texts of id 1 stay, the first of its repeated rows; texts without an id stay where none with an id is linked.
    assert sorted(r.n_chars for r in got.collect()) == [0, 1, 5, 6, 7, 8]


def test_everything_is_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
