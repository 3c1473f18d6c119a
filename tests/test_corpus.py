import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import graph as G
from tidewell.operators import ingest as I
from tidewell.operators import tables as TB
from tidewell.operators import trust as TR
from tidewell.sources import articles as AR
from tidewell.sources import characters as CH
from tidewell.sources import exports as EX
from tidewell.sources import pages as P
from tidewell.sources import reports as RP


def chunks(text, **kw):
    args = {"max_tokens": 400, "min_tokens": 50, "overlap_tokens": 50, **kw}
    return I.chunk_one(text, **args)


def test_chunk_basics():
    assert chunks("  \n ") == [] and chunks("short text") == ["short text"]
    two = "## One\n" + "alpha " * 60 + "\n## Two\n" + "beta " * 60
    got = chunks(two, overlap_tokens=0)
    assert len(got) == 2 and got[0].startswith("## One") and got[1].startswith("## Two")


def test_small_sections_merge_forward():
    got = chunks("intro\n## A\nx\n## B\n" + "word " * 100, overlap_tokens=0)
    assert got == ["intro\n\n## A\nx\n\n## B\n" + ("word " * 100).strip()]


def test_long_texts_stay_within_the_limit():
    rng = random.Random(2)
    words = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))) for _ in range(2000))
    assert all(len(c) // 4 <= 400 for c in chunks(words, overlap_tokens=0, min_tokens=0))
    assert " ".join(chunks(words, overlap_tokens=0, min_tokens=0)) == words
    assert [len(c) for c in chunks("x" * 4000, overlap_tokens=0)] == [1600, 1600, 800]
    paragraphs = "\n\n".join("Sentence number one. " * 30 for _ in range(5))
    assert len(chunks(paragraphs)) >= 2


def test_over_the_limit_small_sections_merge_back():
    text = "\n## ".join(["head"] + [f"S{i}\n" + "w " * 150 for i in range(8)])
    got = chunks(text, overlap_tokens=0)
    assert len(got) < 9 and all(len(c) // 4 <= 400 for c in got)


def test_overlap_starts_at_a_word():
    a, b = "alpha " * 250, "beta " * 250
    got = chunks(a.strip() + "\n\n" + b.strip())
    assert got[1].startswith("alpha ") and len(got[1].split("beta")[0]) <= 201


def test_chunk_texts_frame(spark):
    df = spark.createDataFrame([(1, "word " * 1000), (2, None), (3, "  "), (4, "one")], "doc_id int, text string")
    got = I.chunk_texts(df, ["doc_id"], "text").collect()
    by = {d: sorted(r.chunk_index for r in got if r.doc_id == d) for d in (1, 2, 3, 4)}
    assert by[1] == list(range(len(by[1]))) and len(by[1]) > 2 and not by[2] and not by[3] and by[4] == [0]
    assert all(r.char_count == len(r.content) and r.token_estimate == len(r.content) // 4 for r in got)


def test_chunk_text_in_sql(spark):
    from tidewell.functions import sql

    sql.register(spark)
    spark.createDataFrame([(1, "word " * 1000), (2, None)], "id int, text string").createOrReplaceTempView("chunk_docs")
    got = spark.sql("select id, c.chunk_index, c.content from chunk_docs, lateral chunk_text(text) c order by id, chunk_index").collect()
    assert [r.content for r in got] == chunks("word " * 1000) and {r.id for r in got} == {1}


SOURCES = ("url string, title string, source_type string, content_hash string, content_hash_previous string, change_count int, is_stale boolean, "
           "trust_score double, check_interval_hours int, fetched_at timestamp, last_checked timestamp")


def test_ingest_twice_then_changed(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    src = spark.createDataFrame([], SOURCES)
    page = lambda text: spark.createDataFrame([("https://wowhead.com/a", "T", "guide", text)], "url string, title string, source_type string, text string")
    seen = []
    for text in ("one", "one", "two", "   "):
        dec = I.ingest_decision(page(text), src)
        seen.append(dec.first().action)
        src = spark.createDataFrame(I.apply_ingest(dec, src, now).select(*I.SOURCE_COLUMNS).collect(), src.select(*I.SOURCE_COLUMNS).schema)
    row = src.first()
    assert seen == ["new", "unchanged", "replace", "refused"]
    assert row.change_count == 1 and row.trust_score == 0.75 and row.check_interval_hours == 720 and row.content_hash_previous != row.content_hash


def test_freshness(spark):
    rows = [("u1", None, 404, None, "x"), ("u2", "h", 200, "2023-12-01", "x"), ("u3", "h", 200, None, " "), ("u4", None, 200, None, "same"), ("u5", "h", 200, "2024-02-01", "new")]
    base = spark.createDataFrame(rows, "url string, h string, head_status int, lm string, text string")
    src = base.select("url", F.lit("t").alias("title"), F.lit("web").alias("source_type"), F.coalesce("h", F.sha2(F.lit("same"), 256)).alias("content_hash"),
                      F.lit(None).cast("string").alias("content_hash_previous"), F.lit(0).alias("change_count"), F.lit(False).alias("is_stale"),
                      F.lit(.5).alias("trust_score"), F.lit(1).alias("check_interval_hours"), F.lit(None).cast("timestamp").alias("fetched_at"),
                      F.lit("2024-01-01").cast("timestamp").alias("last_checked"))
    seen = base.select("url", "head_status", F.col("lm").cast("timestamp").alias("last_modified"), "text")
    out = TR.freshness_outcome(src, seen)
    assert {r.url: r.outcome for r in out.collect()} == {"u1": "dead", "u2": "fresh", "u3": "empty", "u4": "unchanged", "u5": "changed"}
    now = F.lit("2024-03-01").cast("timestamp")
    after = {r.url: (r.is_stale, r.change_count) for r in TR.apply_freshness(out, src.columns, now).collect()}
    assert after["u5"] == (True, 1) and after["u1"] == (False, 0)
    assert TR.dead_url_events(out, now).first().delta == -0.6
    assert TR.dead_url_events(out, now, src.where("url = 'u1'")).count() == 0
    assert tuple(TR.freshness_summary(out).first()) == (5, 1, 2)


def test_source_list(spark, tmp_path):
    entries = [{"url": "https://a.b", "title": "A", "priority": 1, "category": "guide"}, {"url": "ftp://a.b", "title": "B"},
               {"url": "https://c.d", "title": "C", "priority": 9}, {"url": "https://e.f", "title": "E", "enabled": False, "spec": "combat"}]
    (tmp_path / "list.json").write_text(json.dumps(entries))
    (tmp_path / "obj.json").write_text(json.dumps({"sources": entries[:1]}))
    got = P.check_entries(P.read_source_list(spark, str(tmp_path)))
    assert got.count() == 5 and {r.title: r.reject_reason for r in got.collect()} == {"A": None, "B": "bad url", "C": "bad priority", "E": None}
    good = got.where("reject_reason is null")
    assert TB.filter_sources(good).count() == 2 and TB.filter_sources(good, enabled_only=False, spec="combat").count() == 1
    assert TB.filter_sources(good, max_priority=1, category="guide").count() == 2


def test_main_text(values):
    html = """<html><head><title>T</title></head><body><nav>skip</nav><!-- no --><article class="a > b"><h1>Big  title</h1>
    <p>One &amp; two&#8217;s &lt;x&gt; &#x41;</p><script>var a = "<p>";</script><h2>Sub</h2><ul><li>a</li><li>b</li></ul>line<br/>next</article><footer>f</footer></body></html>"""
    got = values(P.main_text, [html, "<p></p>"])
    assert got[1] == ""
    assert got[0].splitlines()[0].endswith("# Big title") and "One & two’s <x> A" in got[0] and "## Sub\n" in got[0]
    assert "skip" not in got[0] and "var a" not in got[0] and got[0].endswith("a\nb\n\nline\nnext")


def test_page_title(spark):
    df = spark.createDataFrame([("given", "<title>x</title>", "https://h/"), (None, "<title> A &amp; B </title>", "https://h/"), ("", "none", "https://Host:8/x")],
                               "g string, html string, url string")
    assert [r.t for r in df.select(P.page_title(F.col("g"), "html", "url").alias("t")).collect()] == ["given", "A & B", "Host:8"]


def test_page_acceptance(spark):
    rows = [(200, None, "text/html", "x"), (404, None, "text/html", "x"), (200, 99, "text/html", "x"), (200, None, "image/png", "x"), (200, None, "application/xhtml+xml", "x" * 50), (200, None, None, "x")]
    df = spark.createDataFrame(rows, "status int, content_length long, content_type string, html string")
    assert [r.reject_reason for r in P.check_pages(df, 20).collect()] == [None, "bad status", "declared too large", "not html", "too large", "not html"]


def test_articles(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Guide\nspec: combat\nconfidence: 0.8\nsources:\n- url: https://a.b\n  trust: 0.5\nclaims:\n- text: X hits\n  verified: true\n  evidence: [e1]\n"
                                   "tags: [combat, guide]\ncreated_at: 2024-01-02\n---\n\n# Body\n\ntext --- more\n")
    (tmp_path / "b.md").write_text("---\ntitle: [broken\n---\nx")
    (tmp_path / "c.md").write_text("no front matter")
    got = {r.path.rsplit("/", 1)[1]: r for r in AR.read_articles(spark, str(tmp_path)).collect()}
    a = got["a.md"]
    assert a.title == "Guide" and a.status == "draft" and a.claims[0].evidence == ["e1"] and a.tags == ["combat", "guide"] and a.body.startswith("# Body") and a.error is None
    assert got["b.md"].error == "invalid front matter" and got["c.md"].body == "no front matter"


def test_character_exports(spark):
    kv = 'rogue="X"\nrace=night_elf\nspec=combat\ntalents="20/41/0"\nhead=,id=100,enchant_id=5\nfinger1=,id=7\nshirt=,id=9'
    listed = json.dumps({"race": "Blood Elf", "spec": "Mutilate", "talents": "41/20/0", "items": [{"slot": "Ring 1", "id": 3}, {"slot": "Tabard", "id": 1}]})
    num = json.dumps({"player": {"race": 4, "talentsString": "005-052-1", "equipment": {"items": [{"id": 5, "enchant": 2, "gems": [1]}, None, {"id": 0}, {"id": 8}]}}})
    rows = [(1, kv), (2, listed), (3, num), (4, "bm90IGpzb24="), (5, kv.replace("night_elf", "murloc")), (6, "race=orc\nspec=combat"), (7, '{"race": "Orc"}'), (8, "")]
    got = {r.id: r for r in CH.parse_exports(spark.createDataFrame(rows, "id int, raw string"), "id", "raw").collect()}
    assert (got[1].race, got[1].spec, got[1].talents, [(g.slot, g.item_id) for g in got[1].gear]) == ("night_elf", "combat_swords", "20/41/0", [("head", 100), ("ring_1", 7)])
    assert (got[2].race, got[2].spec, [(g.slot, g.item_id) for g in got[2].gear]) == ("blood_elf", "assassination_mutilate", [("ring_1", 3)])
    assert (got[3].race, got[3].spec, got[3].talents) == ("night_elf", "combat_swords", "5/7/1")
    assert [(g.slot, g.item_id, g.enchant, g.gems) for g in got[3].gear] == [("head", 5, 2, [1]), ("back", 8, None, None)]
    assert [got[i].reject_reason for i in (4, 5, 6, 7, 8)] == ["invalid json", "unknown race", "missing talents", "unknown spec", "invalid json"]


def test_function_calling_export(spark, tmp_path):
    obs = [("span", "a", "{}", ""), ("tool", "search", '{"q":1}', "found"), ("tool", None, None, None)]
    df = spark.createDataFrame([(1, "q", "a", obs), (2, "", "a", []), (3, "q", None, None), (4, "q", "a", None)],
                               "trace_id int, input string, output string, observations array<struct<type:string,name:string,input:string,output:string>>")
    lines = EX.to_function_calling(df, "sys")
    EX.write_jsonl(lines, str(tmp_path / "out"))
    got = {r.trace_id: json.loads(r.value)["messages"] for r in lines.collect()}
    assert set(got) == {1, 4} and [m["role"] for m in got[4]] == ["system", "user", "assistant"]
    m = got[1]
    assert [x["role"] for x in m] == ["system", "user", "assistant", "tool", "assistant", "tool", "assistant"]
    assert m[2]["tool_calls"][0]["id"] == "call_1" and m[3]["content"] == "found" and m[4]["tool_calls"][0]["function"] == {"name": "unknown", "arguments": "{}"}
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "q1", "question": "?", "complexity": "trivial", "key_facts": ["a"]}, {"id": "q2", "question": "!"}]))
    got = {r.id: r for r in EX.read_questions(spark, str(tmp_path)).collect()}
    assert got["q1"].key_facts == ["a"] and got["q2"].expected_tools == [] and got["q2"].ground_truth == ""


def test_graph_merge_and_lookup(spark):
    rows = [(1, "SnD", "spell", .5, None, 1), (2, "Slice and Dice", "spell", .9, '{"a":1}', None), (3, "the Slice and Dice", "buff", .4, None, 3), (4, "snd", "spell", .2, None, 4)]
    ent = G.merge_entities(spark.createDataFrame(rows, "seq int, name string, entity_type string, confidence double, properties string, source_chunk int"))
    got = {r.entity_type: r for r in ent.collect()}
    assert (got["spell"].name, got["spell"].confidence, got["spell"].properties, got["spell"].source_chunk) == ("SnD", .9, '{"a":1}', 4)
    asked = spark.createDataFrame([(1, "SND", None), (2, "snd", "buff"), (3, "nothing", None)], "query_id int, name string, entity_type string")
    found = G.find_entities(asked, ent)
    assert sorted(r.query_id for r in found.collect()) == [1, 1, 2] and G.first_entity(found).count() == 2


def test_search_card(spark):
    ent = spark.createDataFrame([(i, f"n{i}", f"n{i}", "item" if i else "boss", i) for i in range(30)] + [(99, "n1", "n1", "spell", 9)],
                                "entity_id int, name string, canonical_name string, entity_type string, source_chunk int")
    edges = spark.createDataFrame([(0, i, "drops_from", i / 100, i + 100) for i in range(1, 30)] + [(5, 0, "requires", .5, None)],
                                  "source_id int, target_id int, relation_type string, confidence double, source_chunk int")
    asked = spark.createDataFrame([(1, "The N0", None), (2, "n1", None)], "query_id int, name string, entity_type string")
    best, ambiguous, chunk_rows = G.search_cards(asked, edges, ent)
    out = best.collect()
    assert len([r for r in out if r.direction == "outgoing"]) == 20 and len([r for r in out if r.direction == "incoming"]) == 1
    assert max(r.confidence for r in out if r.direction == "outgoing") == .29 and {r.entity_id for r in ambiguous.collect()} == {1, 99}
    assert G.chunk_list(chunk_rows).first().chunk_ids == [0] + list(range(110, 130))
    with pytest.raises(ValueError):
        G.neighbours(asked, edges, ent, "sideways")
    assert TB.filter_relations(edges, ["requires", "bogus"], ["requires"]).count() == 1 and TB.filter_relations(edges, ["bogus"], ["requires"]).count() == 30


def test_endpoints_see_earlier_chunks_only(spark):
    ent = spark.createDataFrame([("d", 0, "a", 1, 0), ("d", 5, "a", 2, 1), ("d", 3, "b", 3, 2), ("e", 0, "b", 4, 3)], "doc string, chunk_seq int, name string, entity_id int, seq int")
    edges = spark.createDataFrame([("d", 1, 0, "a", "b"), ("d", 2, 3, "a", "b"), ("d", 3, 9, "b", "a"), ("d", 4, 5, "a", "a"), ("e", 5, 1, "b", "x")],
                                  "doc string, edge_id int, chunk_seq int, source_name string, target_name string")
    for block in (1, 2, 100):
        got = {(r.edge_id): (r.source_id, r.target_id) for r in G.resolve_endpoints(edges, ent, block).collect()}
        assert got == {2: (1, 3), 3: (3, 2), 4: (2, 2)}


def test_gazetteer_and_failures(spark):
    docs = spark.createDataFrame([(1, "The Dragonspine Trophy, of slice and dice!"), (2, "")], "doc_id int, text string")
    gaz = spark.createDataFrame([("dragonspine trophy", "item"), ("slice and dice", "spell"), ("dice of", "none")], "canonical_name string, entity_type string")
    assert {r.canonical_name for r in G.gazetteer_mentions(docs, gaz, id_col="doc_id", text_col="text").collect()} == {"dragonspine trophy", "slice and dice"}
    got = G.extract_with(docs, lambda t: [{"name": t[4], "entity_type": "item"}], id_col="doc_id", text_col="text").collect()
    assert {r.id: r.ok for r in got} == {1: True, 2: False}


def test_long_names_wide_vectors_forms_and_repeated_slots(spark):
    from tidewell.operators import retrieval as R
    from tidewell.sources import pages as P

    gaz = spark.createDataFrame([("the staff of the burning blade", "item"), ("staff", "word")], "canonical_name string, entity_type string")
    docs = spark.createDataFrame([(1, "He took The Staff of the Burning Blade.")], "doc_id int, text string")
    found = G.gazetteer_mentions(docs, gaz, id_col="doc_id", text_col="text").collect()
    assert {r.canonical_name for r in found} == {"the staff of the burning blade", "staff"}
    many = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3000)))], "doc_id int, text string")
    vector = R.feature_hash_embedding(many, "doc_id", "text", 768).first().embedding
    assert len(vector) == 768 and any(vector[256:512]) and any(vector[512:])
    page = spark.createDataFrame([("<html><body><form><p>All of the page stands here.</p></form></body></html>",)], "html string")
    assert page.select(P.main_text("html").alias("t")).first().t == "All of the page stands here."
    raw = '{"race": "orc", "spec": "combat", "talents": "x", "items": [{"slot": "head", "id": 1}, {"slot": "neck", "id": 3}, {"slot": "head", "id": 2}]}'
    row = CH.parse_exports(spark.createDataFrame([(1, raw)], "id int, raw string"), "id", "raw").first()
    gear = row.gear if row.gear is not None else []
    slots = [g.slot for g in gear]
    assert len(slots) == len(set(slots)) and row.reject_reason in (None, "unknown race", "unknown spec")


def test_page_with_huge_tags_and_open_quotes(values):
    many = "<article><p " + "a=1 " * 100_000 + ">kept</p>" + "x < y " + "b=2 " * 20_000 + "</article>"
    pages = [many, "<p>a</p><b " + 'c="1" ' * 50_000 + ">b</b>", '<p title="open>one</p><p>two</p>', "<p>tail</p><div " + "a=1 " * 10_000]
    got = values(P.main_text, pages)
    assert got[0].startswith("kept") and "x < y b=2" in got[0]
    assert got[1] == "a\n\nb"
    assert got[2] == "one\n\ntwo"
    assert got[3].startswith("tail")


def test_unreadable_source_lists_become_rejects(spark):
    texts = ['[{"url": "https://a.b", "title": "A"', "", '{"sources": 5}', "[]",
             '[{"url": "https://c.d", "title": "C", "priority": "abc"}, {"url": "https://e.f", "title": "E", "priority": 2.5},'
             ' {"url": "https://g.h", "title": "G", "priority": 3}]']
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    got = sorted((r.title or "", r.reject_reason or "", r.priority) for r in P.check_entries(P.source_entries(raw, "value")).collect())
    assert got == [("", "unreadable", 2)] * 3 + [("C", "bad priority", 2), ("E", "bad priority", 2), ("G", "", 3)]


def test_unreadable_questions_and_reports_are_told(spark, tmp_path):
    raw = spark.createDataFrame([('[{"id": "q1", "question": "a"}]',), ('[{"id": ',), ("[]",)], "value string")
    assert sorted((r.id or "", r.unread) for r in EX.parse_questions(raw, "value").collect()) == [("", '[{"id": '), ("q1", None)]
    lines = ['{"code": "r1", "title": "T"}', '{"code": "r2", ', '{"title": "no code"}']
    (tmp_path / "reports.json").write_text("\n".join(lines))
    from_text = RP.parse_reports(spark.createDataFrame([(x,) for x in lines], "value string"), "value")
    for reports in (RP.read_reports(spark, str(tmp_path)), from_text):
        assert [r.report_code for r in RP.report_rows(reports).collect()] == ["r1"]
        got = {(r.unread, r.reject_reason) for r in RP.report_rejects(reports).collect()}
        assert got == {(lines[1], "unreadable"), (None, "no code")}


def test_freshness_of_failed_fetches_and_unseen_sources(spark):
    src = spark.createDataFrame([(u, "h", None, 0, False, "2024-01-01") for u in ("u1", "u2", "u3")],
                                "url string, content_hash string, content_hash_previous string, change_count int, is_stale boolean, last_checked string")
    src = src.withColumn("last_checked", F.col("last_checked").cast("timestamp"))
    seen = spark.createDataFrame([("u1", None, None, None, "timed out"), ("u2", 200, None, "new", None)],
                                 "url string, head_status int, last_modified timestamp, text string, fetch_error string")
    out = TR.freshness_outcome(src, seen)
    assert {r.url: (r.outcome, r.error) for r in out.collect()} == {
        "u1": ("error", "timed out"), "u2": ("changed", None), "u3": ("unobserved", None)}
    after = {r.url: r.last_checked.month for r in TR.apply_freshness(out, src.columns, F.lit("2024-03-01").cast("timestamp")).collect()}
    assert after == {"u1": 1, "u2": 3, "u3": 1}
    assert tuple(TR.freshness_summary(out).first()) == (2, 1, 1)


def test_a_report_read_twice_changes_nothing(spark, tmp_path):
    import os

    from tidewell.plans.segments import Segments
    from tidewell.sources import reports as RP

    store = Segments(spark, str(tmp_path / "r"))
    fights = spark.createDataFrame([("A", 1, "x", 10), ("A", 2, "y", 20), ("A", 2, "y", 15), ("B", 1, None, None)], "report_code string, fight_id long, name string, duration_ms long")
    damage = spark.createDataFrame([("A", 1, "p", 5), ("A", 1, None, 7)], "report_code string, fight_id long, player_name string, total_damage long")
    assert RP.store_tables(store, {"fights": fights, "damage": damage}, 1) and not RP.store_tables(store, {"fights": fights.limit(0), "damage": damage}, 1)
    state = lambda n: sorted(map(tuple, RP.stored_table(store, n).collect()), key=str)
    first = {n: state(n) for n in ("fights", "damage")}
    assert first["fights"] == [("A", 1, "x", 10), ("A", 2, "y", 20), ("B", 1, None, None)] and len(first["damage"]) == 2
    files = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in fs}
    RP.store_tables(store, {"fights": fights, "damage": damage}, 2)
    assert {n: state(n) for n in first} == first and store.read("fights").where("segment = 2").count() == store.read("damage").where("segment = 2").count() == 0
    RP.store_tables(store, {"fights": spark.createDataFrame([("A", 1, "x", 11), ("C", 1, "z", 1)], fights.schema), "damage": damage.limit(0)}, 3)
    assert state("fights") == [("A", 1, "x", 11), ("A", 2, "y", 20), ("B", 1, None, None), ("C", 1, "z", 1)] and state("damage") == first["damage"]
    assert all(os.stat(f).st_mtime_ns == at for f, at in files.items())
