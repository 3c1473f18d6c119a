import pytest
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.operators import extraction as X
from tidewell.operators import graph as G
from tidewell.operators import retrieval as R


def frame(spark, *texts):
    return spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "chunk_id string, seq long, content string")


def sayer(calm=False):
    """Reads ``name:type`` words as entities and ``a>b`` words as relationships between them."""
    def said(text):
        if "boom" in text and not calm:
            raise RuntimeError("boom")
        words = text.split()
        ents = [dict(zip(("name", "entity_type"), w.split(":"), strict=True), properties={"w": i} if i else None) for i, w in enumerate(words) if ":" in w]
        rels = [{"source": a, "target": b, "relation_type": "requires", "properties": {"text": text[:3]}} for a, b in (w.split(">") for w in words if ">" in w)]
        return {"entities": ents, "relationships": rels}

    return said


def test_a_run_writes_entities_edges_and_a_ledger(spark, tmp_path):
    store = X.ExtractionStore(spark, str(tmp_path))
    chunks = frame(spark, "The_Sword:item dst:item The_Sword>dst", "boom", "mace:item mace>The_Sword nobody>mace", "axe:nonsense", "")
    assert X.run_extraction(store, chunks, 1, sayer())
    ledger = {r.chunk_id: (r.ok, r.error) for r in store.ledger().collect()}
    assert ledger == {"c0": (True, None), "c1": (False, "boom"), "c2": (True, None), "c3": (False, "unknown type nonsense"), "c4": (True, None)}
    ents = {r.canonical_name: (r.name, r.confidence, r.source_chunk, r.properties) for r in store.entities().collect()}
    assert ents == {"the_sword": ("The_Sword", 0.5, "c0", None), "dragonspine trophy": ("dst", 0.5, "c0", '{"w": 1}'), "mace": ("mace", 0.5, "c2", None)}
    names = {r.entity_id: r.canonical_name for r in store.entities().collect()}
    edges = {(names[r.source_id], names[r.target_id]): (r.relation_type, r.source_chunk, r.properties) for r in store.edges().collect()}
    # An end that an earlier chunk named is found; one that nobody named is not.
    assert edges == {("the_sword", "dragonspine trophy"): ("requires", "c0", '{"text": "The"}'), ("mace", "the_sword"): ("requires", "c2", '{"text": "mac"}')}


def test_failed_chunks_are_asked_again_alone(spark, tmp_path):
    store = X.ExtractionStore(spark, str(tmp_path))
    chunks = frame(spark, "a:item", "boom b:item", "c:item")
    X.run_extraction(store, chunks, 1, sayer())
    assert X.run_extraction(store, chunks, 2, sayer(calm=True))
    asked = {(r.segment, r.chunk_id) for r in store.found().collect()}
    assert asked == {(1, "c0"), (1, "c1"), (1, "c2"), (2, "c1")}
    before = sorted(map(tuple, store.entities().collect()))
    assert {r[0] for r in before} == {"a", "b", "c"} and all(r.ok for r in store.ledger().collect())
    # A repeated run asks nothing, and a run with a number that was used is not done.
    assert X.run_extraction(store, chunks, 3, sayer()) and not X.run_extraction(store, frame(spark, "z:item"), 3, sayer())
    assert sorted(map(tuple, store.entities().collect())) == before and store.found().where("segment = 3").count() == 0


def test_names_with_apostrophes_and_dashes_are_found(spark):
    gaz = spark.createDataFrame([("gruul's lair", "instance"), ("zul'aman", "instance"), ("lair", "mechanic"), ("kil'jaeden-mace", "item"), ("--", "item")],
                                "canonical_name string, entity_type string")
    docs = spark.createDataFrame([(1, "In Gruul’s Lair, then ZUL'AMAN."), (2, "a kil'jaeden mace"), (3, "Gruuls Lair"), (4, None)], "doc_id int, text string")
    got = {(r.doc_id, r.canonical_name) for r in G.gazetteer_mentions(docs, gaz, id_col="doc_id", text_col="text").collect()}
    assert got == {(1, "gruul's lair"), (1, "lair"), (1, "zul'aman"), (2, "kil'jaeden-mace"), (3, "lair")}
    targets = [v for v in fixed.ALIASES.values() if "'" in v]
    named = spark.createDataFrame([(v, "instance") for v in fixed.ALIASES.values()], gaz.schema).distinct()
    docs = spark.createDataFrame([(i, f"We went to {v.title()}!") for i, v in enumerate(fixed.ALIASES.values())], docs.schema)
    got = {(r.doc_id, r.canonical_name) for r in G.gazetteer_mentions(docs, named, id_col="doc_id", text_col="text").collect()}
    assert targets and {(i, v) for i, v in enumerate(fixed.ALIASES.values())} <= got


def test_of_overlapping_names_the_first_and_longest_counts(spark):
    gaz = spark.createDataFrame([(n, "item") for n in ("a b", "b c d", "a b c", "d", "d e", "c")] + [("d", "stat")], "canonical_name string, entity_type string")
    docs = spark.createDataFrame([(1, "x A b, c d e"), (2, "b c d e"), (3, "a b a b c"), (4, "nothing"), (5, None), (6, "d D")], "doc_id int, text string")
    got = sorted((r.doc_id, r.position, r.canonical_name, r.entity_type) for r in G.longest_mentions(docs, gaz, id_col="doc_id", text_col="text").collect())
    assert got == [(1, 1, "a b c", "item"), (1, 4, "d e", "item"), (2, 0, "b c d", "item"), (3, 0, "a b", "item"), (3, 2, "a b c", "item"),
                   (6, 0, "d", "item"), (6, 0, "d", "stat"), (6, 1, "d", "item"), (6, 1, "d", "stat")]


def test_edges_may_have_string_ids(spark):
    ents = spark.createDataFrame([("d", 1, "a", 11, 1), ("d", 1, "b", 12, 2), ("d", 3, "a", 13, 3)], "doc string, chunk_seq int, name string, entity_id long, seq long")
    edges = spark.createDataFrame([("d", "x#1", 2, "a", "b"), ("d", "x#2", 3, "b", "a"), ("d", "y", 0, "a", "b")], "doc string, edge_id string, chunk_seq int, source_name string, target_name string")
    got = {r.edge_id: (r.source_id, r.target_id) for r in G.resolve_endpoints(edges, ents).collect()}
    assert got == {"x#1": (11, 12), "x#2": (12, 13)}


@pytest.mark.parametrize("batch", [2, 100])
def test_rerank_by_a_function_keeps_the_order_of_queries_that_fail(spark, batch):
    rows = [(q, f"{kind}", d, d, f"{d}") for q, kind in enumerate(("ok", "fail", "short", "null", "nan", "text")) for d in range(6)] + [(9, "fail", 1, 0, "x")]
    df = spark.createDataFrame(rows, "query_id int, query string, doc_id int, prior int, content string")
    calls = []

    def score(queries, contents):
        kind, calls_ok = queries[0], len(set(queries)) == 1 and len(queries) <= batch
        assert calls_ok
        if kind == "fail" and "5" in contents:
            raise RuntimeError("no model")
        out = [float(c) for c in contents]
        if kind == "short":
            return out[1:]
        if kind in ("null", "nan", "text"):
            out[0] = {"null": None, "nan": float("nan"), "text": "x"}[kind]
        return out

    got = R.rerank_with(df, score, query_text="query", content="content", prior="prior", top=3, batch=batch).orderBy("query_id", "position").collect()
    by = {q: [r.doc_id for r in got if r.query_id == q] for q in (0, 1, 2, 3, 4, 5, 9)}
    assert by == {0: [5, 4, 3], 9: [1]} | {q: [0, 1, 2] for q in (1, 2, 3, 4, 5)} and not calls
    assert {r.rerank_score is None for r in got if r.query_id == 0} == {False} and {r.rerank_score for r in got if r.query_id == 1} == {None}
    assert "_score" not in got[0].asDict()


def test_folded_columns_stay(spark):
    assert R.rerank_with(spark.createDataFrame([], "query_id int, query string, doc_id int, prior int, content string"), lambda q, c: [],
                         query_text="query", content="content", prior="prior").where(F.lit(True)).count() == 0
