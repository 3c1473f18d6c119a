"""Graph, articles, memories and evaluation on the test tables."""

from pyspark.sql import functions as F

from tidewell.catalog.corpus import NOW, now
from tidewell.catalog.registry import once, query
from tidewell.catalog.retrieval import CENT_SQL, centroids
from tidewell.functions import fixed
from tidewell.functions import scoring as SC
from tidewell.functions.text import lookup
from tidewell.operators import editorial as ED
from tidewell.operators import evals as EV
from tidewell.operators import extraction as X
from tidewell.operators import graph as G
from tidewell.operators import memory as ME
from tidewell.plans.blocked import balanced_block, seq_block
from tidewell.session import fresh_path
from tidewell.sources import exports as EX


# --- graph -------------------------------------------------------------------
def entities(t):
    """Regions, nations, customers and suppliers as entities."""
    ent = lambda df, i, off, name, kind, chunk: df.select(
        (F.col(i).cast("bigint") + off).alias("entity_id"), F.col(name).alias("name"), F.lower(F.col(name)).alias("canonical_name"),
        F.lit(kind).alias("entity_type"), chunk.cast("bigint").alias("source_chunk"))
    none = F.lit(None)
    return (
        ent(t.region, "r_regionkey", 0, "r_name", "region", none)
        .unionByName(ent(t.nation, "n_nationkey", 1000, "n_name", "nation", F.col("n_regionkey")))
        .unionByName(ent(t.customer, "c_custkey", 10_000_000, "c_name", "customer", F.col("c_nationkey")))
        .unionByName(ent(t.supplier, "s_suppkey", 20_000_000, "s_name", "supplier", F.col("s_nationkey"))))


def edges(t):
    """located_in: nation to region, customer and supplier to nation; ordered: customer to supplier."""
    edge = lambda df, s, d, kind, conf: df.select(
        s.cast("bigint").alias("source_id"), d.cast("bigint").alias("target_id"), F.lit(kind).alias("relation_type"), conf.alias("confidence"),
        F.lit(None).cast("bigint").alias("source_chunk"))
    ordered = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(
        F.max("l_discount").alias("conf"), F.min("l_orderkey").alias("chunk"))
    return (
        edge(t.nation, F.col("n_nationkey") + 1000, F.col("n_regionkey"), "located_in", F.lit(1.0))
        .unionByName(edge(t.customer, F.col("c_custkey") + 10_000_000, F.col("c_nationkey") + 1000, "located_in", F.lit(0.9)))
        .unionByName(edge(t.supplier, F.col("s_suppkey") + 20_000_000, F.col("s_nationkey") + 1000, "located_in", F.lit(0.8)))
        .unionByName(ordered.select((F.col("o_custkey") + 10_000_000).alias("source_id"), (F.col("l_suppkey") + 20_000_000).alias("target_id"),
                                    F.lit("ordered").alias("relation_type"), F.col("conf").alias("confidence"), F.col("chunk").alias("source_chunk"))))


GRAPH_SQL = """
ent as (
  select r_regionkey::bigint as entity_id, r_name as name, 'region' as entity_type, null::bigint as source_chunk from region
  union all select n_nationkey + 1000, n_name, 'nation', n_regionkey from nation
  union all select c_custkey + 10000000, c_name, 'customer', c_nationkey from customer
  union all select s_suppkey + 20000000, s_name, 'supplier', s_nationkey from supplier),
edg as (
  select n_nationkey + 1000::bigint as source_id, n_regionkey::bigint as target_id, 'located_in' as relation_type, 1.0::double as confidence, null::bigint as source_chunk from nation
  union all select c_custkey + 10000000, c_nationkey + 1000, 'located_in', 0.9, null from customer
  union all select s_suppkey + 20000000, s_nationkey + 1000, 'located_in', 0.8, null from supplier
  union all select o_custkey + 10000000, l_suppkey + 20000000, 'ordered', max(l_discount), min(l_orderkey) from lineitem join orders on o_orderkey = l_orderkey group by o_custkey, l_suppkey)
"""


def asked_names(t):
    """Every entity by its name, with an article and spaces in front."""
    return entities(t).select(F.col("entity_id").alias("query_id"), F.concat(F.lit("  The  "), "name").alias("name"),
                              F.lit(None).cast("string").alias("entity_type"))


@query("c03_entity_lookup", f"""with {GRAPH_SQL}
select a.entity_id as query_id, e.entity_id, e.name, e.entity_type from ent a join ent e on lower(e.name) = lower(a.name)""")
def c03(t):
    return G.find_entities(asked_names(t), entities(t)).select("query_id", "entity_id", "name", "entity_type")


@query("c04_outgoing_neighbours", f"""with {GRAPH_SQL}
select c_custkey as query_id, d.target_id, d.relation_type, e.name as related_name, e.entity_type as related_type
from customer join edg d on d.source_id = c_custkey + 10000000 join ent e on e.entity_id = d.target_id""")
def c04(t):
    asked = t.customer.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") + 10_000_000).alias("entity_id"))
    return G.neighbours(asked, edges(t), entities(t)).select("query_id", "target_id", "relation_type", "related_name", "related_type")


@query("c04_incoming_neighbours", f"""with {GRAPH_SQL}
select n_nationkey::bigint as query_id, d.source_id, e.name as related_name, e.entity_type as related_type
from nation join edg d on d.target_id = n_nationkey + 1000 join ent e on e.entity_id = d.source_id where d.relation_type = 'located_in'""")
def c04b(t):
    asked = t.nation.select(F.col("n_nationkey").cast("bigint").alias("query_id"), (F.col("n_nationkey") + 1000).cast("bigint").alias("entity_id"))
    return G.neighbours(asked, edges(t), entities(t), "incoming", ["located_in"]).select("query_id", "source_id", "related_name", "related_type")


CARD_SQL = f"""{GRAPH_SQL},
one as (select a.entity_id as query_id, e.entity_id, e.source_chunk from ent a join ent e on lower(e.name) = lower(a.name)
        qualify count(*) over (partition by a.entity_id) = 1),
both_ways as (
  select o.query_id, 'outgoing' as direction, d.*, e.name as related_name, e.entity_type as related_type from one o join edg d on d.source_id = o.entity_id join ent e on e.entity_id = d.target_id
  union all
  select o.query_id, 'incoming', d.*, e.name, e.entity_type from one o join edg d on d.target_id = o.entity_id join ent e on e.entity_id = d.source_id),
card as (select *, row_number() over (partition by query_id, direction order by confidence desc, relation_type, source_id, target_id) - 1 as rank0 from both_ways qualify rank0 < 20)
"""


@query("f03_graph_search_card", f"with {CARD_SQL} select query_id, direction, related_name, related_type, confidence, rank0 from card")
def f03(t):
    best, _, _ = G.search_cards(asked_names(t), edges(t), entities(t))
    return best.select("query_id", "direction", "related_name", "related_type", "confidence", F.col("rank0").cast("bigint").alias("rank0"))


@query("g04_related_chunks", f"""with {CARD_SQL},
c as (select query_id, source_chunk from one where source_chunk is not null union select query_id, source_chunk from card where source_chunk is not null)
select query_id, string_agg(source_chunk::varchar, ',' order by source_chunk) as chunk_ids from c group by 1""")
def g04(t):
    _, _, chunks = G.search_cards(asked_names(t), edges(t), entities(t))
    return G.chunk_list(chunks).select("query_id", F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ",").alias("chunk_ids"))


@query("d19_entity_merge", """
with f as (select o_orderkey as seq, case when o_orderkey % 2 = 0 then 'The ' else '' end || c_mktsegment as name, o_orderstatus as entity_type, o_totalprice as confidence,
  case when o_orderpriority <> '5-LOW' then o_orderpriority end as properties, case when o_orderstatus <> 'P' then o_custkey end as source_chunk
  from orders join customer on c_custkey = o_custkey),
n as (select *, lower(regexp_replace(name, '^The ', '')) as canonical_name from f)
select canonical_name, entity_type, arg_min(name, seq) as name, max(confidence) as confidence, arg_max(properties, seq) filter (properties is not null) as properties,
  arg_max(source_chunk, seq) filter (source_chunk is not null) as source_chunk from n group by 1, 2""")
def d19(t):
    found = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("seq"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "The ").otherwise(""), "c_mktsegment").alias("name"),
        F.col("o_orderstatus").alias("entity_type"), F.col("o_totalprice").alias("confidence"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("properties"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("source_chunk"))
    return G.merge_entities(found).drop("entity_id")


@query("d20_relationship_merge", """
with f as (select l_suppkey as source_id, l_partkey as target_id, l_returnflag as relation_type, l_orderkey * 10 + l_linenumber as seq, l_discount as confidence,
  case when l_linestatus = 'O' then l_shipdate::varchar end as properties, l_orderkey as source_chunk from lineitem)
select source_id, target_id, relation_type, max(confidence) as confidence, arg_max(properties, (seq, properties)) filter (properties is not null) as properties, arg_min(source_chunk, seq) as source_chunk
from f group by 1, 2, 3""")
def d20(t):
    found = t.lineitem.select(
        F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("relation_type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_discount").alias("confidence"),
        F.when(F.col("l_linestatus") == "O", F.col("l_shipdate").cast("string")).alias("properties"), F.col("l_orderkey").alias("source_chunk"))
    return G.merge_relationships(found)


@query("c12_endpoint_resolution", """
with n as (select o_custkey as doc, o_orderkey as chunk_seq, o_orderkey as seq, o_orderpriority as name, o_orderkey * 7 as entity_id from orders),
e as (select o_custkey as doc, o_orderkey as edge_id, o_orderkey as chunk_seq, o_orderpriority as source_name,
        case o_orderstatus when 'F' then '1-URGENT' when 'O' then '3-MEDIUM' else '5-LOW' end as target_name from orders)
select e.doc, e.edge_id, arg_max(s.entity_id, s.seq) as source_id, arg_max(t.entity_id, t.seq) as target_id
from e join n s on s.doc = e.doc and s.name = e.source_name and s.chunk_seq <= e.chunk_seq join n t on t.doc = e.doc and t.name = e.target_name and t.chunk_seq <= e.chunk_seq
group by 1, 2""")
def c12(t):
    ents = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("chunk_seq"), F.col("o_orderkey").alias("seq"),
                           F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") * 7).alias("entity_id"))
    edg = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("edge_id"), F.col("o_orderkey").alias("chunk_seq"),
                          F.col("o_orderpriority").alias("source_name"),
                          lookup("o_orderstatus", {"F": "1-URGENT", "O": "3-MEDIUM"}, "5-LOW").alias("target_name"))
    return G.resolve_endpoints(edg, ents).select("doc", "edge_id", "source_id", "target_id")


@query("c13_entity_mentions", """
with r as (select page_id, html, list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as refs, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as claim from pages)
select page_id, len(list_filter(refs, lambda x: contains(lower(claim), lower(x)))) as n_found from r""")
def c13(t):
    r = t.pages.select("page_id", F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("refs"),
                       F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("claim"))
    return r.select("page_id", F.size(G.mentioned_entities("claim", "refs")).alias("n_found"))


@query("j05_gazetteer_extraction", """
with toks as (select doc_id, list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ts from documents),
gaz as (select word as canonical_name, case when count(*) > 1 then 'common' else 'rare' end as entity_type from (
  select unnest(list_distinct(list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) as word from benchmark) group by 1)
select distinct doc_id, canonical_name, entity_type from (select doc_id, unnest(ts) as canonical_name from toks) join gaz using (canonical_name)""")
def j05(t):
    from tidewell.functions.text import tokens
    words = t.benchmark.select(F.explode(F.array_distinct(tokens("text"))).alias("canonical_name"))
    gaz = words.groupBy("canonical_name").agg(F.when(F.count(F.lit(1)) > 1, "common").otherwise("rare").alias("entity_type"))
    return G.gazetteer_mentions(t.documents, gaz, id_col="doc_id", text_col="text").select(
        "doc_id", "canonical_name", "entity_type")


@query("j05_extraction_with_failures", """
select doc_id as id, length(text) >= 100 as ok, case when length(text) < 100 then 'too short' end as error, case when length(text) >= 100 then lang_word end as name
from (select doc_id, text, string_split(text, ' ')[1] as lang_word from documents)""")
def j05b(t):
    def extract(text):
        if len(text) < 100:
            raise ValueError("too short")
        return [{"name": text.split(" ")[0], "entity_type": "item"}]

    return G.extract_with(t.documents, extract, id_col="doc_id", text_col="text").select("id", "ok", "error", "name")


@query("j05_longest_mentions", """
with toks as (select doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ts from documents),
bench as (select list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ts from benchmark),
gaz as (select distinct array_to_string(ts[i:i + n - 1], ' ') as canonical_name, n from (select ts, unnest(range(1, len(ts) + 1)) as i from bench), (values (1), (2), (3)) as v(n)
  where i + n - 1 <= len(ts) and i % 4 = n % 4),
grams as (select doc_id, i, n, array_to_string(ts[i:i + n - 1], ' ') as gram from (select doc_id, ts, unnest(range(1, len(ts) + 1)) as i from toks), (values (1), (2), (3)) as v(n)
  where i + n - 1 <= len(ts)),
met as (select doc_id, i, max(n)::int as n from grams where gram in (select canonical_name from gaz) group by 1, 2),
steps as (select doc_id, list_reduce(list_transform(list(struct_pack(i := i::int, n := n) order by i), lambda m: [m]),
  lambda acc, x: case when x[1].i >= acc[-1].i + acc[-1].n then list_append(acc, x[1]) else acc end) as ms from met group by 1),
taken as (select doc_id, unnest(ms) as m from steps)
select doc_id, m.i - 1 as position, array_to_string(ts[m.i:m.i + m.n - 1], ' ') as canonical_name from taken join toks using (doc_id)""")
def j05_longest(t):
    """Names of one to three words of the benchmark, many of which overlap, as a reader of the documents meets them."""
    from tidewell.functions.text import tokens
    words = t.benchmark.select(tokens("text").alias("t"))
    names = None
    for n in (1, 2, 3):
        some = words.select(F.posexplode(G.word_sequences("t", n)).alias("i", "canonical_name")).where((F.col("i") + 1) % 4 == n % 4)
        names = some if names is None else names.unionByName(some)
    gaz = names.select("canonical_name", F.lit("item").alias("entity_type")).distinct()
    return G.longest_mentions(t.documents, gaz, id_col="doc_id", text_col="text").select("doc_id", "position", "canonical_name")


# Chunks are documents; a first run fails for short ones, and a second one for blank ones only.
EXTRACT_SQL = """
w as (select doc_id, length(text) >= 100 as early, unnest(range(len(string_split(text, chr(10))))) as place, string_split(unnest(string_split(text, chr(10))), ' ')[1] as word
  from documents where regexp_matches(text, '\\S')),
named as (select *, 'item ' || lower(word) as canonical_name, 'Item ' || word as name, row_number() over (order by early desc, doc_id, place) as n from w)
"""


def first_words(shortest):
    """A user's function: the first words of the lines as items, each of which requires the next one."""
    def extract(text):
        if len(text) < shortest or not text.strip():
            raise ValueError("too short")
        words = ["Item " + line.split(" ")[0] for line in text.split("\n")]
        return {"entities": [{"name": w, "entity_type": "item", "properties": {"line": i}} for i, w in enumerate(words)],
                "relationships": [{"source": a, "target": b, "relation_type": "requires"} for a, b in zip(words, words[1:], strict=False)]}

    return extract


def two_runs(t):
    """A run that fails for short chunks, one that reads them, and one that finds nothing left but the blank ones."""
    def make():
        store = X.ExtractionStore(t.spark, fresh_path(t.spark, "extraction"))
        chunks = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
        for version, shortest in ((1, 100), (2, 0), (3, 0)):
            X.run_extraction(store, chunks, version, first_words(shortest))
        return store.root

    return X.ExtractionStore(t.spark, once(t, "extraction", ["documents"], make))


@query("j05_extraction_ledger", """
select doc_id::varchar as chunk_id, regexp_matches(text, '\\S') as ok, case when not regexp_matches(text, '\\S') then 'too short' end as error,
  case when not regexp_matches(text, '\\S') then 3 when length(text) < 100 then 2 else 1 end::bigint as asked from documents""")
def j05_ledger(t):
    store = two_runs(t)
    asked = store.found().groupBy("chunk_id").agg(F.count(F.lit(1)).alias("asked"))
    return store.ledger().join(asked, "chunk_id")


@query("j05_extracted_entities", f"""with {EXTRACT_SQL}
select canonical_name, arg_min(name, n) as name, arg_max(doc_id, n)::varchar as source_chunk, 0.5::double as confidence, arg_max('{{"line": ' || place || '}}', n) as properties
from named group by 1""")
def j05_entities(t):
    return two_runs(t).entities(aliases={"no such name": ""}).select("canonical_name", "name", "source_chunk", "confidence", "properties")


@query("j05_extracted_edges", f"""with {EXTRACT_SQL},
pairs as (select a.canonical_name as source_name, b.canonical_name as target_name, a.doc_id, a.n from named a join named b on a.doc_id = b.doc_id and b.place = a.place + 1)
select source_name, target_name, 'requires' as relation_type, arg_min(doc_id, n)::varchar as source_chunk from pairs group by 1, 2""")
def j05_edges(t):
    store = two_runs(t)
    named = store.entities(aliases={"no such name": ""}).select("entity_id", "canonical_name")
    source = named.select(F.col("entity_id").alias("source_id"), F.col("canonical_name").alias("source_name"))
    target = named.select(F.col("entity_id").alias("target_id"), F.col("canonical_name").alias("target_name"))
    return store.edges(aliases={"no such name": ""}).join(source, "source_id").join(target, "target_id").select("source_name", "target_name", "relation_type", "source_chunk")


@query("j06_seed_types", "with kinds(entity_type, display) as (values " + ", ".join(
    f"('{x}', '{x.replace('_', ' ').title()}')" for x in fixed.ENTITY_TYPES) + """)
select entity_type, display, count(p_partkey) as n from kinds left join part on p_partkey % 17 = length(entity_type) group by 1, 2""")
def j06(t):
    """Every type with its display name, and the parts dealt to it by the length of its name."""
    types = G.entity_types(t.spark)
    return types.join(t.part, F.col("p_partkey") % 17 == F.length("entity_type"), "left").groupBy(
        "entity_type", F.col("display_name").alias("display")).agg(F.count("p_partkey").alias("n"))


@query("j06_seed_aliases", "with aliases(alias, canonical_name) as (values " + ", ".join(
    "('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in fixed.ALIASES.items()) + """)
select alias, canonical_name, count(doc_id) as n_docs from aliases left join (
  select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents) on word = alias group by 1, 2""")
def j06_aliases(t):
    """Every alias row, and the documents that write it."""
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("alias"))
    return G.alias_table(t.spark).join(words, "alias", "left").groupBy("alias", "canonical_name").agg(F.count("doc_id").alias("n_docs"))


# --- articles ----------------------------------------------------------------
def verdict_sql(line="line"):
    return f"case when regexp_matches({line}, '[0-9]') then 'contradicted' when length({line}) < 40 then 'unsupported' else 'verified' end"


LINES_SQL = f"""
ln as (select doc_id, source, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line from documents),
vd as (select *, {verdict_sql()} as status, (length(line) % 100) / 100.0::double as confidence from ln)
"""


def verdicts(t):
    """Lines of documents as claims of an article, judged by their text."""
    ln = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return ln.select("doc_id", "source", "i", "line", verdict("line").alias("status"), ((F.length("line") % 100) / 100.0).alias("confidence"))


def verdict(line):
    col = F.col(line) if isinstance(line, str) else line
    return F.when(col.rlike("[0-9]"), "contradicted").when(F.length(col) < 40, "unsupported").otherwise("verified")


@query("d24_article_confidence", f"""with {LINES_SQL}
select doc_id, count(*) as n_claims, count(*) filter (status = 'contradicted') as n_contradicted,
  round(greatest(0, least(1, avg(confidence) - 0.15::double * count(*) filter (status = 'contradicted'))), 6)::double as confidence from vd group by 1""")
def d24(t):
    return ED.article_confidence(verdicts(t), "doc_id").withColumn("confidence", F.round("confidence", 6))


@query("d25_contradiction_events", f"""with {LINES_SQL},
s as (select doc_id, any_value(source) as source, count(*) filter (status = 'contradicted') / count(*)::double as share,
  'Contradicted claims: ' || string_agg(left(line, 100), '; ' order by i) filter (status = 'contradicted') as details from vd group by 1)
select doc_id, source as url, round(-0.1 * share, 6)::double as delta, details from s where share > 0 and source in (select 'src' || (user_id % 20) from events)""")
def d25(t):
    claims = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), verdict(x).alias("status")))
    art = t.documents.select("doc_id", F.array("source").alias("source_urls"), claims.alias("claims"))
    known = t.events.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("url")).distinct()
    got = ED.contradiction_events(art, verdicts(t), known, "doc_id", now())
    return got.select("doc_id", "url", F.round("delta", 6).alias("delta"), "details")


@query("j11_claim_check", f"""with {LINES_SQL},
c as (select doc_id, greatest(0, least(1, avg(confidence) - 0.15::double * count(*) filter (status = 'contradicted'))) as confidence from vd group by 1)
select doc_id, round(confidence, 6)::double as confidence, round(confidence, 9) >= 0.6 as approved from c""")
def j11(t):
    got, _, _ = ED.claim_check(verdicts(t).withColumn("note", F.lit("x")), "doc_id", "line")
    return got.select("doc_id", F.round("confidence", 6).alias("confidence"), "approved")


@query("j11_corrections_and_gaps", f"""with {LINES_SQL}
select doc_id, 'Claim ''' || line || ''' contradicted: digits' as entry from vd where status = 'contradicted' union all select doc_id, line from vd where status = 'unsupported'""")
def j11b(t):
    _, corr, gaps = ED.claim_check(verdicts(t).withColumn("note", F.lit("digits")), "doc_id", "line")
    return corr.select("doc_id", F.col("correction").alias("entry")).unionByName(gaps.select("doc_id", F.col("gap").alias("entry")))


@query("c14_claim_update", """
select d.doc_id, case when l.doc_id is not null then quality = 1 else false end as verified,
  case when l.doc_id is not null and source <> lang then source || ',' || lang || case when quality = 1 then ',yes' else ',no' end else source || ',' || lang end as evidence
from documents d left join labels l using (doc_id)""")
def c14(t):
    claims = t.documents.select("doc_id", F.lit(False).alias("verified"), F.array("source", "lang", "source").alias("evidence"))
    v = t.labels.select("doc_id", F.when(F.col("quality") == 1, "verified").otherwise("unsupported").alias("status"),
                        F.when(F.col("quality") == 1, F.array(F.lit("yes"))).alias("supporting"), F.when(F.col("quality") != 1, F.array(F.lit("no"))).alias("contradicting"))
    got = ED.update_claims(claims.withColumn("evidence", F.array_distinct("evidence")), v, ["doc_id"])
    return got.select("doc_id", "verified", F.array_join("evidence", ",").alias("evidence"))


@query("j07_article_transitions", """
with a as (select o_orderkey, case o_orderstatus when 'F' then 'draft' when 'O' then 'review' else 'published' end as cur, o_orderpriority as p from orders),
r as (select *, case p when '1-URGENT' then 'create' when '2-HIGH' then 'update' when '3-MEDIUM' then 'reject' else 'status' end as action,
  case when p = '4-NOT SPECIFIED' then 'review' else 'published' end as target from a)
select o_orderkey, action, case when action = 'create' then 'already exists' when action = 'update' and cur <> 'draft' then 'not a draft'
  when action = 'reject' and cur <> 'review' then 'not in review'
  when action = 'status' and not ((cur = 'draft' and target = 'review') or (cur = 'review' and target = 'published')) then 'invalid transition' end as reject_reason,
  case when action = 'create' or (action = 'update' and cur <> 'draft') or (action = 'reject' and cur <> 'review') or
    (action = 'status' and not ((cur = 'draft' and target = 'review') or (cur = 'review' and target = 'published'))) then cur
  when action = 'status' then target else 'draft' end as status from r""")
def j07(t):
    path = F.col("o_orderkey").cast("string").alias("path")
    art = t.orders.select(path, lookup("o_orderstatus", {"F": "draft", "O": "review"}, "published").alias("status"),
                          F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("string").alias("rejection_reason"))
    req = t.orders.select(path, lookup("o_orderpriority", {"1-URGENT": "create", "2-HIGH": "update", "3-MEDIUM": "reject"}, "status").alias("action"),
                          F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "review").otherwise("published").alias("target"), F.lit("thin").alias("reason"))
    dec = ED.transitions(req, art)
    after = ED.apply_transitions(art, dec, now())
    return dec.select("path", "action", "reject_reason").join(after.select("path", "status"), "path").select(
        F.col("path").cast("bigint").alias("o_orderkey"), "action", "reject_reason", "status")


def findings(t):
    """Lines as findings of a task (their source), in document order."""
    ln = t.documents.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return ln.select("source", "line", "lang", (F.col("doc_id") * 100000 + F.col("i")).alias("seq"), ((F.length("line") % 100) / 100.0).alias("confidence"))


FIND_SQL = """
fd as (select source, line, lang, doc_id * 100000 + i as seq, (length(line) % 100) / 100.0::double as confidence from (
  select doc_id, source, lang, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line from documents))
"""


@query("d26_finding_merge", f"with {FIND_SQL} select source, line, min(seq) as seq, arg_min(lang, seq) as lang, arg_min(confidence, seq) as confidence from fd group by 1, 2")
def d26(t):
    return ED.merge_findings(findings(t), ["source"], "line", F.col("seq"))


@query("d26_task_outcomes", """
select source, case when bool_and(n_chars > 100) then 'success' else 'partial' end as status, bool_and(n_chars < 20000) as sufficient from documents group by 1""")
def d26b(t):
    r = t.documents.select("source", F.when(F.col("n_chars") > 100, "success").otherwise("failed").alias("status"), (F.col("n_chars") < 20000).alias("sufficient"))
    return ED.merge_outcomes(r, "source")


@query("d27_article_sources", f"""with {FIND_SQL},
w as (select source, unnest(['http://' || lang || '/' || (length(line) % 7), line]) as url, seq, confidence from fd)
select source, url, arg_min(confidence, seq) as trust from w where url like 'http%' group by 1, 2""")
def d27(t):
    f = findings(t).withColumn("evidence", F.array(F.concat(F.lit("http://"), "lang", F.lit("/"), (F.length("line") % 7).cast("string")), F.col("line")))
    return ED.article_sources(f, "source", F.col("seq"))


@query("d27_article_mean_confidence", f"with {FIND_SQL} select source, round(avg(confidence), 4) as confidence from fd group by 1")
def d27b(t):
    return ED.written_confidence(findings(t), "source")


@query("g03_ordered_distinct_union", f"""with {FIND_SQL},
f as (select source, lang || (length(line) % 9) as value, min(seq) as first_at from fd group by 1, 2)
select source, value, row_number() over (partition by source order by first_at) - 1 as position from f""")
def g03(t):
    v = findings(t).withColumn("value", F.concat("lang", (F.length("line") % 9).cast("string")))
    firsts = ED.distinct_in_order(v, "source", "value", F.col("seq"))
    return ED.numbered(firsts, "source", seq_block("first_at")).select("source", "value", "position")


# --- memories ----------------------------------------------------------------
def memories(t):
    """Embeddings as memories; age and quality come from the event of the same number."""
    e = t.events.select(F.col("event_id").alias("vec_id"), F.col("ts").alias("created_at"), (F.col("value") / 500).alias("quality"))
    return t.embeddings.select("vec_id", "embedding").join(e, "vec_id").withColumnRenamed("vec_id", "memory_id")


RECENCY_SQL = f"exp(-greatest(0, date_diff('microsecond', ts, timestamp '{NOW}') / 86400000000.0) / 30.0)"


@query("h07_recency_and_composite", f"""
select event_id, round({RECENCY_SQL}, 6) as recency, round(0.6 * 0.5 + 0.2 * {RECENCY_SQL} + 0.2 * value / 500, 6) as score from events""")
def h07(t):
    r = SC.recency("ts", now())
    return t.events.select("event_id", F.round(r, 6).alias("recency"), F.round(SC.composite(F.lit(0.5), r, F.col("value") / 500), 6).alias("score"))


@query("f04_memory_recall", f"""with {CENT_SQL},
near as (select query_id, doc_id, similarity from cknn where rank0 < 15),
sc as (select query_id, doc_id as memory_id, round(0.6 * greatest(0, similarity) + 0.2 * {RECENCY_SQL} + 0.2 * value / 500, 9) as score from near join events on event_id = doc_id)
select query_id, memory_id, round(score, 6) as score, position from (select *, row_number() over (partition by query_id order by score desc, memory_id) - 1 as position from sc) where position < 5""")
def f04(t):
    got = ME.recall(memories(t), centroids(t), now())
    return got.select("query_id", "memory_id", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position"))


def uses(t):
    """Events as uses of a strategy, its pattern the value in tens."""
    return t.events.select(
        F.concat(F.lit("p"), F.floor(F.col("value") / 10).cast("string")).alias("pattern"), F.col("event_id").alias("seq"),
        F.array("event_type", F.col("props")).alias("tools"), (F.col("value") / 500).alias("quality"), F.col("ts").alias("used_at"))


STRAT_SQL = """
u as (select 'p' || floor(value / 10)::bigint as pattern, event_id as seq, event_type || '|' || props as tools, value / 500 as quality, ts as used_at from events),
st as (select pattern, count(*) as times_reinforced, round(avg(quality), 6) as avg_quality, arg_max(tools, seq) as tools, max(used_at) as last_used from u group by 1)
"""


def shown_strategies(df):
    return df.select("pattern", "times_reinforced", F.round("avg_quality", 6).alias("avg_quality"), F.array_join("tools", "|").alias("tools"), "last_used")


@query("d18_strategy_reinforcement", f"with {STRAT_SQL} select * from st")
def d18(t):
    return shown_strategies(ME.reinforce(uses(t)))


@query("f05_best_strategies", f"with {STRAT_SQL} select pattern, avg_quality from st order by avg_quality desc, pattern limit 3")
def f05(t):
    return ME.best_strategies(shown_strategies(ME.reinforce(uses(t)))).select("pattern", "avg_quality")


@query("e08_context_budget", """
with r as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as running_chars from conversations)
select conv_id, turn, running_chars::bigint as running_chars from r where running_chars <= 2000""")
def e08(t):
    return ME.within_budget(t.conversations, "conv_id", "turn", "text", balanced_block(t.conversations, "turn")).select("conv_id", "turn", "running_chars")


@query("e09_history_trim", "select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 3")
def e09(t):
    return ME.newest(t.conversations, "conv_id", "turn", 3).select("conv_id", "turn")


@query("h22_strategy_quality", """
select user_id, least(1.0, 0.5 + 0.1 * count(distinct event_type))::double as quality from events group by 1""")
def h22(t):
    # Distinct first: a user has at most a handful of event types.
    n = t.events.select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", SC.strategy_quality("n").alias("quality"))


# --- evaluation --------------------------------------------------------------
def judged(t):
    """Documents of a source as judged claims; unlabelled ones are unclear."""
    return t.documents.join(t.labels, "doc_id", "left").select(
        "source", "lang", F.when(F.col("quality") == 1, "supported").when(F.col("quality") == 0, "not_supported").otherwise("unclear").alias("judgment"),
        F.col("quality"), F.col("toxic"))


@query("d12_faithfulness", """
select source, round(case when count(quality) > 0 then sum(quality) / count(quality)::double else 1.0 end, 6)::double as faithfulness
from documents left join labels using (doc_id) group by 1""")
def d12(t):
    return EV.faithfulness(judged(t), "source").withColumn("faithfulness", F.round("faithfulness", 6))


def results(t):
    """Four scores per labelled document."""
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", F.when(F.col("lang") != "es", F.col("lang")).otherwise("").alias("tier"), F.col("quality").cast("double").alias("faithfulness"),
        (1.0 - F.col("toxic")).alias("relevancy"), F.least(F.lit(1.0), F.col("n_chars") / 1000).alias("trajectory"),
        SC.clamp(F.col("n_chars") / 500).alias("accuracy"))


RES_SQL = """
rs as (select doc_id, case when lang <> 'es' then lang else '' end as tier, quality::double as f, 1.0::double - toxic as r, least(1.0::double, n_chars / 1000.0::double) as t,
  greatest(0.0::double, least(1.0::double, n_chars / 500.0::double)) as a from labels join documents using (doc_id))
"""
MEANS = "round(avg(f), 6) as faithfulness, round(avg(r), 6) as relevancy, round(avg(t), 6) as trajectory, round(avg(a), 6) as accuracy"


def rounded_scores(df, *keys):
    return df.select(*keys, "n", *[F.round(s, 6).alias(s) for s in EV.SCORES])


@query("d14_gate_report", f"with {RES_SQL} select count(*) as n, {MEANS}, avg(f) >= 0.8 and avg(r) >= 0.7 and avg(t) >= 0.7 and avg(a) >= 0.7 as passed from rs")
def d14(t):
    got = EV.gate_report(results(t))
    return got.select("n", *[F.round(s, 6).alias(s) for s in EV.SCORES], "passed")


@query("d15_tier_breakdown", f"with {RES_SQL} select case when tier = '' then 'unknown' else tier end as tier, count(*) as n, {MEANS} from rs group by 1")
def d15(t):
    return rounded_scores(EV.tier_breakdown(results(t)), "tier")


@query("h15_blended_accuracy", f"""with {RES_SQL}
select doc_id, round(case when tier = 'en' and a < 0.9 then (a + t) / 2 else a end, 6) as accuracy from rs""")
def h15(t):
    r = results(t).withColumn("tier", lookup("tier", {"en": "simulation"}, "other")).withColumn("_r", F.when(F.col("accuracy") < 0.9, F.col("trajectory")))
    return r.select("doc_id", F.round(SC.blended_accuracy("accuracy", "_r", "tier"), 6).alias("accuracy"))


@query("h16_clamp", "select event_id, greatest(0, least(1, value / 50 - 0.5))::double as score from events")
def h16(t):
    return t.events.select("event_id", SC.clamp(F.col("value") / 50 - 0.5).alias("score"))


def calls(t):
    """Events of a user as tool calls in order."""
    return t.events.select("user_id", "event_id", F.col("event_type").alias("tool_name"), "props")


def call_block(t):
    return balanced_block(t.events, "event_id")


@query("e05_repeat_flag", """
select user_id, event_id, coalesce(event_type = lag(event_type) over (partition by user_id order by event_id), false) as is_repeat from events""")
def e05(t):
    return EV.with_repeats(calls(t), "user_id", "event_id", call_block(t)).select("user_id", "event_id", "is_repeat")


@query("e06_tail_runs", """
with l as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id desc) as r from events),
m as (select user_id, any_value(event_type) filter (r = 1) as call, min(r) filter (event_type <> last_type) as brk, count(*) as n
      from (select *, first_value(event_type) over (partition by user_id order by r) as last_type from l) group by 1)
select user_id, call, coalesce(brk - 1, n) as run_length from m where coalesce(brk - 1, n) >= 2""")
def e06(t):
    return EV.tail_runs(calls(t), "user_id", "event_id", call_block(t), F.col("tool_name"), 2)


@query("d13_trajectory_precision", """
with c as (select user_id, event_type, coalesce(event_type = lag(event_type) over (partition by user_id order by event_id), false) as rep from events),
p as (select user_id, round(count(*) filter (not rep and event_type in ('click', 'view')) / count(*)::double, 6) as x from c group by 1)
select c_custkey as user_id, coalesce(x, 1.0)::double as trajectory_precision from customer left join p on user_id = c_custkey""")
def d13(t):
    questions = t.customer.select(F.col("c_custkey").alias("user_id"))
    expected = t.events.select("user_id", F.col("event_type").alias("tool_name")).where(F.col("tool_name").isin("click", "view"))
    got = EV.trajectory_precision(questions, calls(t), expected, "user_id", "event_id", call_block(t))
    return got.withColumn("trajectory_precision", F.round("trajectory_precision", 6))


@query("d28_total_repeats", "select user_id, event_type || ':' || props as call, count(*) as times from events group by 1, 2 having count(*) >= 3")
def d28(t):
    return EV.total_repeats(calls(t), "user_id", F.concat("tool_name", F.lit(":"), "props"), 3)


@query("d28_token_budget", """
select conv_id, (sum(length(text) + length(role)) // 4)::bigint as tokens, sum(length(text) + length(role)) // 4 > 500 as over_budget from conversations group by 1""")
def d28b(t):
    return EV.token_budget(t.conversations, "conv_id", ["text", "role"], 500)


@query("d28_loop_report", """
with s as (select *, md5(text) as h from conversations),
t as (select conv_id, count(*) as times from s group by conv_id, role, h),
m as (select conv_id, max(times) as times from t group by 1),
b as (select conv_id, sum(length(text)) // 4 > 400 as over_budget from conversations group by 1),
l as (select conv_id, role || h as call, row_number() over (partition by conv_id order by turn desc) as r from s),
k as (select conv_id, count(*) = 2 and count(distinct call) = 1 as stuck from l where r <= 2 group by 1)
select conv_id, case when stuck then 'stuck' when times >= 2 then 'looping' when over_budget then 'over budget' end as problem
from m join b using (conv_id) join k using (conv_id)""")
def d28c(t):
    c = t.conversations.withColumn("h", F.md5("text"))
    return EV.loop_report(c, "conv_id", "turn", balanced_block(t.conversations, "turn"), F.concat("role", "h"), ["text"],
                          n_tail=2, n_total=2, budget=400).select("conv_id", "problem")


@query("h21_compact_observations", """
with r as (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations)
select conv_id, turn, case when rn <= 2 then text else '[Summarized] [' || role || '] ' || case when length(text) > 200 then left(text, 100) || '... [truncated] ...' || right(text, 100) else text end end as text from r""")
def h21b(t):
    return EV.compact_observations(t.conversations, "conv_id", "turn", tool="role", observation="text").select("conv_id", "turn", "text")


# --- training traces ---------------------------------------------------------
def traces(t):
    """First user text and last assistant text of a conversation as a trace."""
    return t.conversations.groupBy(F.col("conv_id").alias("trace_id")).agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("input"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("output"))


def trace_scores(t):
    """Labels as feedback of the trace of the same number, turn counts as trajectory precision."""
    fb = t.labels.select(F.col("doc_id").alias("trace_id"), F.lit("user_feedback").alias("name"), F.col("quality").cast("double").alias("value"), F.lit(0).alias("seq"))
    tp = t.conversations.groupBy(F.col("conv_id").alias("trace_id")).agg((F.count(F.lit(1)) / 6).alias("value")).select(
        "trace_id", F.lit("trajectory_precision").alias("name"), "value", F.lit(0).alias("seq"))
    return fb.unionByName(tp)


TRACE_SQL = """
tr as (select conv_id as trace_id, arg_min(text, turn) filter (role = 'user') as input, arg_max(text, turn) filter (role = 'assistant') as output, count(*) / 6.0::double as traj from conversations group by 1),
ok as (select tr.* from tr left join labels on doc_id = trace_id where coalesce(quality, -1) >= 1 and traj >= 0.7)
"""


@query("b11_scored_traces", f"with {TRACE_SQL} select trace_id, input, output from ok")
def b11(t):
    return EX.scored_traces(traces(t), trace_scores(t)).select("trace_id", "input", "output")


@query("a09_sharegpt_export", f"""with {TRACE_SQL}
select trace_id, to_json({{'conversations': [{{'from': 'system', 'value': 'You help.'}}, {{'from': 'human', 'value': input}}, {{'from': 'gpt', 'value': output}}]}})::varchar as value
from ok where coalesce(input, '') <> '' and coalesce(output, '') <> ''""")
def a09(t):
    return EX.to_sharegpt(EX.scored_traces(traces(t), trace_scores(t)), "You help.")


@query("a09_function_calling_export", r"""
select event_id as trace_id, '{"messages":[{"role":"system","content":"You help."},{"role":"user","content":"user ' || user_id || '"},' ||
  '{"role":"assistant","tool_calls":[{"id":"call_1","type":"function","function":{"name":"' || event_type || '","arguments":' || to_json(props)::varchar || '}}]},' ||
  '{"role":"tool","content":"' || value || '","tool_call_id":"call_1"},{"role":"assistant","content":"' || event_type || '"}]}' as value from events""")
def a09b(t):
    """Every event a trace with its own observation of the tool used."""
    obs = F.array(
        F.struct(F.lit("span").alias("type"), F.lit("x").alias("name"), F.lit("{}").alias("input"), F.lit("").alias("output")),
        F.struct(F.lit("tool").alias("type"), F.col("event_type").alias("name"), F.col("props").alias("input"), F.col("value").cast("string").alias("output")))
    tr = t.events.select(F.col("event_id").alias("trace_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("input"),
                         F.col("event_type").alias("output"), obs.alias("observations"))
    return EX.to_function_calling(tr, "You help.")
