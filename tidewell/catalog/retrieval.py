"""Search queries: documents as chunks, benchmark texts and label centroids as queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.catalog.registry import Tables, once, query
from tidewell.operators import retrieval as R
from tidewell.operators import search_index as S
from tidewell.operators import trust as TR
from tidewell.session import fresh_path

# Sources: trust and staleness derive from the documents and events of each source.
SRC_SQL = """
src_delta as (
  select 'src' || (user_id % 20) as source,
         sum(case event_type when 'error' then -0.1::double when 'purchase' then 0.05::double else 0::double end) as delta_sum
  from events group by 1),
src as (
  select d.source, count(*) as n_docs, avg(d.n_chars) > 2600 as is_stale,
         0.3::double + 0.05::double * (count(*) % 10) as trust_score
  from documents d group by 1),
trusted as (
  select s.*, greatest(0.1::double, least(1.0::double, trust_score + coalesce(delta_sum, 0::double))) as effective_trust
  from src s left join src_delta using (source))
"""

TOK_SQL = f"""
toks as (
  select doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'),
                             lambda t: t <> '') as toks
  from documents),
corpus as (select count(*) as n_docs, avg(len(toks)) as avg_len from toks),
placed as (
  select doc_id, len(toks) as doc_len, unnest(toks) as term, unnest(range(len(toks))) as pos from toks),
words as (
  select distinct item_id as query_id, w
  from (select item_id, unnest(regexp_split_to_array(text, '\\s+')) as w from benchmark)),
phrases as (
  select distinct query_id, array_to_string(terms, ' ') as phrase, terms from (
    select query_id, list_filter(regexp_split_to_array(strip_accents(lower(w)), '[^\\p{{L}}\\p{{N}}]+'),
                                 lambda t: t <> '') as terms from words)
  where len(terms) > 0),
pterms as (
  select phrase, len(terms) as n, unnest(terms) as term, unnest(range(len(terms))) as off
  from (select distinct phrase, terms from phrases)),
starts as (
  select phrase, doc_id, doc_len, pos - off as start from placed join pterms using (term)
  group by phrase, doc_id, doc_len, pos - off, n having count(*) = n),
hits as (select phrase, doc_id, doc_len, count(*) as tf from starts group by all),
dfs as (select phrase, count(*) as df from hits group by 1),
needed as (select query_id, count(*) as n from phrases group by 1),
scores as (
  select query_id, doc_id, count(*) as got,
    sum(case when ln((n_docs - df + 0.5::double) / (df + 0.5::double)) <= 0 then 1e-6::double
             else ln((n_docs - df + 0.5::double) / (df + 0.5::double)) end
        * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * doc_len / avg_len))) as score
  from phrases join hits using (phrase) join dfs using (phrase), corpus
  group by 1, 2),
bm as (
  select query_id, doc_id, round(score, 9) as score from scores join needed using (query_id) where got = n),
kw as (
  select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank0 from bm)
  where rank0 < 20)
"""

EMB_SQL = f"""
cells as (
  select kind, id, ('0x' || substr(h, 1, 2))::int % 64 as i, case when substr(h, 3, 1) < '8' then 1.0::double else -1.0::double end as s
  from (select kind, id, md5(t) as h from (
    select kind, id, unnest(list_filter(
      regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) as t
    from (select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from benchmark)))),
sparse as (select kind, id, i, sum(s) as x from cells group by all),
norms as (select kind, id, sqrt(sum(x * x)) as nrm from sparse group by all),
sims as (
  select q.id as query_id, d.id as doc_id, sum(q.x * d.x) as dot
  from sparse q join sparse d on q.kind = 1 and d.kind = 0 and q.i = d.i group by 1, 2),
allsims as (
  select q.id as query_id, d.id as doc_id,
         round(case when q.nrm * d.nrm > 0 then coalesce(dot, 0) / (q.nrm * d.nrm) else 0 end, 9) as similarity
  from norms q join norms d on q.kind = 1 and d.kind = 0
  left join sims s on s.query_id = q.id and s.doc_id = d.id),
vec as (
  select * from (select *, row_number() over (partition by query_id order by similarity desc, doc_id) - 1 as rank0
                 from allsims) where rank0 < 20)
"""


def doc_sources(t: Tables) -> DataFrame:
    """Sources with base trust, stale flag and effective trust."""
    src = t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("n_chars").alias("chars")).select(
        "source", "n_docs", (F.col("chars") > 2600).alias("is_stale"),
        (F.lit(0.3) + F.lit(0.05) * (F.col("n_docs") % 10)).alias("trust_score"))
    return TR.effective_trust(src, trust_events(t))


def trust_events(t: Tables) -> DataFrame:
    """Events as trust events of a source."""
    delta = F.when(F.col("event_type") == "error", F.lit(-0.1)).when(
        F.col("event_type") == "purchase", F.lit(0.05)).otherwise(F.lit(0.0))
    return t.events.select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), "event_id", "event_type",
        delta.alias("delta"), F.col("ts").alias("created_at"))


def stored_index(t: Tables) -> S.SearchIndex:
    """The index of the documents."""
    return S.open_index(t.spark, once(t, "search-index", ["documents"], lambda: S.create_index(t.documents, fresh_path(t.spark, "search-index")).root))


def keyword_scores(t: Tables) -> DataFrame:
    return S.search_scores(stored_index(t), t.benchmark, query_id="item_id")


def keyword_list(t: Tables, k: int = R.fetch_size()) -> DataFrame:
    return R.keyword_ranks(keyword_scores(t), k)


def vector_list(t: Tables) -> DataFrame:
    docs = R.feature_hash_embedding(t.documents, "doc_id", "text")
    qs = R.feature_hash_embedding(t.benchmark, "item_id", "text").select(
        F.col("item_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return R.knn(docs, qs, 20)


def centroids(t: Tables) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    parts = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("x"))
    # At most one row per dimension and label.
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("query_embedding")
    ).select(F.col("label").cast("bigint").alias("query_id"), "query_embedding")


CENT_SQL = """
parts as (select label, vec_id, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as i from embeddings),
cent as (select label::bigint as query_id, i, round(avg(x), 6) as x from parts group by all),
cn as (select query_id, sqrt(sum(x * x)) as nrm from cent group by 1),
vn as (select vec_id, sqrt(sum(x * x)) as nrm from parts group by 1),
csim as (
  select c.query_id, p.vec_id as doc_id, round(sum(c.x * p.x) / (any_value(cn.nrm) * any_value(vn.nrm)), 9) as similarity
  from parts p join cent c using (i) join cn on cn.query_id = c.query_id join vn on vn.vec_id = p.vec_id
  group by 1, 2),
cknn as (
  select * from (select *, row_number() over (partition by query_id order by similarity desc, doc_id) - 1 as rank0
                 from csim) where rank0 < 20)
"""


def centroid_knn(t: Tables, k: int = 20) -> DataFrame:
    return R.knn(t.embeddings, centroids(t), k, id_col="vec_id")


@query("i01_bm25", f"with {TOK_SQL} select query_id, doc_id, round(score, 6) as score from bm")
def i01(t):
    return keyword_scores(t).select("query_id", "doc_id", F.round(F.round("score", 9), 6).alias("score"))


@query("i01_phrase_hits", f"with {TOK_SQL} select phrase, doc_id, doc_len::int as doc_len, tf from hits")
def i01_hits(t):
    hits = R.phrase_hits(R.tokenized(t.documents, "doc_id", "text"), R.query_phrases(t.benchmark, "item_id", "text"))
    return hits.where(F.col("phrase") != "")


@query("i01_postings", f"""with {TOK_SQL}
select term, count(distinct doc_id) as df, count(*) as cf, sum(pos) ::bigint as pos_sum from placed group by 1""")
def i01_postings(t):
    p = R.build_postings(t.documents, "doc_id", "text")
    places = F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.sum(places).alias("pos_sum"))


@query("i01_top_scores", f"with {TOK_SQL} select query_id, doc_id, rank0, round(score, 6) as score from kw")
def i01_top(t):
    got = S.search_top(stored_index(t), t.benchmark, 20, query_id="item_id")
    return got.select("query_id", "doc_id", F.col("rank0").cast("bigint").alias("rank0"), F.round("score", 6).alias("score"))


CHANGED_SQL = TOK_SQL.replace("from documents)", "from documents join src using (source) where not is_stale)")


@query("i01_index_after_changes", f"with {SRC_SQL}, {CHANGED_SQL} select query_id, doc_id, round(score, 6) as score from bm")
def i01_changed(t):
    """An index of first lines, then with every text whole, then with the stale sources' documents gone."""
    docs = t.documents.select("doc_id", "text")
    first = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("text"))
    index = S.create_index(first, fresh_path(t.spark, "search-index"))
    longer = docs.where(F.instr("text", "\n") > 0)
    S.change_index(index, 1, added=longer, removed=first.join(longer.select("doc_id"), "doc_id", "left_semi"))
    stale = doc_sources(t).where("is_stale").select("source")
    S.change_index(index, 2, added=docs.limit(0), removed=t.documents.join(stale, "source", "left_semi").select("doc_id", "text"))
    return S.search_scores(index, t.benchmark, query_id="item_id").select("query_id", "doc_id", F.round(F.round("score", 9), 6).alias("score"))


@query("i01_folded_tokens", """
with toks as (select unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) as term from (
  select text from documents union all select text from conversations))
select term, count(*) as n from toks where term <> strip_accents(term) or regexp_matches(term, '[^a-z0-9]') group by 1
""")
def i01_folded(t):
    """Terms of documents and conversations that are still not plain letters and digits after folding."""
    from tidewell.functions.text import tokens

    texts = t.documents.select("text").unionAll(t.conversations.select("text"))
    terms = texts.select(F.explode(tokens("text")).alias("term"))
    return terms.where(F.col("term").rlike("[^a-z0-9]")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("i02_cosine_knn", f"with {CENT_SQL} select query_id, doc_id, rank0, round(similarity, 6) as similarity from cknn")
def i02(t):
    return centroid_knn(t).select("query_id", "doc_id", F.col("rank0").cast("bigint").alias("rank0"),
                                  F.round("similarity", 6).alias("similarity"))


@query("e01_candidate_ranks", f"with {TOK_SQL} select query_id, doc_id, rank0 from kw")
def e01(t):
    return keyword_list(t).select("query_id", "doc_id", F.col("rank0").cast("bigint").alias("rank0"))


@query("c01_live_chunks", f"""with {SRC_SQL}
select doc_id, source, n_chars from documents join trusted using (source) where not is_stale""")
def c01(t):
    ids = t.documents.select("doc_id", "n_chars")
    return R.live(ids, t.documents, doc_sources(t)).select("doc_id", "source", "n_chars")


@query("c02_merge_ranked_lists", f"""with {TOK_SQL}, {EMB_SQL}
select coalesce(f.query_id, v.query_id) as query_id, coalesce(f.doc_id, v.doc_id) as doc_id,
       f.rank0 as keyword_rank, v.rank0 as vector_rank
from kw f full outer join vec v on f.query_id = v.query_id and f.doc_id = v.doc_id""")
def c02(t):
    return R.merge_ranks(keyword_list(t), vector_list(t)).select(
        "query_id", "doc_id", F.col("keyword_rank").cast("bigint").alias("keyword_rank"),
        F.col("vector_rank").cast("bigint").alias("vector_rank"))


@query("g01_rank_fusion", f"""with {TOK_SQL}, {EMB_SQL}
select query_id, doc_id, round(sum(1.0::double / (60 + rank0)), 6) as rrf_score
from (select query_id, doc_id, rank0 from kw union all select query_id, doc_id, rank0 from vec) group by 1, 2""")
def g01(t):
    return R.fuse([keyword_list(t), vector_list(t)]).withColumn("rrf_score", F.round("rrf_score", 6))


FUSED_SQL = """
fused as (
  select query_id, doc_id, round(sum(1.0::double / (60 + rank0)), 9) as rrf
  from (select query_id, doc_id, rank0 from kw union all select query_id, doc_id, rank0 from vec) group by 1, 2),
alive as (
  select f.*, t.source, t.effective_trust from fused f join documents using (doc_id) join trusted t using (source)
  where not is_stale)
"""
HYBRID_COLS = ("query_id", "doc_id", "source")


@query("i04_hybrid_search", f"""with {TOK_SQL}, {EMB_SQL}, {SRC_SQL}, {FUSED_SQL}
select query_id, doc_id, source, round(effective_trust, 6) as trust_score, round(rrf, 6) as rrf_score, position from (
  select *, row_number() over (partition by query_id order by rrf desc, doc_id) - 1 as position from alive)
where position < 5""")
def i04(t):
    got = R.hybrid_search(keyword_list(t), vector_list(t), t.documents, doc_sources(t))
    return got.select(*HYBRID_COLS, F.round("effective_trust", 6).alias("trust_score"),
                      F.round("rrf_score", 6).alias("rrf_score"), F.col("position").cast("bigint").alias("position"))


@query("i03_vector_only_search", f"""with {EMB_SQL}, {SRC_SQL}
select query_id, doc_id, source, round(1.0::double / (60 + position), 6) as rrf_score, position from (
  select v.query_id, v.doc_id, t.source,
         row_number() over (partition by query_id order by similarity desc, v.doc_id) - 1 as position
  from vec v join documents d on d.doc_id = v.doc_id join trusted t on t.source = d.source where not is_stale)
where position < 5""")
def i03(t):
    got = R.vector_search(vector_list(t), t.documents, doc_sources(t))
    return got.select(*HYBRID_COLS, F.round("rrf_score", 6).alias("rrf_score"),
                      F.col("position").cast("bigint").alias("position"))


@query("i05_keyword_only_search", f"""with {TOK_SQL}, {SRC_SQL}
select query_id, doc_id, source, round(effective_trust, 6) as trust_score, position from (
  select k.query_id, k.doc_id, t.source, t.effective_trust,
         row_number() over (partition by query_id order by score desc, k.doc_id) - 1 as position
  from kw k join documents d on d.doc_id = k.doc_id join trusted t on t.source = d.source where not is_stale)
where position < 5""")
def i05(t):
    got = R.keyword_search(keyword_list(t), t.documents, doc_sources(t))
    return got.select(*HYBRID_COLS, F.round("effective_trust", 6).alias("trust_score"),
                      F.col("position").cast("bigint").alias("position"))


@query("i06_feature_hash_embedding", f"""with {EMB_SQL}
select id as doc_id, i, x from sparse where kind = 0 and x <> 0""")
def i06(t):
    emb = R.feature_hash_embedding(t.documents, "doc_id", "text")
    return emb.select("doc_id", F.posexplode("embedding").alias("i", "x")).where(F.col("x") != 0)


@query("f01_rerank_topk", f"""with {TOK_SQL}, {EMB_SQL}, {SRC_SQL}, {FUSED_SQL},
scored as (
  select a.query_id, a.doc_id, row_number() over (partition by a.query_id order by rrf desc, a.doc_id) - 1 as prior,
         count(*) over (partition by a.query_id) as n, -abs(d.n_chars - b.len)::double as rerank_score
  from alive a join documents d using (doc_id)
  join (select item_id as query_id, length(text) as len from benchmark) b using (query_id)
  qualify prior < 20),
capped as (select *, count(*) over (partition by query_id) as m from scored)
select query_id, doc_id, position from (
  select *, row_number() over (partition by query_id
    order by case when m <= 5 then prior::double else -rerank_score end, prior, doc_id) - 1 as position from capped)
where position < 5""")
def f01(t):
    found = R.hybrid_search(keyword_list(t), vector_list(t), t.documents, doc_sources(t), top=R.fetch_size())
    lens = t.documents.select("doc_id", "n_chars")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.length("text").alias("len"))
    pairs = found.join(lens, "doc_id").join(asked, "query_id").withColumnRenamed("position", "prior")
    got = R.rerank(pairs, score=-F.abs(F.col("n_chars") - F.col("len")).cast("double"), prior="prior")
    return got.select("query_id", "doc_id", F.col("position").cast("bigint").alias("position"))


def careless(queries, contents):
    """A user's scorer, nearer lengths first, that fails for some queries in each of the ways it can."""
    kind = len(queries[0]) % 4
    if kind == 1:
        raise RuntimeError("no model")
    scores = [-abs(len(c) - len(q)) for q, c in zip(queries, contents, strict=True)]
    return scores[1:] if kind == 2 else [None, *scores[1:]] if kind == 3 else scores


@query("f01_rerank_by_function", f"""with {TOK_SQL}, {EMB_SQL}, {SRC_SQL}, {FUSED_SQL},
scored as (
  select a.query_id, a.doc_id, row_number() over (partition by a.query_id order by rrf desc, a.doc_id) - 1 as prior,
         b.len % 4 as kind, -abs(length(d.text) - b.len)::double as rerank_score
  from alive a join documents d using (doc_id)
  join (select item_id as query_id, length(text) as len from benchmark) b using (query_id)
  qualify prior < 20),
capped as (select *, count(*) over (partition by query_id) as m from scored)
select query_id, doc_id, position from (
  select *, row_number() over (partition by query_id
    order by case when m <= 5 or kind > 0 then prior::double else -rerank_score end, prior, doc_id) - 1 as position from capped)
where position < 5""")
def f01_function(t):
    found = R.hybrid_search(keyword_list(t), vector_list(t), t.documents, doc_sources(t), top=R.fetch_size())
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    pairs = found.select("query_id", "doc_id", F.col("position").alias("prior")).join(t.documents.select("doc_id", F.col("text").alias("content")), "doc_id").join(asked, "query_id")
    got = R.rerank_with(pairs, careless, query_text="query_text", content="content", prior="prior", batch=32)
    return got.select("query_id", "doc_id", F.col("position").cast("bigint").alias("position"))


@query("i06_embedding_by_function", "select doc_id, [length(text)::float, (length(text) - length(replace(text, ' ', '')))::float] as embedding from documents")
def i06_function(t):
    def embed(texts):
        return [[float(len(x)), float(x.count(" "))] for x in texts]

    return R.embed_batches(t.documents.select("doc_id", "text"), "text", embed).select("doc_id", "embedding")


# Each benchmark text is asked as it is, and once more as a query without words.
@query("i04_search_routing", f"""with {TOK_SQL}, {EMB_SQL}, {SRC_SQL}, {FUSED_SQL},
only_vec as (
  select 1000000 + v.query_id as query_id, v.doc_id, t.source,
         row_number() over (partition by v.query_id order by similarity desc, v.doc_id) - 1 as position
  from vec v join documents d on d.doc_id = v.doc_id join trusted t on t.source = d.source where not is_stale)
select query_id, doc_id, source, round(rrf, 6) as rrf_score, position from (
  select *, row_number() over (partition by query_id order by rrf desc, doc_id) - 1 as position from alive) where position < 5
union all select query_id, doc_id, source, round(1.0::double / (60 + position), 6), position from only_vec where position < 5""")
def i04_routing(t):
    vectors = R.feature_hash_embedding(t.benchmark, "item_id", "text")
    worded = t.benchmark.select("item_id", "text").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("query_embedding"))
    blank = worded.withColumn("query_id", F.col("query_id") + 1000000).withColumn("text", F.lit(" \n "))
    unasked = worded.withColumn("query_id", F.col("query_id") + 2000000).withColumn("query_embedding", F.array().cast("array<double>"))
    near = vector_list(t)
    found = R.search(worded.unionByName(blank).unionByName(unasked), keyword_list(t),
                     near.unionByName(near.withColumn("query_id", F.col("query_id") + 1000000)), t.documents, doc_sources(t))
    return found.select(*HYBRID_COLS, F.round("rrf_score", 6).alias("rrf_score"), F.col("position").cast("bigint").alias("position"))


@query("f02_overfetch", f"""with {TOK_SQL}
select query_id, count(*) as fetched, sum(case when rank0 < 5 then 1 else 0 end)::bigint as kept from kw group by 1""")
def f02(t):
    ranked = keyword_list(t, R.fetch_size())
    return ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("rank0") < 5).alias("kept"))


@query("d04_effective_trust", f"""with {SRC_SQL}
select source, n_docs, round(trust_score, 6) as trust_score, round(effective_trust, 6) as effective_trust from trusted""")
def d04(t):
    return doc_sources(t).select("source", "n_docs", F.round("trust_score", 6).alias("trust_score"),
                                 F.round("effective_trust", 6).alias("effective_trust"))


@query("f09_trust_event_history", """
select 'src' || (user_id % 20) as source, event_id, event_type,
       case event_type when 'error' then -0.1::double when 'purchase' then 0.05::double else 0::double end as delta, ts as created_at
from events order by 1, ts, event_id""")
def f09(t):
    return TR.event_history(trust_events(t))
