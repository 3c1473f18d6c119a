"""Filters, merges, look-ups and table statistics on the test tables."""

from pyspark.sql import functions as F

from tidewell.catalog.registry import query
from tidewell.functions import fixed
from tidewell.functions import text as X
from tidewell.operators import evals as EV
from tidewell.operators import tables as TB
from tidewell.plans import merge as M
from tidewell.plans import snapshots as S
from tidewell.session import fresh_path
from tidewell.sources import reports as RP


def catalog_items(t):
    """Parts as catalog items."""
    return t.part.select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("slot"),
        F.col("p_size").alias("level"), F.ceil(F.col("p_size") / 10).alias("phase"), F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"))


@query("a10_upsert_last_write_wins", """
with v as (select user_id, event_type, event_id, ts, value from events)
select user_id, event_type, event_id, ts, value from v
qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1""")
def a10(t):
    v = t.events.select("user_id", "event_type", "event_id", "ts", "value")
    return M.last_write_wins(v, ["user_id", "event_type"], F.struct("event_id"))


@query("a10_upsert_two_batches", """
with old as (select user_id, min(event_id) as event_id, 'old' as origin from events where event_type = 'signup' group by 1),
new as (select user_id, max(event_id) as event_id, 'new' as origin from events where event_type = 'purchase' group by 1)
select coalesce(n.user_id, o.user_id) as user_id, coalesce(n.event_id, o.event_id) as event_id, coalesce(n.origin, o.origin) as origin
from old o full join new n on o.user_id = n.user_id""")
def a10b(t):
    old = t.events.where(F.col("event_type") == "signup").groupBy("user_id").agg(
        F.min("event_id").alias("event_id")).withColumn("origin", F.lit("old"))
    new = t.events.where(F.col("event_type") == "purchase").select("user_id", "event_id").withColumn("origin", F.lit("new"))
    return M.upsert(old, new, ["user_id"], "event_id")


@query("a11_insert_if_absent", """
with old as (select user_id, min(event_id) as event_id from events where event_type = 'signup' and value < 20 group by 1),
fresh as (select user_id, min(event_id) as event_id from events where event_type <> 'signup'
          and user_id not in (select user_id from old) group by 1)
select * from old union all select * from fresh""")
def a11(t):
    old = t.events.where((F.col("event_type") == "signup") & (F.col("value") < 20)).groupBy("user_id").agg(
        F.min("event_id").alias("event_id"))
    return M.insert_absent(old, t.events.where(F.col("event_type") != "signup").select("user_id", "event_id"),
                           ["user_id"], "event_id")


@query("a12_coalesce_update", """
select p.p_partkey, coalesce(nullif(case when p.p_size > 25 then p.p_brand else '' end, ''), p.p_name) as p_name,
       coalesce(case when p.p_size < 10 then p.p_size * 2 end, p.p_size) as p_size from part p""")
def a12(t):
    new = t.part.select(
        "p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("p_name"),
        F.when(F.col("p_size") < 10, F.col("p_size") * 2).alias("p_size"))
    return TB.coalesce_update(t.part.select("p_partkey", "p_name", "p_size"), new, ["p_partkey"], ["p_name", "p_size"])


@query("a13_cascade_delete", """
select l_orderkey, l_linenumber, l_partkey from lineitem
where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'P')""")
def a13(t):
    kept = t.orders.where(F.col("o_orderstatus") != "P")
    return TB.cascade_delete(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), kept, "l_orderkey", "o_orderkey")


@query("a13_set_null_on_delete", """
select l_orderkey, l_linenumber, l_partkey,
       case when l_suppkey in (select s_suppkey from supplier where s_acctbal > 0) then l_suppkey end as l_suppkey from lineitem""")
def a13b(t):
    return TB.set_null_delete(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
                              t.supplier.where(F.col("s_acctbal") > 0), "l_suppkey", "s_suppkey")


ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
              "benchmark", "labels", "conversations"]
# A figure of each table that changes with its content, in both engines alike.
CONTENT = {
    "region": "sum(length(r_name))", "nation": "sum(n_regionkey * n_nationkey)", "customer": "sum(c_custkey * length(c_mktsegment))",
    "supplier": "sum(s_suppkey * s_nationkey)", "part": "sum(p_partkey * p_size)", "orders": "sum(o_orderkey * length(o_orderpriority))",
    "lineitem": "sum(l_orderkey * l_linenumber)", "events": "sum(event_id * length(event_type))", "documents": "sum(doc_id * length(text))",
    "embeddings": "sum(vec_id * label)", "pages": "sum(page_id * length(html))", "benchmark": "sum(item_id * length(text))",
    "labels": "sum(doc_id * (1 + quality))", "conversations": "sum(turn * length(text))",
}


@query("a14_backup_fingerprints", " union all ".join(
    f"select '{n}' as table_name, count(*) as n_rows, count(*) as copy_rows, true as intact, ({CONTENT[n]})::bigint as content from {n}" for n in ALL_TABLES))
def a14(t):
    """All tables backed up and verified by count and checksum; counts and content of the copies."""
    root = fresh_path(t.spark, "backups")
    tables = {n: getattr(t, n) for n in ALL_TABLES}
    S.create_backup(tables, root, "now")
    out = None
    for n in ALL_TABLES:
        copy = t.spark.read.parquet(f"{root}/now/{n}").agg(F.expr(f"cast({CONTENT[n]} as bigint)").alias("content")).withColumn("table_name", F.lit(n))
        out = copy if out is None else out.unionByName(copy)
    return S.verify_backup(tables, root, "now").join(out, "table_name")


@query("b01_source_list_filter", """
select p_partkey, p_name from part where p_size <> 50 and p_size <= 30 and p_type = 'ECONOMY' and p_brand = 'Brand#2'""")
def b01(t):
    src = t.part.select("p_partkey", "p_name", (F.col("p_size") != 50).alias("enabled"),
                        F.ceil(F.col("p_size") / 15).alias("priority"), F.col("p_type").alias("category"),
                        F.col("p_brand").alias("spec"))
    return TB.filter_sources(src, max_priority=2, category="ECONOMY", spec="Brand#2").select("p_partkey", "p_name")


@query("b02_article_list", """
select 'a' || o_orderkey as path, o_orderstatus as status, o_orderpriority as spec, o_orderdate as updated_at
from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW' order by o_orderdate desc, path""")
def b02(t):
    art = t.orders.select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("path"),
                          F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("spec"),
                          F.col("o_orderdate").alias("updated_at"))
    return TB.list_articles(art, status="F", spec="5-LOW")


@query("b03_title_search", """
select p_partkey, p_name as title from part where contains(lower(p_name), 'ring') and p_type = 'SMALL'""")
def b03(t):
    art = t.part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("status"))
    return TB.search_titles(art, "RING", status="SMALL", known_status=["SMALL", "LARGE"]).select("p_partkey", "title")


@query("b04_items_for_slot", """
select p_partkey as item_id, p_size as level from part where p_brand = 'Brand#2' and ceil(p_size / 10.0) <= 3 and p_size >= 10
order by p_size desc, p_partkey""")
def b04(t):
    return TB.items_for_slot(catalog_items(t), "Brand#2", max_phase=3, min_level=10).select("item_id", "level")


@query("b05_item_search", """
select p_partkey as item_id, p_brand as slot from part where contains(lower(p_name), 'ring') and p_brand = 'Brand#2'""")
def b05(t):
    return TB.search_items(catalog_items(t), "Ring", "Brand#2").select("item_id", "slot")


@query("b05_item_search_fallback", """
with hits as (select * from part where contains(lower(p_name), 'red w'))
select p_partkey as item_id, p_brand as slot from hits
where p_brand = 'no such brand' or not exists (select 1 from hits where p_brand = 'no such brand')""")
def b05b(t):
    return TB.search_items(catalog_items(t), "red w", "no such brand").select("item_id", "slot")


@query("b08_clear_stale_flag", """
select p_partkey, p_size > 25 and p_type <> 'PROMO' as is_stale from part""")
def b08(t):
    from tidewell.operators import trust as TR
    src = t.part.select("p_partkey", (F.col("p_size") > 25).alias("is_stale"))
    return TR.clear_stale(src, t.part.where(F.col("p_type") == "PROMO"), "p_partkey")


@query("b08_stale_list", "select p_partkey from part where p_size > 25")
def b08b(t):
    from tidewell.operators import trust as TR
    return TR.stale_list(t.part.select("p_partkey", (F.col("p_size") > 25).alias("is_stale"))).select("p_partkey")


@query("b10_relation_type_filter", """
select l_orderkey, l_linenumber, l_returnflag as relation_type from lineitem where l_returnflag in ('A', 'R')""")
def b10(t):
    e = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("relation_type"))
    return TB.filter_relations(e, ["A", "R", "no_such_type"], ["A", "N", "R"])


@query("b12_encounter_filter", "select conv_id, turn from conversations where role = 'assistant'")
def b12(t):
    return EV.of_tier(t.conversations.withColumnRenamed("role", "tier"), "assistant").select("conv_id", "turn")


@query("b12_encounter_of_zone", "select o_custkey as encounter_id, o_orderkey from orders where o_custkey = 7")
def b12_encounter(t):
    return RP.of_encounter(t.orders.select(F.col("o_custkey").alias("encounter_id"), "o_orderkey"), 7)


@query("b13_player_name_validity", """
select c_custkey, regexp_matches(replace(c_name, '#', case when c_custkey % 2 = 0 then '-' else '#' end), '^[\\p{L}\\p{N}\\-'']+$') as valid
from customer""")
def b13(t):
    name = F.replace(F.col("c_name"), F.lit("#"), F.when(F.col("c_custkey") % 2 == 0, "-").otherwise("#"))
    return t.customer.select("c_custkey", X.valid_player_name(name).alias("valid"))


@query("c05_unprocessed_rows", """
select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_orderkey is not null)""")
def c05(t):
    return TB.unprocessed(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey")


@query("c15_new_reports", """
select distinct o_custkey as char_id, o_orderdate as report from orders where (o_custkey, o_orderdate) not in (
  select (o_custkey, o_orderdate) from orders where o_orderstatus = 'F')""")
def c15(t):
    rep = t.orders.select(F.col("o_custkey").alias("char_id"), F.col("o_orderdate").alias("report"), "o_orderstatus")
    return TB.new_reports(rep, rep.where(F.col("o_orderstatus") == "F"), ["char_id", "report"])


@query("d02_table_statistics", " union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in ALL_TABLES))
def d02(t):
    return TB.table_counts({n: getattr(t, n) for n in ALL_TABLES})


@query("d03_type_distribution", """
select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1 order by n desc, r_name""")
def d03(t):
    return TB.type_distribution(t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, "r_regionkey", "r_name")


@query("d16_group_coverage", "select lang, count(*) as n from documents group by 1")
def d16(t):
    return TB.group_coverage(t.documents, "lang")


@query("g02_distinct_report_union", """
select distinct 'r' || o_custkey as report_code from orders where o_orderstatus <> 'P'""")
def g02(t):
    """The report codes of all rankings of all encounters; rankings without one have an empty code."""
    code = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("r"), F.col("o_custkey").cast("string"))).otherwise("")
    return RP.report_codes(t.orders.select(F.col("o_orderpriority").alias("encounter_name"), code.alias("report_code")))


# --- scalar functions on whole columns ---------------------------------------
NORM = r"regexp_replace(regexp_replace(regexp_replace(lower({x}), '^\s+|\s+$', '', 'g'), '^(the|a|an)\s+', ''), '\s+', ' ', 'g')"


ALIAS_ROWS = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in fixed.ALIASES.items())


@query("h01_normalize_name", f"select line_id, {NORM.format(x='line')} as name from (select doc_id || ':' || i as line_id, line from "
       "(select doc_id, unnest(string_split(text, '.')) as line, unnest(range(len(string_split(text, '.')))) as i from documents))")
def h01(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("i", "line"))
    return lines.select(F.concat_ws(":", "doc_id", "i").alias("line_id"), X.normalize_name("line").alias("name"))


@query("h02_resolve_canonical", f"""
with w as (select doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) as word from documents),
n as (select doc_id, word, {NORM.format(x='word')} as name from w)
select doc_id, word, coalesce(a.target, name) as canonical
from n left join (values {ALIAS_ROWS}) a(short, target) on a.short = name where word <> ''""")
def h02(t):
    w = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"))
    return w.where(F.col("word") != "").select("doc_id", "word", X.resolve_canonical("word").alias("canonical"))


@query("h03_slug_paths", """
select p_partkey, p_brand || '/' || p_type || '/' ||
  regexp_replace(regexp_replace(replace(lower(p_name || ' ' || p_brand), '''', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.md' as path
from part""")
def h03(t):
    return t.part.select("p_partkey", X.derive_path("p_brand", "p_type", F.concat_ws(" ", "p_name", "p_brand")).alias("path"))


@query("h04_check_interval", """
with h as (select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), '^www\\.', '') as host from pages)
select page_id, case host when 'spam-farm.example.org' then 720 else 168 end as hours from h""")
def h04(t):
    return t.pages.select("page_id", X.check_interval("url", {"spam-farm.example.org": 720}).alias("hours"))


@query("h05_token_estimate", "select doc_id, length(text) // 4 as tokens from documents")
def h05(t):
    return t.documents.select("doc_id", X.token_estimate("text").alias("tokens"))


@query("h06_content_hash", """
select doc_id, case when regexp_matches(text, '\\S') then sha256(text) else '' end as content_hash from documents""")
def h06(t):
    return t.documents.select("doc_id", X.content_hash("text").alias("content_hash"))


@query("h10_display_name", """
select distinct replace(p_name, ' ', '_') as ability, array_to_string(list_transform(string_split(p_name, ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') as display from part""")
def h10(t):
    return t.part.select(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("ability")).distinct().select(
        "ability", X.display_name("ability").alias("display"))


@query("h13_number_before_unit", """
select doc_id, try_cast(replace(regexp_extract(text, '(?i)(\\d[\\d,]*\\.?\\d*)\\s*d', 1), ',', '') as double) as found from documents""")
def h13(t):
    return t.documents.select("doc_id", X.number_before("text", "d").alias("found"))


@query("h13_first_matching_pattern", """
select conv_id, turn, coalesce(
  try_cast(regexp_extract(text, '(\\d+(?:\\.\\d+)?)@', 1) as double), try_cast(regexp_extract(text, '(\\d+(?:\\.\\d+)?)', 1) as double)) as found
from conversations""")
def h13b(t):
    return t.conversations.select("conv_id", "turn", X.first_number(
        "text", [r"(\d+(?:\.\d+)?)@", r"(\d+(?:\.\d+)?)"]).alias("found"))


@query("h18_quoted_fields", """
select p_partkey, 4 as n_fields, p_name || ', ' || p_brand as second, p_size::varchar as last from part""")
def h18(t):
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), "p_name", F.lit(", "), "p_brand", F.lit('", '), "p_type",
                    F.lit(" ,"), F.col("p_size").cast("string"), F.lit(","))
    f = t.part.select("p_partkey", X.quoted_fields(line).alias("f"))
    return f.select("p_partkey", F.size("f").alias("n_fields"), F.get("f", F.lit(1)).alias("second"),
                    F.element_at("f", -1).alias("last"))


@query("h17_log_time", """
select event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 + (extract('milliseconds' from ts)::bigint % 1000) as ms from events""")
def h17(t):
    stamp = F.date_format("ts", "M/d HH:mm:ss.SSS")
    return t.events.select("event_id", X.log_time_ms(stamp).alias("ms"))


@query("h19_safe_int", """
select event_id, coalesce(try_cast(case when event_type = 'error' then 'x1' else split_part(value::varchar, '.', 1) end as bigint), 0) as amount from events""")
def h19(t):
    raw = F.when(F.col("event_type") == "error", "x1").otherwise(F.split(F.col("value").cast("string"), r"\.")[0])
    return t.events.select("event_id", X.safe_int(F.array(F.lit("pad"), raw), 1).alias("amount"))


@query("h20_talent_strings", """
select p_partkey, case when p_size + p_partkey % 30 + 3 <= 61 then p_size end as first_tree,
  case when p_partkey % 30 < 2 then 'assassination_mutilate' else 'combat_swords' end as spec from part""")
def h20(t):
    s = F.concat_ws("/", F.col("p_size"), F.col("p_partkey") % 30, F.lit(3))
    digits = F.concat(F.lit("11"), F.lit("-"), F.when(F.col("p_partkey") % 30 < 2, "1").otherwise("0302"))
    return t.part.select("p_partkey", F.get(X.talent_totals(s), F.lit(0)).alias("first_tree"),
                         X.spec_from_digits(digits).alias("spec"))


@query("h21_text_clip", """
select doc_id, case when length(text) > 2000 then left(text, 1000) || chr(10) || chr(10) || '[... truncated ...]' || chr(10) || chr(10) || right(text, 1000)
  else text end as clipped from documents""")
def h21(t):
    return t.documents.select("doc_id", X.clip_middle("text").alias("clipped"))


@query("h23_json_round_trip", """
select event_id, json_extract(props, '$.k')::bigint as k, '{"k":' || json_extract(props, '$.k') || '}' as encoded from events""")
def h23(t):
    parsed = F.from_json("props", "k bigint")
    return t.events.select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("encoded"))


@query("h24_embedding_prompts", """
select doc_id as id, 'search_document: ' || text as prompt from documents
union all select item_id, 'search_query: ' || text from benchmark""")
def h24(t):
    return t.documents.select(F.col("doc_id").alias("id"), X.document_prompt("text").alias("prompt")).unionByName(
        t.benchmark.select(F.col("item_id").alias("id"), X.query_prompt("text").alias("prompt")))
