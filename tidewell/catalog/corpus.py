"""Pages, ingest, freshness and report parsing on the test tables."""

from pyspark.sql import functions as F

from tidewell.catalog.registry import once, query
from tidewell.functions import scoring as SC
from tidewell.functions.text import check_interval, content_hash, is_blank, lookup
from tidewell.operators import ingest as I
from tidewell.operators import library as L
from tidewell.operators import tables as TB
from tidewell.operators import trust as TR
from tidewell.plans.blocked import seq_block
from tidewell.plans.segments import Segments
from tidewell.session import fresh_path, materialize
from tidewell.sources import articles as AR
from tidewell.sources import characters as CH
from tidewell.sources import exports as EX
from tidewell.sources import pages as P
from tidewell.sources import reports as RP

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# --- source lists and pages --------------------------------------------------
@query("a01_source_list_scan", """
select regexp_replace(url, '^http:', case when page_id % 5 = 0 then 'ftp:' else 'http:' end) as url, 'guide' as source_type,
  case when page_id % 2 = 0 then 'forum' else 'general' end as category, case when page_id % 3 = 0 then 2 else page_id::int % 5 end as priority, true as enabled,
  case when page_id % 5 = 0 and url like 'http:%' then 'bad url' when page_id % 3 <> 0 and page_id % 5 not between 1 and 3 then 'bad priority' end as reject_reason
from pages""")
def a01(t):
    """Pages written as JSON source lists of both forms and scanned back."""
    url = F.regexp_replace("url", "^http:", F.when(F.col("page_id") % 5 == 0, F.lit("ftp:")).otherwise(F.lit("http:")))
    entry = F.struct(url.alias("url"), F.lit("t").alias("title"), F.when(F.col("page_id") % 2 == 0, "forum").alias("category"),
                     F.when(F.col("page_id") % 3 != 0, (F.col("page_id") % 5).cast("int")).alias("priority"))
    as_list, as_object = F.to_json(F.array(entry)), F.to_json(F.struct(F.array(entry).alias("sources")))
    raw = t.pages.select(F.when(F.col("page_id") % 2 == 0, as_list).otherwise(as_object).alias("value"))
    got = P.check_entries(P.source_entries(raw, "value"))
    return got.select("url", "source_type", "category", "priority", "enabled", "reject_reason")


@query("a02_page_acceptance", """
select page_id, case when page_id % 11 = 0 then 'bad status' when page_id % 7 = 0 then 'not html' when octet_length(encode(html)) > 20000 then 'too large' end as reject_reason
from pages""")
def a02(t):
    r = t.pages.select("page_id", "html", F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"),
                       F.lit(None).cast("bigint").alias("content_length"),
                       F.when(F.col("page_id") % 7 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"))
    return P.check_pages(r, 20000).select("page_id", "reject_reason")


RX = P.SKIPPED
DROP = "(?is)<!--.*?-->|" + "|".join(rf"<{x}\b.*?</{x}\s*>" for x in RX)
TEXT_SQL = f"""
s1 as (select page_id, regexp_replace(html, '{DROP}', ' ', 'g') as x from pages),
s2 as (select page_id, case when regexp_extract(x, '(?is)<(?:article|main)\\b[^>]*>(.*)</(?:article|main)\\s*>', 1) <> ''
  then regexp_extract(x, '(?is)<(?:article|main)\\b[^>]*>(.*)</(?:article|main)\\s*>', 1) else x end as x from s1),
s3 as (select page_id, regexp_replace(x, '\\s+', ' ', 'g') as x from s2),
s4 as (select page_id, regexp_replace(regexp_replace(regexp_replace(x, '(?i)<h1\\b[^>]*>', chr(10) || chr(10) || '# ', 'g'),
  '(?i)<h2\\b[^>]*>', chr(10) || chr(10) || '## ', 'g'), '(?i)<h3\\b[^>]*>', chr(10) || chr(10) || '### ', 'g') as x from s3),
s5 as (select page_id, regexp_replace(regexp_replace(x, '(?i)</?(?:p|div|section|article|blockquote|pre|table|ul|ol|dl|h[1-6])\\b[^>]*>', chr(10) || chr(10), 'g'),
  '(?i)<(?:br|li|tr|dt|dd|hr)\\b[^>]*>', chr(10), 'g') as x from s4),
s6 as (select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[a-zA-Z/!?][^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as x from s5),
txt as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'),
  '^\\s+|\\s+$', '', 'g') as text from s6)
"""


@query("a03_html_main_text", f"with {TEXT_SQL} select page_id, text, case when text = '' then 'Empty extraction' end as error from txt")
def a03(t):
    return P.extract_pages(t.pages).select("page_id", "text", "error")


@query("a04_title_resolution", """
select page_id, coalesce(nullif(case when page_id % 9 = 0 then 'given' else '' end, ''), nullif(trim(regexp_replace(
  replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')), ''),
  regexp_extract(url, '://([^/?#]*)', 1)) as title from pages""")
def a04(t):
    given = F.when(F.col("page_id") % 9 == 0, "given").otherwise("")
    return t.pages.select("page_id", P.page_title(given, "html", "url").alias("title"))


# --- chunks ------------------------------------------------------------------
def chunk_sql(rows: str) -> str:
    """CTEs that end in ``chunks`` (key, chunk_index, content), from a query of (key, text).

    Level by level a text is cut, parts are joined again while they fit, and what is too long goes
    on to the next level; see the comments at each step. 400 tokens are 1600 signs, and a text
    fits below 1604.
    """
    # What is cut, what each later part begins with, and what joins parts again.
    levels = (("chr(10) || '## '", "'## '", "chr(10)"), ("chr(10) || '### '", "'### '", "chr(10)"), ("chr(10) || chr(10)", "''", "chr(10) || chr(10)"),
              ("chr(10)", "''", "chr(10)"), (None, "''", "' '"), ("' '", "''", "' '"))
    out = [f"lev0 as (select key, []::int[] as path, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text, true as more from ({rows}) where text is not null)"]
    for n, (cut, prefix, joiner) in enumerate(levels):
        split = f"string_split(text, {cut})" if cut else "string_split(replace(text, '. ', '.' || chr(1)), chr(1))"
        # Headings cut any text, the others only those that are too long; blank parts go.
        active = "more" if n < 2 else "more and length(text) >= 1604"
        out.append(f"""cut{n} as (select key, path, text, more, length(text) < 1604 as fits, case when {active} then list_filter(list_transform({split},
            lambda p, i: case when i = 1 then p else {prefix} || p end), lambda p: regexp_matches(p, '\\S')) else [] end as parts from lev{n})""")
        # Parts of a long text are joined while they fit, and those that do are done.
        out.append(f"""kid{n} as (select key, path, more, fits, len(parts) <= 1 as same, case when len(parts) <= 1 then [text] when fits then parts else list_reduce(
            list_transform(parts, lambda p: [p]), lambda acc, x: case when length(acc[-1]) + length({joiner}) + length(x[1]) < 1604
            then list_append(acc[:-2], acc[-1] || {joiner} || x[1]) else list_append(acc, x[1]) end) end as kids from cut{n})""")
        out.append(f"""lev{n + 1} as (select key, list_append(path, i) as path, kids[i] as text, case when same then more when fits then true else length(kids[i]) >= 1604 end as more
            from (select *, unnest(range(1, len(kids) + 1))::int as i from kid{n}))""")
    out.append("""hard as (select key, path, unnest(case when length(text) < 1604 then [text]
        else list_transform(range((length(text) + 1599) // 1600), lambda i: substr(text, i * 1600 + 1, 1600)) end) as text,
        unnest(range(case when length(text) < 1604 then 1 else (length(text) + 1599) // 1600 end)) as i from lev6),
    bare as (select key, list(x order by path, i) as xs from (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as x from hard) where x <> '' group by key),
    met as (select key, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: case when length(acc[-1]) < 200
        then list_append(acc[:-2], acc[-1] || chr(10) || chr(10) || x[1]) else list_append(acc, x[1]) end) as xs from bare),
    led as (select key, list_filter(list_transform(xs, lambda x, i: regexp_replace(case when i = 1 then x
        else regexp_replace(right(xs[i - 1], 200), '^[^ ]* ', '') || ' ' || x end, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as xs from met),
    chunks as (select key, unnest(range(len(xs)))::int as chunk_index, unnest(xs) as content from led)""")
    return ",\n".join(out)


@query("j01_chunk_texts", f"""with {chunk_sql("select doc_id as key, text from documents")}
select key as doc_id, chunk_index, content, length(content)::int as char_count, length(content) // 4 as token_estimate from chunks""")
def j01(t):
    return I.chunk_texts(t.documents, ["doc_id"], "text")


@query("j01_chunk_coverage", """
select doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) as digest, true as within_limit from documents where regexp_matches(text, '\\S')""")
def j01c(t):
    """Per document: all of its signs, in order, from chunks without overlap; and that no chunk is over the limit."""
    c = I.chunk_texts(t.documents, ["doc_id"], "text", overlap_tokens=0, min_tokens=0)
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))  # the chunks of one text
    whole = F.array_join(F.transform(rows, lambda r: r["content"]), "")
    return c.groupBy("doc_id").agg(
        F.md5(F.regexp_replace(whole, r"\s+", "").cast("binary")).alias("digest"), F.bool_and(F.col("char_count") < 1604).alias("within_limit"))


@query("j01_chunk_invariants", """
select doc_id, true as dense, true as lengths_match, true as starts_with_text from documents where regexp_matches(text, '\\S')""")
def j01b(t):
    """Per document: dense indexes, lengths, and the first chunk begins the text."""
    c = I.chunk_texts(t.documents, ["doc_id"], "text").join(t.documents.select("doc_id", "text"), "doc_id")
    first = F.col("chunk_index") == 0
    return c.groupBy("doc_id").agg(
        ((F.min("chunk_index") == 0) & (F.max("chunk_index") == F.count(F.lit(1)) - 1)).alias("dense"),
        F.bool_and((F.length("content") == F.col("char_count")) & (F.floor(F.col("char_count") / 4) == F.col("token_estimate"))).alias("lengths_match"),
        F.bool_or(first & F.startswith(F.regexp_replace("text", r"\s+", " "),
                                       F.regexp_replace(F.left("content", F.lit(40)), r"\s+", " "))).alias("starts_with_text"))


def lines(t):
    """Lines of documents as pieces."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))


@query("e07_chunk_overlap", r"""
with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as seq, unnest(string_split(text, chr(10))) as line from documents),
p as (select *, lag(line) over (partition by doc_id order by seq) as prev from l)
select doc_id, seq::int as seq, case when prev is null then '' else regexp_replace(right(prev, 200), '^[^ ]* ', '') || ' ' end || line as with_overlap from p""")
def e07(t):
    return I.with_overlap(lines(t), "doc_id", "seq", "line", seq_block("seq")).select("doc_id", "seq", "with_overlap")


@query("d29_chunk_counts", f"""with {chunk_sql("select doc_id as key, text from documents")}
select source, count(chunk_index) as chunk_count from documents left join chunks on key = doc_id group by 1""")
def d29(t):
    chunks = I.chunk_texts(t.documents.select("doc_id", "source", "text"), ["doc_id", "source"], "text")
    return I.chunk_counts(t.documents.select("source").distinct(), chunks, "source")


# --- incremental ingest ------------------------------------------------------
def stored(t):
    """English documents as sources already ingested."""
    return as_stored(t.documents.where(F.col("lang") == "en"))


def as_stored(docs):
    return docs.select(
        F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.lit("old").alias("title"),
        F.lit("web").alias("source_type"), content_hash("text").alias("content_hash"), F.lit(None).cast("string").alias("content_hash_previous"),
        F.lit(2).alias("change_count"), (F.col("doc_id") % 2 == 0).alias("is_stale"), F.lit(0.4).alias("trust_score"),
        F.lit(99).alias("check_interval_hours"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
        F.timestamp_add("HOUR", (F.col("doc_id") % 300).cast("int"), F.lit("2024-01-15").cast("timestamp")).alias("last_checked"))


def arriving(t):
    """All documents arriving again, some changed, some blank."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text"))
    return t.documents.select(
        F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.lit("new").alias("title"),
        F.lit("guide").alias("source_type"), text.alias("text"))


DEC_SQL = """
a as (select doc_id, 'https://' || source || '/' || doc_id as url, case when doc_id % 5 = 0 then text || '!' when doc_id % 7 = 0 then '  ' else text end as text, text as old_text,
        lang = 'en' as known from documents),
h as (select *, case when regexp_matches(text, '\\S') then sha256(text) else '' end as new_hash,
        case when regexp_matches(old_text, '\\S') then sha256(old_text) else '' end as old_hash from a),
dec as (select *, case when not known then 'new' when old_hash = new_hash then 'unchanged' when not regexp_matches(text, '\\S') then 'refused' else 'replace' end as action from h)
"""


@query("j02_ingest_decision", f"with {DEC_SQL} select url, new_hash, action from dec")
def j02(t):
    return I.ingest_decision(arriving(t), stored(t)).select("url", "new_hash", "action")


@query("j02_sources_after_ingest", f"""with {DEC_SQL}
select url, case when action in ('new', 'replace') then 'new' else 'old' end as title, case when action in ('new', 'replace') then new_hash else old_hash end as content_hash,
  case when action = 'replace' then old_hash end as content_hash_previous, case action when 'new' then 0 when 'replace' then 3 else 2 end as change_count,
  case when action in ('new', 'replace') then false else doc_id % 2 = 0 end as is_stale, case when action = 'new' then 0.75::double else 0.4::double end as trust_score,
  case when action <> 'new' then 99 when url like 'https://src7/%' then 24 else 168 end as hours from dec""")
def j02b(t):
    s = stored(t)
    got = I.apply_ingest(I.ingest_decision(arriving(t), s), s, now(), {"src7": 24})
    return got.select("url", "title", "content_hash", "content_hash_previous", "change_count", "is_stale", "trust_score",
                      F.col("check_interval_hours").alias("hours"))


# Chunks as they are after the ingest: of the new text where it was taken, else of the one that is known.
AFTER_SQL = f"""{DEC_SQL},
taken as (select url, action, text as arrived, case when action in ('new', 'replace') then text else old_text end as text from dec),
{chunk_sql("select url as key, text from taken")},
counts as (select url, action, arrived, count(chunk_index) as n_chunks from taken left join chunks on key = url group by all)"""


@query("j02_chunks_after_ingest", f"with {AFTER_SQL} select key as url, chunk_index, md5(content) as digest from chunks")
def j02c(t):
    s = stored(t)
    dec = I.ingest_decision(arriving(t), s)
    url = F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url")
    old = I.chunk_texts(t.documents.where(F.col("lang") == "en").select(url, "text"), ["url"], "text")
    fresh = I.chunk_texts(I.changed_texts(dec), ["url"], "text")
    return I.replace_chunks(old, fresh, dec).select("url", "chunk_index", F.md5(F.col("content").cast("binary")).alias("digest"))


def english_pages(t):
    """English documents as they came first."""
    return t.documents.where(F.col("lang") == "en").select(
        F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.lit("old").alias("title"),
        F.lit("web").alias("source_type"), "text")


def two_ingests(t):
    """A library of the English documents, into which all documents come, some of them changed, and then once more."""
    def make():
        library = L.create_library(t.spark, fresh_path(t.spark, "library"), buckets=8)
        for version, pages in enumerate((english_pages(t), arriving(t), arriving(t)), 1):
            L.ingest_pages(library, pages, version, now())
        return library.root

    return L.Library(t.spark, once(t, "library", ["documents"], make))


@query("j02_library_chunks", f"with {AFTER_SQL} select key as url, chunk_index, md5(content) as digest from chunks")
def j02d(t):
    return two_ingests(t).chunks().select("url", "chunk_index", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("j02_library_sources", f"""with {AFTER_SQL}
select url, n_chunks as chunk_count, (action = 'replace')::int as change_count, action = 'replace' as had_other_text from counts""")
def j02e(t):
    return two_ingests(t).sources().select("url", "chunk_count", "change_count", F.col("content_hash_previous").isNotNull().alias("had_other_text"))


@query("d01_ingest_report", f"""with {AFTER_SQL}
select count(*) filter (ok and not existed) as succeeded, count(*) filter (not ok) as failed, count(*) filter (ok and existed) as skipped,
  coalesce(sum(n_chunks) filter (ok and not existed), 0)::bigint as total_chunks
from (select regexp_matches(arrived, '\\S') as ok, action in ('unchanged', 'refused') as existed, n_chunks from counts)""")
def d01(t):
    res = two_ingests(t).decisions(2).select(F.col("has_text").alias("ok"), F.col("action").isin("unchanged", "refused").alias("existed"), F.col("chunk_count").alias("n_chunks"))
    return TB.ingest_report(res)


@query("j03_exact_duplicates", "select sha256(text) as content_hash, min(doc_id) as kept_id, count(*) as copies from documents group by 1")
def j03(t):
    return I.exact_duplicates(t.documents, "doc_id", "text")


@query("j03_without_duplicates", "select min(doc_id) as doc_id from documents group by sha256(text)")
def j03b(t):
    return I.without_duplicates(t.documents, "doc_id", "text").select("doc_id")


# --- freshness ---------------------------------------------------------------
@query("b07_due_for_check", """
select 'https://' || source || '/' || doc_id as url from documents where
  (doc_id % 10 = 1 or date_diff('second', timestamp '2024-01-15' + to_hours((doc_id % 300)::int), timestamp '2024-02-01') / 3600.0 > 300)""")
def b07(t):
    s = as_stored(t.documents).withColumn("check_interval_hours", F.lit(300))
    ids = F.regexp_extract("url", r"/(\d+)$", 1).cast("bigint")
    s = s.withColumn("last_checked", F.when(ids % 10 != 1, F.col("last_checked")))
    return TR.due_for_check(s, now()).select("url")


def observed(t):
    i = F.col("doc_id")
    text = F.when(i % 5 == 0, F.concat("text", F.lit("!"))).when(i % 7 == 0, "  ").otherwise(F.col("text"))
    return t.documents.where(i % 19 != 0).select(
        F.concat(F.lit("https://"), "source", F.lit("/"), i.cast("string")).alias("url"), F.when(i % 17 == 0, "timed out").alias("fetch_error"), F.when(i % 13 == 0, 404).otherwise(200).alias("head_status"),
        F.when(i % 4 == 0, F.lit("2024-01-10").cast("timestamp")).alias("last_modified"), text.alias("text"))


FRESH_SQL = f"""{DEC_SQL},
fr as (select *, case when doc_id % 19 = 0 then 'unobserved' when doc_id % 17 = 0 then 'error' when doc_id % 13 = 0 then 'dead' when doc_id % 4 = 0 then 'fresh' when not regexp_matches(text, '\\S') then 'empty'
  when old_hash = new_hash then 'unchanged' else 'changed' end as outcome from dec)
"""


@query("j04_freshness_outcomes", f"""with {FRESH_SQL}
select url, outcome, case when outcome = 'fresh' then old_hash when outcome in ('unchanged', 'changed') then new_hash end as new_hash, outcome in ('dead', 'fresh') as head_only,
  case outcome when 'error' then 'timed out' when 'dead' then 'Source returned HTTP 404' when 'empty' then 'Content extraction returned empty' end as error from fr""")
def j04(t):
    return TR.freshness_outcome(as_stored(t.documents), observed(t)).select("url", "outcome", "new_hash", "head_only", "error")


@query("j04_sources_after_sweep", f"""with {FRESH_SQL}
select url, case when outcome = 'changed' then new_hash else old_hash end as content_hash, case when outcome = 'changed' then old_hash end as content_hash_previous,
  2 + (outcome = 'changed')::int as change_count, doc_id % 2 = 0 or outcome = 'changed' as is_stale,
  outcome not in ('unobserved', 'error') as checked_now from fr""")
def j04b(t):
    s = as_stored(t.documents)
    got = TR.apply_freshness(TR.freshness_outcome(s, observed(t)), s.columns, now())
    return got.select("url", "content_hash", "content_hash_previous", "change_count", "is_stale", (F.col("last_checked") == now()).alias("checked_now"))


@query("j04_dead_url_events", f"""with {FRESH_SQL}
select url, 'dead_url' as event_type, -0.6::double as delta, 'HTTP 404 for ' || url as details from fr where outcome = 'dead'""")
def j04c(t):
    return TR.dead_url_events(TR.freshness_outcome(as_stored(t.documents), observed(t)), now()).select("url", "event_type", "delta", "details")


@query("d17_freshness_summary", f"""with {FRESH_SQL}
select count(*) filter (outcome <> 'unobserved') as checked, count(*) filter (outcome = 'changed') as changed, count(*) filter (outcome in ('dead', 'empty', 'error')) as errors from fr""")
def d17(t):
    return TR.freshness_summary(TR.freshness_outcome(as_stored(t.documents), observed(t)))


@query("c16_stale_source_counts", """
with links as (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))) as url from pages),
src as (select regexp_extract(text, '^(\\S+)', 1) as url, bool_or(lang <> 'en') as is_stale from documents group by 1)
select p.page_id, count(s.url) as n_stale from pages p left join links l on l.page_id = p.page_id left join src s on s.url = l.url and s.is_stale group by 1""")
def c16(t):
    links = t.pages.select("page_id", F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1).alias("urls"))
    sources = t.documents.groupBy(F.regexp_extract("text", r"^(\S+)", 1).alias("url")).agg(
        F.bool_or(F.col("lang") != "en").alias("is_stale"))
    return TR.stale_count_for_urls(links, sources, "page_id", "urls")


@query("h08_aged_trust", """
select event_id, round(case when date_diff('microsecond', ts, timestamp '2024-02-01') / 86400000000.0 <= 10 then 0.9
  else 0.9 * pow(0.5, (date_diff('microsecond', ts, timestamp '2024-02-01') / 86400000000.0 - 10) / 10) end, 6)::double as trust from events""")
def h08(t):
    return t.events.select("event_id", F.round(SC.aged_trust(F.lit(0.9), SC.age_days("ts", now()), 10, 0.5), 6).alias("trust"))


@query("h09_base_trust", """
select p_partkey, case p_type when 'PROMO' then 1.0::double when 'SMALL' then 0.75::double when 'LARGE' then 0.5::double else 0.3::double end as trust from part""")
def h09(t):
    kind = lookup("p_type", {"PROMO": "game_data", "SMALL": "guide", "LARGE": "web"}, "something else")
    return t.part.select("p_partkey", SC.base_trust(kind).alias("trust"))


@query("h04_default_interval", """
select page_id, case when regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') = 'wowhead.com' then 720 else 168 end as hours from pages""")
def h04b(t):
    return t.pages.select("page_id", check_interval("url").alias("hours"))


# --- reports -----------------------------------------------------------------
def order_answers(t):
    """Orders as reports in JSON: fights, actors, combatants, buffs and rankings."""
    o = t.orders
    code = F.concat(F.lit("r"), F.col("o_orderkey").cast("string"))
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    fight = F.struct(F.col("o_orderkey").alias("id"), (F.ascii("o_orderpriority") - 49).cast("bigint").alias("encounterID"),
                     F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("kill"),
                     F.lit(1000).cast("bigint").alias("startTime"), F.floor("o_totalprice").alias("endTime"))
    trash = F.struct((F.col("o_orderkey") + 1).alias("id"), F.lit(0).cast("bigint").alias("encounterID"), F.lit("trash").alias("name"),
                     F.lit(None).cast("boolean").alias("kill"), F.lit(0).cast("bigint").alias("startTime"), F.lit(5000).cast("bigint").alias("endTime"))
    aura = F.struct(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("guid"), F.floor("o_totalprice").alias("totalUptime"))
    comb = F.struct(F.col("o_custkey").alias("sourceID"), F.lit(260).alias("specID"), F.floor("o_totalprice").alias("agility"))
    server = F.when(F.col("o_orderkey") % 2 == 0, F.lit("north")).otherwise(F.to_json(F.struct(F.lit("south").alias("name"))))
    ranked = F.struct(name.alias("name"), server.alias("server"), F.col("o_totalprice").alias("amount"))
    roles = F.create_map(F.lit("dps"), F.struct(F.array(ranked).alias("characters")), F.lit("tanks"), F.struct(F.array(ranked).alias("characters")))
    doc = F.struct(
        code.alias("code"), (F.col("o_orderstatus") == "O").alias("archived"), F.lit("").alias("title"), F.array(fight, trash).alias("fights"),
        F.array(F.struct(F.col("o_custkey").alias("id"), name.alias("name"))).alias("actors"), F.array(comb).alias("combatants"),
        F.array(F.struct(F.col("o_orderkey").alias("fight"), F.array(aura).alias("auras"))).alias("buffs"),
        F.array(F.struct(F.col("o_orderkey").alias("fightID"), (F.ascii("o_orderpriority") - 49).cast("bigint").alias("encounterID"), roles.alias("roles"))).alias("rankings"))
    return o.select(F.to_json(doc).alias("value"))


def item_answers(t):
    """Line items as answers of their own: damage and casts of one player in a fight."""
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    entry = F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), F.lit("Rogue").alias("type"),
                     F.floor("l_extendedprice").alias("total"), F.col("l_linenumber").cast("bigint").alias("activeTime"),
                     F.array(F.struct(F.col("l_partkey").alias("guid"), F.col("l_returnflag").alias("name"), F.floor("l_quantity").alias("total"))).alias("abilities"))
    table = F.array(F.struct(F.col("l_orderkey").alias("fight"), F.array(entry).alias("entries")))
    doc = F.struct(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("code"), (F.col("o_orderstatus") == "O").alias("archived"),
                   table.alias("damage"), table.alias("casts"))
    return rows.select(F.to_json(doc).alias("value"))


def scanned(t, answers):
    """Answers written as compressed JSON lines and scanned back."""
    path = fresh_path(t.spark, "reports")
    answers.write.option("compression", "gzip").text(path)
    return RP.read_reports(t.spark, path)


def reports(t):
    return scanned(t, order_answers(t))


@query("a06_report_scan", """
select 'r' || o_orderkey as report_code, null::varchar as title, case when floor(o_totalprice) <> 0 then 1000 end::bigint as start_time,
  greatest(5000, floor(o_totalprice)::bigint) as end_time, o_orderstatus = 'O' as is_archived from orders""")
def a06(t):
    return RP.report_rows(reports(t)).select("report_code", "title", "start_time", "end_time", "is_archived")


@query("j08_fights", """
select 'r' || o_orderkey as report_code, o_orderkey as fight_id, (ascii(o_orderpriority) - 49)::bigint as encounter_id, o_orderpriority as encounter_name,
  o_orderstatus = 'F' as kill, floor(o_totalprice)::bigint - 1000 as duration_ms from orders where o_orderstatus <> 'O' and o_orderpriority <> '1-URGENT'""")
def j08(t):
    return RP.fight_rows(reports(t)).select("report_code", "fight_id", "encounter_id", "encounter_name", "kill", "duration_ms")


@query("j08_combatants", """
select 'r' || o_orderkey as report_code, o_orderkey as fight_id, o_custkey as source_id, case when o_custkey <> 0 then 'c' || o_custkey else '' end as player_name,
  floor(o_totalprice)::bigint as agility, 0 as n_auras from orders where o_orderstatus <> 'O' and o_orderpriority <> '1-URGENT'""")
def j08b(t):
    return RP.combatant_rows(reports(t)).select("report_code", "fight_id", "source_id", "player_name", "agility", F.size("auras").alias("n_auras"))


@query("j08_damage", """
select 'r' || o_orderkey as report_code, o_orderkey as fight_id, 's' || l_suppkey as player_name, floor(l_extendedprice)::bigint as total_damage, l_linenumber::bigint as active_time_ms
from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'O'""")
def j08c(t):
    return RP.damage_rows(scanned(t, item_answers(t))).select("report_code", "fight_id", "player_name", "total_damage", "active_time_ms")


@query("j08_casts", """
select 'r' || o_orderkey as report_code, 's' || l_suppkey as player_name, l_returnflag as ability_name, floor(l_quantity)::bigint as cast_count
from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'O'""")
def j08d(t):
    return RP.cast_rows(scanned(t, item_answers(t))).select("report_code", "player_name", "ability_name", "cast_count")


@query("j08_buffs", """
select 'r' || o_orderkey as report_code, o_orderkey as fight_id, o_orderpriority as buff_name, o_custkey as buff_guid, floor(o_totalprice)::bigint as total_uptime_ms, 0::bigint as total_uses
from orders where o_orderstatus <> 'O'""")
def j08e(t):
    return RP.buff_rows(reports(t)).select("report_code", "fight_id", "buff_name", "buff_guid", "total_uptime_ms", "total_uses")


@query("j08_fight_rankings", """
select 'r' || o_orderkey as report_code, (ascii(o_orderpriority) - 49)::bigint as encounter_id, 'c' || o_custkey as player_name, case when o_orderkey % 2 = 0 then 'north' else 'south' end as server_name, o_totalprice as dps
from orders, (values (1), (2)) where o_orderstatus <> 'O'""")
def j08f(t):
    return RP.fight_ranking_rows(reports(t)).select("report_code", "encounter_id", "player_name", "server_name", "dps")


def child_tables(t):
    """The child tables of all reports, flattened."""
    items, whole = scanned(t, item_answers(t)), reports(t)
    return {"fights": RP.fight_rows(whole), "combatants": RP.combatant_rows(whole), "damage": RP.damage_rows(items), "casts": RP.cast_rows(items),
            "buffs": RP.buff_rows(whole), "fight_rankings": RP.fight_ranking_rows(whole)}


def stored_reports(t):
    """Reports stored with other durations and damages first, then as they are, then once more."""
    def make():
        store = Segments(t.spark, fresh_path(t.spark, "reports"))
        tables = {name: materialize(rows, name) for name, rows in child_tables(t).items()}
        early = dict(tables, fights=tables["fights"].withColumn("duration_ms", F.lit(-1).cast("bigint")),
                     damage=tables["damage"].where(F.col("total_damage") % 2 == 0).withColumn("active_time_ms", F.lit(0).cast("bigint")))
        for version, batch in enumerate((early, tables, tables), 1):
            RP.store_tables(store, batch, version)
        return store.root

    return Segments(t.spark, once(t, "reports", ["orders", "lineitem"], make))


@query("j08_stored_fights", """
select 'r' || o_orderkey as report_code, o_orderkey as fight_id, floor(o_totalprice)::bigint - 1000 as duration_ms from orders where o_orderstatus <> 'O' and o_orderpriority <> '1-URGENT'""")
def j08_fights(t):
    return RP.stored_table(stored_reports(t), "fights").select("report_code", "fight_id", "duration_ms")


@query("j08_stored_tables", """
with o as (select * from orders where o_orderstatus <> 'O'), f as (select * from o where o_orderpriority <> '1-URGENT'), d as (select * from o join lineitem on l_orderkey = o_orderkey),
dmg as (select o_orderkey, l_suppkey, arg_max(floor(l_extendedprice)::bigint, (floor(l_extendedprice)::bigint, l_linenumber)) as total from d group by 1, 2)
select 'fights' as table_name, (select count(*) from f) as n_rows, 0::bigint as written_again
union all select 'combatants', (select count(*) from f), 0 union all select 'damage', (select count(*) from dmg), 0
union all select 'casts', (select count(*) from (select distinct o_orderkey, l_suppkey, l_returnflag from d)), 0
union all select 'buffs', (select count(*) from o), 0 union all select 'fight_rankings', (select count(*) from o), 0""")
def j08_stored(t):
    """Rows of the stored tables, and how many the third, equal batch wrote: none."""
    store, out = stored_reports(t), None
    for name in ("fights", "combatants", "damage", "casts", "buffs", "fight_rankings"):
        again = F.lit(store.read(name).where("segment = 3").count()).cast("long")
        row = RP.stored_table(store, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", again.alias("written_again"))
        out = row if out is None else out.unionByName(row)
    return out


@query("j08_encounter_rankings", """
select o_custkey as encounter_id, 'p' || o_orderkey as player_name, o_totalprice as dps, case when o_orderkey % 3 = 0 then '' else 'r' || o_orderkey end as report_code, '' as server_region from orders""")
def j08g(t):
    row = F.struct(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_totalprice").alias("amount"),
                   F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("r"), F.col("o_orderkey").cast("string"))).alias("code")).alias("report"))
    js = F.to_json(F.struct(F.col("o_custkey").alias("encounter_id"), F.array(row).alias("rankings")))
    answers = t.orders.select(F.from_json(js, RP.RANKINGS).alias("a")).select("a.*")
    return RP.ranking_rows(answers).select("encounter_id", "player_name", "dps", "report_code", "server_region")


# --- articles
@query("a08_article_scan", r"""
select 'd' || doc_id as path, source || ': ' || doc_id as title, lang as spec, 'draft' as status, n_chars / 1000000.0::double as confidence, 2 as n_tags,
  'https://' || source as first_source, regexp_replace(text, '^\s+|\s+$', '', 'g') as body,
  case when n_chars > 1000000 then 'confidence out of range' end as error from documents""")
def a08(t):
    """Documents written as Markdown with a YAML front matter and read back."""
    front = F.concat(
        F.lit('---\ntitle: "'), "source", F.lit(": "), F.col("doc_id").cast("string"), F.lit('"\nspec: '), "lang", F.lit("\nconfidence: "),
        F.format_number(F.col("n_chars") / 1_000_000, 6), F.lit("\nsources:\n- url: https://"), "source",
        F.lit("\n  trust: 0.5\ntags:\n- "), "lang", F.lit("\n- guide\n---\n\n"), "text")
    raw = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), front.alias("text"))
    got = AR.parse_articles(raw, "path", "text")
    return got.select("path", "title", "spec", "status", "confidence", F.size("tags").alias("n_tags"), F.col("sources")[0]["url"].alias("first_source"), "body", "error")


# --- questions, exports ------------------------------------------------------
@query("a07_question_scan", """
select 'q' || conv_id || '-' || turn as id, text as question, '' as ground_truth, len(string_split(text, ' ')) as n_facts from conversations""")
def a07(t):
    q = F.struct(F.concat(F.lit("q"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
                 F.col("text").alias("question"), F.split("text", " ").alias("key_facts"))
    raw = t.conversations.select(F.to_json(F.array(q)).alias("value"))
    return EX.parse_questions(raw, "value").select("id", "question", "ground_truth", F.size("key_facts").alias("n_facts"))


@query("j10_character_exports", """
with x as (select p_partkey, p_partkey % 4 as f, p_size, p_type from part)
select p_partkey as export_id, case f when 0 then 'key_value' when 1 then 'listed' else 'numbered' end as format,
  case when f = 0 and p_type <> 'PROMO' then 'orc' when f = 1 then 'night_elf' when f = 2 then 'troll' end as race,
  case when f = 0 and p_type <> 'PROMO' then 'combat_swords' when f = 1 then 'assassination_mutilate' when f = 2 then 'combat_swords' end as spec,
  case when f = 0 and p_type <> 'PROMO' then '20/41/0' when f = 1 then '41/20/0' when f = 2 then '3/7/' || (p_size % 10) end as talents,
  case when f = 0 and p_type <> 'PROMO' then 'head:' || p_size || ',ring_1:7' when f = 1 then 'main_hand:' || p_size when f = 2 then 'head:' || p_size || ',shoulder:5' end as gear,
  case when f = 0 and p_type = 'PROMO' then 'unknown race' when f = 3 then 'invalid json' end as reject_reason from x""")
def j10(t):
    size = F.col("p_size").cast("string")
    kv = F.concat(F.lit('rogue="Some"\nrace='), F.when(F.col("p_type") == "PROMO", "murloc").otherwise("orc"), F.lit('\nspec=combat\ntalents=20/41/0\nhead=,id='), size,
                  F.lit(",enchant_id=3\nfinger1=,id=7"))
    listed = F.concat(F.lit('{"race":"Night Elf","spec":"Mutilate","talents":"41/20/0","items":[{"slot":"Main Hand","id":'), size, F.lit('},{"slot":"Tabard","id":1}]}'))
    num = F.concat(F.lit('{"player":{"race":8,"talentsString":"12-0304-'), (F.col("p_size") % 10).cast("string"),
                   F.lit('","equipment":{"items":[{"id":'), size, F.lit(',"enchant":4},{"id":0},{"id":5,"gems":[1,2]}]}}}'))
    f = F.col("p_partkey") % 4
    raw = t.part.select(F.col("p_partkey").alias("export_id"), F.when(f == 0, kv).when(f == 1, listed).when(f == 2, num).otherwise("bm90IGpzb24=").alias("raw"))
    got = CH.parse_exports(raw, "export_id", "raw")
    gear = F.array_join(F.transform("gear", lambda g: F.concat(g["slot"], F.lit(":"), g["item_id"].cast("string"))), ",")
    return got.select("export_id", "format", "race", "spec", "talents", gear.alias("gear"), "reject_reason")
