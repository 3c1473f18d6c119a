"""Operator 8: drop the lines that much of a site repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampType

from tidewell.session import materialize

#: A line is boilerplate if over this share of the host's pages, and at least so many of them, hold it.
RATIO = 0.05
LEAST_PAGES = 5
#: Parts into which the pages of a host are dealt out when they meet the host's boilerplate: so many, or one for so many pages.
SALTS, SALT_PAGES = 32, 5000

# --- fixed values: elements that end a line; elements that are not text -------
BREAKS = "p|div|section|article|header|footer|nav|aside|main|blockquote|pre|table|ul|ol|dl|li|tr|dt|dd|hr|br|h[1-6]|title|head|body|html"
NOT_TEXT = ("script", "style", "noscript", "template")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def page_lines(html: Column) -> Column:
    """Text of a page, an element that ends a line on a line of its own; entities stay as they are."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", "")
    for tag in NOT_TEXT:
        x = F.regexp_replace(x, rf"(?s)<{tag}(?: [^>]*)?>.*?</{tag}>", "")
    x = F.regexp_replace(x, rf"</?(?:{BREAKS})(?:[ /][^>]*)?>", "\n")
    x = F.regexp_replace(x, "</?[a-zA-Z!][^>]*>", "")
    return F.regexp_replace(F.regexp_replace(x, "[ \t\r]*\n[ \t\r\n]*", "\n"), "^\n|\n$", "")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(rows: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, once_per_text: bool = False) -> DataFrame:
    """``host, pages, drop``: the hashes of each host's boilerplate lines, from rows of ``host, t, lines``; hosts without any have none.

    A host has at most (lines by page) / ``ratio`` of them, however many pages it has, so the
    array stays small. Counts are summed in each task before they are shuffled. With
    ``once_per_text`` the pages of a host with one text count as one.
    """
    # Lines without a sign are no lines; they stay where they are.
    marks = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key)).alias("marks")
    if once_per_text:
        rows = rows.select("host", F.md5(F.col("t").cast("binary")).alias("k"), marks).groupBy("host", "k").agg(F.first("marks").alias("marks"))
    else:
        rows = rows.select("host", marks)
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = rows.select("host", F.explode("marks").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = held.filter(F.col("n") >= least_pages).join(pages, "host").filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list("line").alias("drop"))


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
                     once_per_text: bool = False) -> DataFrame:
    """``pages`` with ``text`` rewritten and ``n_lines, n_dropped`` added: without the lines that much of their host repeats.

    A host's total counts every page of it; a line counts once a page, blanks around it do not
    matter. With ``once_per_text``, pages of one host with the same text count as one page, so that
    copies do not make their own text boilerplate. Every line over the ratio goes, whatever is left
    of the page. Pages with a null host form one host. A null text stays null and has no lines. Rows
    are never removed; equal rows are pages each. All other columns are kept; columns named
    ``n_lines`` or ``n_dropped`` are replaced.
    """
    rest = [c for c in pages.columns if c not in (host, text, "n_lines", "n_dropped")]
    # All columns travel in one struct, so that none can clash with those used here.
    rows = pages.select(F.struct(*[F.col(c) for c in rest]).alias("r") if rest else F.lit(None).cast("string").alias("r"), F.col(host).alias("h"),
                        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("t"))
    rows = rows.withColumn("lines", F.coalesce(F.split("t", "\n"), F.array().cast("array<string>")))
    drops = materialize(boilerplate(rows.select("host", "t", "lines"), ratio, least_pages, once_per_text), "boilerplate").withColumn(
        "salts", F.greatest(F.lit(SALTS), F.ceil(F.col("pages") / SALT_PAGES)).cast("int"))
    # Only hosts of many pages have more parts than others; there is one for SALTS * SALT_PAGES pages at most.
    large = drops.filter(F.col("salts") > SALTS).select(F.col("host").alias("l_host"), F.col("salts").alias("l_salts"))
    salted = drops.select(F.col("host").alias("d_host"), "drop", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("d_salt"))
    # Plain columns beside the text, such as a page's id, keep copies of one text from sharing a salt.
    dealt = [F.col("r").getField(c) for c in rest if isinstance(pages.schema[c].dataType, (NumericType, StringType, DateType, TimestampType))]
    salt = F.pmod(F.xxhash64("t", *dealt), F.coalesce("l_salts", F.lit(SALTS))).cast("int")
    joined = rows.join(large, F.col("host") == F.col("l_host"), "left").withColumn("salt", salt).join(
        salted, (F.col("host") == F.col("d_host")) & (F.col("salt") == F.col("d_salt")), "left")
    clean = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), _key(x))))
    kept = joined.select("r", "h", "t", "lines", clean.alias("clean"))
    out = kept.select(
        "r", "h", F.when(F.col("t").isNotNull(), F.array_join("clean", "\n")).alias("t"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("clean")).cast("long").alias("n_dropped"))
    columns = {host: F.col("h"), text: F.col("t")} | {c: F.col("r").getField(c) for c in rest}
    return out.select(*[columns[c].alias(c) for c in pages.columns if c in columns], "n_lines", "n_dropped")


def page_line_dedup(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` of raw web pages (``page_id, url, html``)."""
    # Both passes over the lines read them from here, so that every page is parsed once.
    held = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text")), "pages")
    return drop_boilerplate(held, "host", "text", ratio, least_pages).select("page_id", "host", "n_lines", "n_dropped", "text")


SQL = r"""
WITH a AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'),
        '(?s)<script(?: [^>]*)?>.*?</script>', '', 'g'), '(?s)<style(?: [^>]*)?>.*?</style>', '', 'g'),
        '(?s)<noscript(?: [^>]*)?>.*?</noscript>', '', 'g'), '(?s)<template(?: [^>]*)?>.*?</template>', '', 'g') AS x,
    row_number() OVER () AS k FROM pages),
b AS (SELECT page_id, host, k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
        '</?(?:p|div|section|article|header|footer|nav|aside|main|blockquote|pre|table|ul|ol|dl|li|tr|dt|dd|hr|br|h[1-6]|title|head|body|html)(?:[ /][^>]*)?>', chr(10), 'g'),
        '</?[a-zA-Z!][^>]*>', '', 'g'), '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'), '^\n|\n$', '', 'g') AS t FROM a),
c AS (SELECT *, string_split(t, chr(10)) AS lines FROM b),
d AS (SELECT host, count(*) AS pages FROM c GROUP BY host),
e AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT host, k, trim(unnest(lines)) AS line FROM c) WHERE line <> '' GROUP BY ALL),
f AS (SELECT host, list(line) AS boiler FROM e JOIN d USING (host) WHERE n >= 5 AND n > 0.05::DOUBLE * pages GROUP BY host),
g AS (SELECT c.*, list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(boiler, []), trim(x))) AS clean FROM c LEFT JOIN f USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(clean))::BIGINT AS n_dropped, array_to_string(clean, chr(10)) AS text FROM g
"""
