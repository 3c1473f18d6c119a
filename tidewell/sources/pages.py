"""Source lists and raw web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import is_blank, url_netloc
from tidewell.plans.spread import spread

MAX_BYTES = 5 * 1024 * 1024

# The priority is read as it stands, so that one which is no whole number can be told from a missing one.
ENTRY_SCHEMA = "url string, title string, source_type string, category string, priority string, spec string, enabled boolean"


# --- source lists ------------------------------------------------------------
def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON source lists: a list of entries, or an object with ``sources``."""
    return source_entries(spark.read.text(path, wholetext=True), "value")


def source_entries(raw: DataFrame, text_col: str) -> DataFrame:
    """Entries out of JSON text rows, missing fields filled with their defaults.

    ``unread`` is null for an entry. A text that is no list of entries gives one row
    with the whole text there and nothing else, which ``check_entries`` rejects; so
    does a priority that is no whole number, with the priority's text.
    """
    entry = "array<struct<" + ENTRY_SCHEMA.replace(" ", ":").replace(",:", ",") + ">>"
    held = F.from_json(text_col, f"struct<sources:{entry}>")["sources"]
    is_list = F.ltrim(F.col(text_col)).startswith("[")
    read = F.when(is_list, F.from_json(text_col, entry)).otherwise(held)
    broken = read.isNull() | F.exists(F.coalesce(read, F.array()), lambda e: e.isNull())
    rows = raw.select(F.when(broken, F.coalesce(F.col(text_col), F.lit(""))).alias("unread"),
                      F.when(~broken, read).alias("list"))
    rows = rows.where(F.col("unread").isNotNull() | (F.size("list") > 0)).select("unread", F.explode_outer("list").alias("e"))
    whole = F.regexp_like("priority", F.lit(r"^[+-]?[0-9]{1,9}$"))
    rows = rows.select("e.*", "unread").withColumn("unread", F.coalesce("unread", F.when(~whole, F.col("priority"))))
    return with_defaults(rows.withColumn("priority", F.when(whole, F.col("priority")).cast("int")))


def with_defaults(entries: DataFrame) -> DataFrame:
    # --- fixed values: defaults of a source-list entry
    return entries.withColumns({
        "source_type": F.coalesce("source_type", F.lit("guide")), "category": F.coalesce("category", F.lit("general")),
        "priority": F.coalesce("priority", F.lit(2)), "enabled": F.coalesce("enabled", F.lit(True))})


def check_entries(entries: DataFrame) -> DataFrame:
    """Entries with ``reject_reason`` (null = valid)."""
    web = F.startswith("url", F.lit("http://")) | F.startswith("url", F.lit("https://"))
    unread = F.col("unread").isNotNull() if "unread" in entries.columns else F.lit(False)
    reason = F.when(unread & F.col("url").isNull() & F.col("title").isNull(), "unreadable").when(
        ~F.coalesce(web, F.lit(False)), "bad url").when(F.col("title").isNull(), "no title").when(
        unread | ~F.col("priority").between(1, 3), "bad priority")
    return entries.withColumn("reject_reason", reason)


# --- fetched pages -----------------------------------------------------------
def check_pages(pages: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Responses (``status, content_length, content_type, html``) with ``reject_reason``; the first rule that fails."""
    kind = F.coalesce("content_type", F.lit(""))
    reason = (
        F.when(F.col("status") >= 400, "bad status")
        .when(F.col("content_length") > max_bytes, "declared too large")
        .when(~(F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml+xml"))), "not html")
        .when(F.octet_length("html") > max_bytes, "too large")
    )
    return pages.withColumn("reject_reason", reason)


# --- fixed values: markup of a page ------------------------------------------
SKIPPED = ("head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside")
NAMED = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "middot": "·",
    "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "deg": "°", "times": "×", "euro": "€", "pound": "£", "sect": "§",
}
# Inside of a tag; a quoted attribute value may hold a ">". Possessive, so that a tag of any length
# is read in a loop and never goes back; a quote that is never closed ends at the next ">" (TAG_END).
ATTRS = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^>"'\s]?+)[^>=]*+)*+"""
TAG_END = rf"(?:{ATTRS}>|[^>]*+>)"
DROPPED_MARKUP = r"(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in SKIPPED)
MAIN_PART = rf"(?is)<(?:article|main)\b{TAG_END}(.*)</(?:article|main)\s*>"
PARAGRAPH = rf"(?i)</?(?:p|div|section|article|blockquote|pre|table|ul|ol|dl|h[1-6])\b{TAG_END}"
LINE_END = rf"(?i)<(?:br|li|tr|dt|dd|hr)\b{TAG_END}"
ANY_TAG = rf"(?s)<[a-zA-Z/!?]{TAG_END}"


def unescape(text: Column) -> Column:
    """Numeric and common named character references; ``&amp;`` last."""
    parts = F.split(text, r"&#(?=(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)")

    def decode(part: Column) -> Column:
        code = F.regexp_extract(part, "^([xX]?[0-9a-fA-F]+);", 1)
        number = F.when(F.lower(F.left(code, F.lit(1))) == "x", F.conv(F.substring(code, 2, 8), 16, 10)).otherwise(code).cast("int")
        sign = F.when((number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF),
                      F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")
        return F.concat(sign, F.regexp_replace(part, "^[xX]?[0-9a-fA-F]+;", ""))

    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decode), ""))
    out = F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)
    for name, sign in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def main_text(html: Column | str) -> Column:
    """Readable text of a page: the main part where marked, headings as Markdown.

    Scripts, styles, navigation, page head and foot, links' targets and comments are
    left out. Native expressions only.
    """
    x = F.regexp_replace(F.col(html) if isinstance(html, str) else html, DROPPED_MARKUP, " ")
    main = F.regexp_extract(x, MAIN_PART, 1)
    x = F.when(main != "", main).otherwise(x)
    x = F.regexp_replace(x, r"\s+", " ")
    for level in (1, 2, 3, 4):
        tag = f"h{level}" if level < 4 else "h[4-6]"
        x = F.regexp_replace(x, rf"(?i)<{tag}\b{TAG_END}", f"\n\n{'#' * level} ")
    x = F.regexp_replace(x, PARAGRAPH, "\n\n")
    x = F.regexp_replace(x, LINE_END, "\n")
    x = unescape(F.regexp_replace(x, ANY_TAG, ""))
    x = F.regexp_replace(x, " *\n *", "\n")
    x = F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), " {2,}", " ")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def extract_pages(pages: DataFrame, html_col: str = "html", key: str = "url") -> DataFrame:
    """Pages with ``text`` and, where nothing is left, ``error``."""
    out = spread(pages, key).withColumn("text", main_text(html_col))
    return out.withColumn("error", F.when(is_blank("text"), "Empty extraction"))


def page_title(given: Column, html: Column | str, final_url: Column | str) -> Column:
    """Given title, else the page's, else the host of the final URL."""
    found = F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    found = F.trim(F.regexp_replace(unescape(found), r"\s+", " "))
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(found, F.lit("")), url_netloc(final_url))

