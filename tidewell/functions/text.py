"""Text, URL and number-in-text expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import fixed

# White space taken off the ends of log lines and fields.
SPACES = " \t\r\n\f\x0b\u00a0\u2028\u2029\u3000"


def _folding() -> tuple[str, str]:
    """Letters that are a letter and diacritical marks, then the marks; and the letters without (the marks go)."""
    marks = [chr(point) for point in range(0x300, 0x370)]
    accented, plain = [], []
    for point in range(0xC0, 0x2000):
        base, *rest = unicodedata.normalize("NFD", chr(point))
        if rest and base.isalpha() and set(rest) <= set(marks):
            accented.append(chr(point))
            plain.append(base)
    return "".join(accented + marks), "".join(plain)


# Accented letters, with the diacritical marks at the end, and what a keyword index folds them to.
ACCENTED, FOLDED = _folding()


def literal_map(mapping: dict) -> Column:
    """A small dictionary as a literal map column."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(key: Column | str, mapping: dict, default=None) -> Column:
    """Dictionary lookup; a missing key gives ``default``."""
    col = F.col(key) if isinstance(key, str) else key
    found = F.when(col.isNull(), F.lit(None)).otherwise(F.try_element_at(literal_map(mapping), col))
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_blank(col: Column | str) -> Column:
    """True when nothing but white space is left."""
    return ~F.coalesce(_c(col), F.lit("")).rlike(r"(?U)\S")


def normalize_name(col: Column | str) -> Column:
    """Lower case, outer space removed, one leading article dropped, spaces collapsed."""
    x = F.regexp_replace(F.lower(_c(col)), r"(?U)^\s+|\s+$", "")
    x = F.regexp_replace(x, r"(?U)^(the|a|an)\s+", "")
    return F.regexp_replace(x, r"(?U)\s+", " ")


def resolve_canonical(col: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Normalised name replaced by its alias target, one hop only."""
    name = normalize_name(col)
    return lookup(name, fixed.ALIASES if aliases is None else aliases, default=name)


def slugify(col: Column | str) -> Column:
    """URL-safe form of a title."""
    x = F.regexp_replace(F.lower(_c(col)), "'", "")
    x = F.regexp_replace(x, "[^a-z0-9]+", "-")
    return F.regexp_replace(x, "^-+|-+$", "")


def derive_path(group: Column | str, category: Column | str, title: Column | str) -> Column:
    """``group/category/slug.md``."""
    return F.concat(_c(group), F.lit("/"), _c(category), F.lit("/"), slugify(title), F.lit(".md"))


def url_netloc(url: Column | str) -> Column:
    """Network location of a URL: host, and port where given."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def check_interval(url: Column | str, intervals: dict[str, int] | None = None) -> Column:
    """Hours between two checks of the site of ``url``."""
    host = F.regexp_replace(F.lower(url_netloc(url)), r"^www\.", "")
    return lookup(host, fixed.CHECK_INTERVALS if intervals is None else intervals, fixed.DEFAULT_CHECK_INTERVAL)


def token_estimate(text: Column | str) -> Column:
    """Four characters count as one token."""
    return F.floor(F.length(_c(text)) / F.lit(4))


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the text, the empty string for blank text."""
    return F.when(is_blank(text), F.lit("")).otherwise(F.sha2(_c(text), 256))


def title_case(col: Column | str) -> Column:
    """Underscores to spaces, then a capital after everything that is no letter.

    ``initcap`` would start words at spaces only, not after digits or apostrophes.
    """
    parts = F.split(F.replace(_c(col), F.lit("_"), F.lit(" ")), r"(?<=\P{L})")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))), "")


def display_name(ability: Column | str, names: dict[str, str] | None = None) -> Column:
    """Human-readable ability name."""
    return lookup(ability, fixed.DISPLAY_NAME if names is None else names, default=title_case(ability))


def number_before(text: Column | str, unit: str = "dps") -> Column:
    """First number written before ``unit``, thousands commas allowed; null if none."""
    found = F.regexp_extract(_c(text), rf"(?i)(\d[\d,]*\.?\d*)\s*{unit}", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def first_number(text: Column | str, patterns: list[str]) -> Column:
    """Number captured by the first pattern of the list that matches; null if none."""
    hits = [F.regexp_replace(F.regexp_extract(_c(text), p, 1), ",", "").try_cast("double") for p in patterns]
    return F.coalesce(*hits)


def folded(text: Column | str) -> Column:
    """Lower case without accents; plain ASCII text skips the slow per-character step."""
    low = F.lower(_c(text))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, ACCENTED, FOLDED))


def tokens(text: Column | str) -> Column:
    """Keyword tokens: folded to lower case without accents, split on other characters."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]++"), "")


def clip_middle(text: Column | str, limit: int = 2000, keep: int = 1000, marker: str = fixed.CLIP_MARKER) -> Column:
    """Text longer than ``limit`` keeps its first and last ``keep`` characters."""
    x = _c(text)
    return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(keep)), F.lit(marker), F.right(x, F.lit(keep)))).otherwise(x)


def clip(text: Column | str, limit: int = 500) -> Column:
    """First ``limit`` characters, with dots when something was left out."""
    x = _c(text)
    return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit("..."))).otherwise(x)


def valid_player_name(name: Column | str, max_len: int = 50) -> Column:
    """Letters and digits, with dashes and apostrophes allowed between them."""
    x = _c(name)
    return F.coalesce(
        (F.length(x) <= max_len) & x.rlike(r"^[\p{L}\p{N}\-']+$") & x.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def document_prompt(text: Column | str) -> Column:
    """Text handed to the embedding model for a stored document."""
    return F.concat(F.lit("search_document: "), _c(text))


def query_prompt(text: Column | str) -> Column:
    """Text handed to the embedding model for a query."""
    return F.concat(F.lit("search_query: "), _c(text))


def quoted_fields(payload: Column | str) -> Column:
    """Comma-separated fields; commas inside quotes do not split, quotes go away.

    Every second part between quotes lies inside them. One pass over the line.
    """
    mark = "\x01"
    parts = F.transform(F.split(_c(payload), '"'), lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(mark))).otherwise(p))
    fields = F.split(F.array_join(parts, ""), mark)
    # A trailing empty field is not a field.
    whole = F.when(F.element_at(fields, -1) == "", F.slice(fields, F.lit(1), F.size(fields) - 1)).otherwise(fields)
    return F.transform(whole, lambda f: F.btrim(f, F.lit(SPACES)))


def field_or(fields: Column, index: int, default: str = "") -> Column:
    """Field by 0-based position, ``default`` when the row is too short."""
    return F.coalesce(F.get(fields, index), F.lit(default))


def safe_int(fields: Column, index: int) -> Column:
    """Integer field by 0-based position; 0 when missing or not an integer."""
    raw = F.get(fields, index)
    return F.coalesce(F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), raw.try_cast("bigint")), F.lit(0).cast("bigint"))


def _stamp_parts(stamp: Column | str) -> Column:
    """Month, day, hour, minute, second and fraction of ``M/D HH:MM:SS.fff``."""
    return F.transform(F.split(F.btrim(_c(stamp)), r"[\s/:.]+"), lambda p: p.try_cast("bigint"))


def log_time_ms(stamp: Column | str) -> Column:
    """``M/D HH:MM:SS.fff`` to milliseconds since midnight; the fraction is read as an integer."""
    p = _stamp_parts(stamp)
    ms = (F.get(p, F.lit(2)) * 3600 + F.get(p, F.lit(3)) * 60 + F.get(p, F.lit(4))) * 1000 + F.get(p, F.lit(5))
    return F.coalesce(ms, F.lit(0).cast("bigint"))


def log_order_ms(stamp: Column | str) -> Column:
    """As :func:`log_time_ms`, but counting days too, so a fight may cross midnight."""
    p = _stamp_parts(stamp)
    # 2024 is a leap year, so 2/29 is a date; an impossible date counts as the first day.
    date = F.try_make_timestamp(F.lit(2024), F.get(p, F.lit(0)).cast("int"), F.get(p, F.lit(1)).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    days = F.coalesce(F.datediff(date.cast("date"), F.lit("2024-01-01").cast("date")), F.lit(0))
    return days.cast("bigint") * 86_400_000 + log_time_ms(stamp)


def talent_totals(text: Column | str) -> Column:
    """``X/Y/Z`` as three integers; null unless valid (non-negative, at most 61 in total)."""
    parts = F.transform(F.split(F.trim(_c(text)), "/"), lambda p: F.trim(p).try_cast("int"))
    good = (
        (F.size(parts) == 3) & F.forall(parts, lambda p: p.isNotNull() & (p >= 0))
        & (F.aggregate(parts, F.lit(0), lambda a, p: a + F.coalesce(p, F.lit(0))) <= 61)
    )
    return F.when(good, parts)


def digit_sums(text: Column | str) -> Column:
    """``aaa-bbb-ccc`` as the digit sum of each dash-separated part."""
    digits = lambda s: F.filter(F.split(F.regexp_replace(s, r"\D", ""), ""), lambda d: d != "")
    return F.transform(
        F.split(_c(text), "-"), lambda s: F.aggregate(digits(s), F.lit(0), lambda a, d: a + d.cast("int")))


def spec_from_digits(text: Column | str) -> Column:
    """Build name by the larger of the first two digit sums."""
    sums = digit_sums(text)
    return F.when((F.size(sums) >= 2) & (F.get(sums, 0) > F.get(sums, 1)), F.lit("assassination_mutilate")).otherwise(
        F.lit("combat_swords"))
