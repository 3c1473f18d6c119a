"""Operator 5: URLs judged by rules and, beyond them, by character language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.lines import host_of
from tidewell.session import materialize

#: (verdict, host, start of the path): a rule holds for its host and all hosts below it.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Longest context of the models, in signs; and how strongly a context leans on the next shorter one.
CONTEXT = 2
LONG_CONTEXT = 5
LEAN = 4.0
#: Copies of each scored gram, so that URLs that all hold it meet it in as many places.
SALTS = 8
#: Longest URL, in signs, that travels itself.
KEY_SIGNS = 64
#: Folded URLs are read in this alphabet of 40 signs (digits as 0, all else as ~), between ^ and $.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHERS = "0/.-_?=&%:^$~"


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (like ``net/es/``) and verdict of the longest rule that holds, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        holds = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text, verdict = F.when(holds, name + start).otherwise(text), F.when(holds, kind).otherwise(verdict)
    return text, verdict


def spelled(url: Column, context: int = CONTEXT, folded: bool = True) -> Column:
    """A URL without its scheme, in the folded alphabet or in its own signs, between marks of start and end."""
    x = F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)^.*?://", "")
    if not folded:
        return F.concat(F.lit("\x02" * context), x, F.lit("\x03"))
    x = F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "0"), "[^a-z0/.\\-_?=&%:]", "~")
    return F.concat(F.lit("^" * context), x, F.lit("$"))


def _never_sent(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the URLs. Spark would go by its compressed files, and rows that are many times as large
    in memory, or copied for each salt, would pass through the driver."""
    return rows.hint("merge")


def grams(rows: DataFrame, context: int, *keep: str) -> DataFrame:
    """A row for each sign of ``x``: the kept columns and ``g``, the sign after its context."""
    return rows.select(*keep, F.explode(F.transform(
        F.sequence(F.lit(context + 1), F.length("x")), lambda i: F.substring(F.col("x"), i - context, F.lit(context + 1)))).alias("g"))


def models(labelled: DataFrame, context: int = CONTEXT, folded: bool = True, lean: float = LEAN) -> list[DataFrame]:
    """``g, ratio`` by order: log likelihood of a sign after its context under accepted minus under rejected URLs.

    From rows of ``x, label`` (1 accepted, 0 rejected). Models of order 0 to ``context`` are
    blended: each adds ``lean`` times the shorter one's probability to its counts, so that rare
    contexts fall back. Only grams that are met have an entry; others are scored from the
    shorter ones by ``scored``. Order 0 falls back to equal shares of the alphabet, which for URLs
    in their own signs is the signs met. Entries grow with the URLs and stay tables.
    """
    counted = materialize(grams(labelled, context, "label").groupBy("g").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("r")), "grams")
    signs = len(LETTERS) + len(OTHERS) if folded else max(1, counted.select(F.substring("g", context + 1, 1)).distinct().count())
    out = []
    for k in range(context + 1):
        level = counted.select(F.substring("g", context + 1 - k, k + 1).alias("g"), "a", "r").groupBy("g").agg(
            F.sum("a").alias("a"), F.sum("r").alias("r"))
        before = level.groupBy(F.left("g", F.lit(k)).alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        level = level.withColumn("c", F.left("g", F.lit(k))).join(_never_sent(before), "c")
        if not out:
            base_a = base_r = F.lit(1 / signs)
        else:
            shorter = out[-1].select(F.col("g").alias("s"), F.col("pa").alias("sa"), F.col("pr").alias("sr"))
            level = level.join(_never_sent(shorter), F.substring("g", 2, k) == F.col("s"))
            base_a, base_r = F.col("sa"), F.col("sr")
        out.append(materialize(level.select("g", ((F.col("a") + lean * base_a) / (F.col("ca") + lean)).alias("pa"),
                                            ((F.col("r") + lean * base_r) / (F.col("cr") + lean)).alias("pr")), "models"))
    return [level.select("g", F.round(F.log(F.col("pa") / F.col("pr")), 9).alias("ratio")) for level in out]


def scored(urls: DataFrame, model: list[DataFrame]) -> DataFrame:
    """``x, score``: mean log-likelihood difference a sign, of distinct ``x``.

    A sign is scored in the longest context in which the models know it. Every distinct gram is
    looked up once, and joined back to the URLs with salts. The ends of the grams are looked up by
    order, from the shortest: a gram that a model lacks takes what its end got, and no end has more
    grams than there are signs.
    """
    context = len(model) - 1
    # A long URL travels with each of its signs as a digest, which lacks the marks that every ``x`` has.
    keyed = urls.select("x", F.when(F.length("x") > KEY_SIGNS, F.sha2("x", 256)).otherwise(F.col("x")).alias("u"))
    met = grams(keyed, context, "u")
    whole = materialize(met.select("g").distinct(), "met")
    found = None
    for k, own in enumerate(model):
        ends = whole.select(F.substring("g", context + 1 - k, k + 1).alias("g")).distinct()
        known = ends.join(_never_sent(own.select(F.col("g").alias("m"), "ratio")), F.col("g") == F.col("m"), "left").drop("m")
        if found is not None:
            shorter = found.select(F.col("g").alias("s"), F.col("ratio").alias("rest"))
            known = known.join(_never_sent(shorter), F.substring("g", 2, k) == F.col("s")).select("g", F.coalesce("ratio", "rest").alias("ratio"))
        found = known
    found = materialize(found.select("g", F.coalesce("ratio", F.lit(0.0)).cast("decimal(18,9)").alias("ratio")), "ratios")
    salted = found.select(F.col("g").alias("f"), "ratio", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    signs = met.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).join(
        _never_sent(salted), (F.col("g") == F.col("f")) & (F.col("salt") == F.col("f_salt")))
    # Summed as decimals: the same sum in whatever order rows arrive.
    sums = signs.groupBy("u").agg((F.sum("ratio").cast("double") / F.count(F.lit(1))).alias("score"))
    return keyed.join(_never_sent(sums), "u").select("x", "score")


def url_filter(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", context: int = CONTEXT,
               folded: bool = True) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages``.

    The models read ``context`` signs before a sign, of folded URLs or of URLs in their own signs.

    URLs that a rule decides train the models: those it allows as accepted, those it blocks as
    rejected, distinct URLs counted once. The others are allowed if their score reaches the point
    between the mean scores of both kinds, weighed by their spreads. With one kind only, that
    kind's verdict holds for all; without any, URLs are allowed. Null URLs and URLs without ``://``
    have an empty host and path and are judged like others; null ids stay null; repeated rows are
    judged each.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"))
    rows = rows.select("id", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), spelled(F.col("u"), context, folded).alias("x"))
    urls = rows.groupBy("x").agg(F.max("ruled").alias("ruled"))
    labelled = urls.filter(F.col("ruled").isNotNull()).select("x", (F.col("ruled") == "allow").cast("int").alias("label"))
    judged = materialize(scored(urls.select("x"), models(labelled, context, folded)).join(_never_sent(urls), "x"), "judged")
    kinds = {r.ruled: r for r in judged.filter(F.col("ruled").isNotNull()).groupBy("ruled").agg(
        F.avg(F.col("score").cast("decimal(18,9)")).cast("double").alias("mean"), F.stddev_pop("score").alias("spread")).collect()}
    if len(kinds) == 2:
        good, bad = kinds["allow"], kinds["block"]
        spread = good.spread + bad.spread
        cut = round((good.mean * bad.spread + bad.mean * good.spread) / spread if spread else (good.mean + bad.mean) / 2, 6)
        by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    else:
        by_model = F.lit("block" if "block" in kinds else "allow")
    found = judged.select(F.col("x").alias("jx"), F.round("score", 6).alias("score"))
    return rows.join(_never_sent(found), F.col("x") == F.col("jx"), "left").select(
        F.col("id").alias(page_id), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
