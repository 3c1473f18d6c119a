"""Articles: life cycle, claim checks, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.scoring import clamp
from tidewell.plans.blocked import row_numbers
from tidewell.plans.merge import first_write_wins

# --- fixed values: allowed changes of an article's status ---------------------
FORWARD = {"draft": "review", "review": "published"}
APPROVAL = 0.6
CONTRADICTION_PENALTY = 0.15


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- life cycle --------------------------------------------------------------
def transitions(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """Requested actions with ``new_status`` or ``reject_reason``.

    ``requests``: ``path, action, target, reason``, one per path, with action
    ``create``, ``update``, ``status`` (to ``target``) or ``reject``.
    """
    j = requests.join(articles.select("path", F.col("status").alias("current")), "path", "left")
    exists, action = F.col("current").isNotNull(), F.col("action")
    nxt = F.when(F.col("current") == "draft", FORWARD["draft"]).when(F.col("current") == "review", FORWARD["review"])
    problem = (
        F.when((action == "create") & exists, "already exists")
        .when((action != "create") & ~exists, "not found")
        .when((action == "update") & (F.col("current") != "draft"), "not a draft")
        .when((action == "reject") & (F.col("current") != "review"), "not in review")
        .when((action == "status") & ~F.coalesce(nxt == F.col("target"), F.lit(False)), "invalid transition")
    )
    new = F.when(action.isin("create", "update", "reject"), "draft").otherwise(F.col("target"))
    return j.withColumn("reject_reason", problem).withColumn("new_status", F.when(F.col("reject_reason").isNull(), new))


def apply_transitions(articles: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """Articles after the accepted actions; a rejected article carries the reason."""
    ok = decided.where(F.col("new_status").isNotNull()).select(
        "path", F.col("new_status").alias("_s"), F.when(F.col("action") == "reject", F.nullif("reason", F.lit(""))).alias("_r"), F.col("action").alias("_a"))
    j = articles.join(ok, "path", "full")
    hit = F.col("_a").isNotNull()
    return j.select(
        "path", F.coalesce("_s", "status").alias("status"), F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(F.col("_a") == "reject", F.col("_r")).otherwise(F.col("rejection_reason")).alias("rejection_reason"))


# --- claims ------------------------------------------------------------------
def article_confidence(verdicts: DataFrame, key: str) -> DataFrame:
    """Per article: mean claim confidence less a penalty per contradicted claim.

    ``verdicts``: ``key, status, confidence`` rows; a failed check (null status)
    counts as unsupported with confidence 0.3.
    """
    v = failed_as_unsupported(verdicts)
    return v.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("status") == "contradicted").alias("n_contradicted"),
        clamp(F.avg("confidence") - F.count_if(F.col("status") == "contradicted") * F.lit(CONTRADICTION_PENALTY)).alias("confidence"))


def failed_as_unsupported(verdicts: DataFrame) -> DataFrame:
    failed = F.col("status").isNull()
    return verdicts.withColumn("confidence", F.when(failed, F.lit(0.3)).otherwise(F.col("confidence"))).withColumn(
        "status", F.coalesce("status", F.lit("unsupported")))


def with_all_articles(confidence: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """Confidence of every article; 0 without claims."""
    return articles.select(key).join(confidence, key, "left").fillna({"n_claims": 0, "n_contradicted": 0, "confidence": 0.0})


def update_claims(claims: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Claims with the verdict of the same text: verified flag and joined evidence."""
    v = verdicts.select(*keys, F.col("status").alias("_s"), "supporting", "contradicting")
    none = F.array().cast("array<string>")
    joined = claims.join(v, keys, "left")
    merged = F.array_distinct(F.concat("evidence", F.coalesce("supporting", none), F.coalesce("contradicting", none)))
    hit = F.col("_s").isNotNull()
    return joined.select(*keys, F.when(hit, F.col("_s") == "verified").otherwise(F.col("verified")).alias("verified"),
                         F.when(hit, merged).otherwise(F.col("evidence")).alias("evidence"))


def contradiction_events(articles: DataFrame, verdicts: DataFrame, sources: DataFrame, key: str, now: Column) -> DataFrame:
    """Trust events for the known sources of articles with contradicted claims.

    ``articles``: ``key, source_urls, claims`` (array of claim texts with status, in
    order). The loss grows with the share of contradicted claims.
    """
    share = verdicts.groupBy(key).agg(
        (F.count_if(F.col("status") == "contradicted") / F.count(F.lit(1))).alias("_share"))
    bad = F.transform(F.filter("claims", lambda c: c["status"] == "contradicted"), lambda c: F.left(c["text"], F.lit(100)))
    hit = articles.join(share.where(F.col("_share") > 0), key).select(
        key, F.explode("source_urls").alias("url"), (F.lit(fixed.TRUST_DELTAS["contradiction"]) * F.col("_share")).alias("delta"),
        F.concat(F.lit("Contradicted claims: "), F.array_join(bad, "; ")).alias("details"))
    return hit.join(sources.select("url"), "url").select(
        key, "url", F.lit("contradiction").alias("event_type"), "delta", "details", now.alias("created_at"))


def claim_check(verdicts: DataFrame, key: str, claim: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(confidence and approval per article, corrections, research gaps)."""
    v = failed_as_unsupported(verdicts)
    result = article_confidence(v, key).withColumn("approved", F.round("confidence", 9) >= APPROVAL)
    corrections = v.where(F.col("status") == "contradicted").select(
        key, F.concat(F.lit("Claim '"), F.col(claim), F.lit("' contradicted: "), F.coalesce("note", F.lit(""))).alias("correction"))
    gaps = v.where(F.col("status") == "unsupported").select(key, F.col(claim).alias("gap"))
    return result, corrections, gaps


# --- findings ----------------------------------------------------------------
def merge_findings(findings: DataFrame, keys: list[str], claim: str, order: Column) -> DataFrame:
    """First finding per claim of a task."""
    return first_write_wins(findings, [*keys, claim], order)


def merge_outcomes(results: DataFrame, key: str) -> DataFrame:
    """Task status over its results: success and sufficient only if all are."""
    return results.groupBy(key).agg(
        F.when(F.bool_and(F.col("status") == "success"), "success").otherwise("partial").alias("status"),
        F.bool_and("sufficient").alias("sufficient"))


def distinct_in_order(values: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """Distinct values of a key as rows with the position of their first use."""
    return values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("first_at"))


def numbered(values: DataFrame, key: str, block: Column, name: str = "position") -> DataFrame:
    """0-based position by ``first_at`` within each key."""
    out = row_numbers(values, [key], ["first_at"], block, name)
    return out.withColumn(name, F.col(name) - 1)


def article_sources(findings: DataFrame, key: str, order: Column) -> DataFrame:
    """Web addresses among the evidence of an article, with the confidence of their first finding."""
    web = findings.select(key, order.alias("_o"), "confidence", F.explode("evidence").alias("url")).where(F.startswith("url", F.lit("http")))
    return web.groupBy(key, "url").agg(F.min_by("confidence", "_o").alias("trust"))


def written_confidence(findings: DataFrame, key: str) -> DataFrame:
    """Mean confidence of the findings behind an article, four digits."""
    return findings.groupBy(key).agg(F.round(F.avg("confidence"), 4).alias("confidence"))
