"""Articles: Markdown with a YAML front matter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.spread import spread

META = (
    "title string, spec string, category string, status string, confidence double, created_at string, updated_at string, "
    "sources array<struct<url:string,trust:double>>, claims array<struct<text:string,verified:boolean,evidence:array<string>>>, "
    "entity_refs array<string>, tags array<string>, rejection_reason string"
)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a folder: ``path``, the front matter fields, ``body``, ``error``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_articles(raw, "path", "text")


def parse_articles(raw: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """Articles out of a text column; the YAML reader runs per Arrow batch."""
    front = r"(?s)^\s*---\s*\n(.*?)\n---\s*(?:\n|$)(.*)$"
    cut = spread(raw, path_col).select(F.col(path_col).alias("path"), F.regexp_extract(text_col, front, 1).alias("front"),
                     F.when(F.col(text_col).rlike(front), F.regexp_replace(F.regexp_extract(text_col, front, 2), r"^\s+|\s+$", "")).otherwise(F.col(text_col)).alias("body"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading YAML front matter needs the yaml package on the executors") from exc
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for pdf in parts:
            metas, errors = [], []
            for text in pdf["front"]:
                try:
                    metas.append(json.dumps(yaml.load(text, Loader=loader) or {}, default=str))
                    errors.append(None)
                except yaml.YAMLError:
                    metas.append(None)
                    errors.append("invalid front matter")
            yield pdf[["path", "body"]].assign(meta=metas, error=errors)

    rows = cut.mapInPandas(run, "path string, body string, meta string, error string")
    meta = F.from_json("meta", META)
    out = rows.select("path", meta.alias("m"), "body", "error").select("path", "m.*", "body", "error")
    bad_confidence = F.col("confidence").isNotNull() & ~F.col("confidence").between(0.0, 1.0)
    bad_source = F.exists("sources", lambda s: ~s["url"].rlike("^https?://"))
    return out.withColumns({
        "status": F.coalesce("status", F.lit("draft")),
        "error": F.coalesce("error", F.when(bad_confidence, "confidence out of range").when(bad_source, "bad source url"))})
