"""A training corpus from raw documents: five operators, each on what the one before it kept.

Stages take and return DataFrames; ``run`` writes each result and reads it again, so that a lost
executor repeats a part of one stage at most. SQL cannot express the classifier, the join and
the packing, so there is no ``ORACLE_SQL``; ``tests/llm/test_pipeline.py`` compares the result
with a version that works document by document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import jaccard, lines, packing, quality, rules
from tidewell.llm.registry import table
from tidewell.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None


def _held(docs: DataFrame) -> DataFrame:
    """Each document as one value beside its text, so that no column can clash with an operator's."""
    return docs.select(F.struct(*COLUMNS).alias("row"), "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learnt from the labels outside of the held-out fold."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    found = quality.scores(docs.select(F.struct(*COLUMNS).alias("row")), model, "row", "row.text")
    return found.filter(F.col("score") >= quality.REJECT_BELOW).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the threshold table rejects."""
    found = rules.quality_rules(_held(docs), "row", "text")
    # The verdict passes an explode, so that the filter cannot draw the counts in and cut the text once for each of its rules.
    judged = found.select("row", F.explode_outer(F.array("kept")).alias("kept"))
    return judged.filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that much of their source repeats; ``n_chars`` is that of the new text.

    Copies of one text in a source count once: what is copied is for the next stage to find.
    """
    out = lines.drop_boilerplate(docs.select(*COLUMNS), "source", "text", once_per_text=True)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8, the one with the smallest id.

    Texts of one id are documents each; of repeated rows of one id and text the least in the order of their columns stays.
    Documents without an id stay unless they are linked to one with an id.
    """
    # Ids come before none, and texts of one id are told apart by a digest.
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    rows = docs.select(own.alias("own"), *COLUMNS)
    groups = jaccard.jaccard_components(rows, doc_id="own", width=5, p=4, q=5)
    first = groups.filter((F.col("own") == F.col("component_id")) | F.col("component_id.none")).select(F.col("own").alias("first")).distinct()
    kept = rows.join(first, F.col("own") == F.col("first"), "left_semi")
    least = kept.filter("doc_id IS NOT NULL").groupBy("own").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return least.unionByName(kept.filter("doc_id IS NULL").select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents packed into sequences of at most 2048 tokens."""
    return packing.best_fit_packing(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
