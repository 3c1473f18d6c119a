"""The registered queries of the operators; importing this fills the registry."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidewell.llm import bpe, exact, jaccard, language, lines, neighbours, packing, quality, rules, token_counts, urls, variants, whitening
from tidewell.llm.registry import QUERIES, SQL, query, table  # noqa: F401

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op1_token_counts")
def op1(spark, folder):
    """Token counts of every document under the unigram scores of a byte-level vocabulary."""
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


@query("op2_best_fit_packing")
def op2(spark, folder):
    """Every document packed into sequences of at most 2048 tokens."""
    return packing.best_fit_packing(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_quality_classifier")
def op3(spark, folder):
    """Quality of every document from compressed sizes; learnt outside of the held-out fold."""
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_url_filters")
def op5(spark, folder):
    """Every page's URL judged by rules and language models of contexts of up to 5 signs."""
    return urls.url_filter(table(spark, folder, "pages"), context=urls.LONG_CONTEXT, folded=False)


@query("op6_quality_rules", rules.SQL)
def op6(spark, folder):
    """Counts and verdicts of the threshold table for every document."""
    return rules.quality_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_language_id")
def op7(spark, folder):
    """Language of every document by cross-parsing; learnt outside of the held-out fold."""
    return language.held_out_language(table(spark, folder, "documents"))


@query("op8_line_dedup", lines.SQL)
def op8(spark, folder):
    """Every page's lines without those that much of its site repeats."""
    return lines.page_line_dedup(table(spark, folder, "pages"))


@query("op10_byte_bpe")
def op10(spark, folder):
    """Every document encoded and decoded again, as digests."""
    path = public_tokenizers.path(BYTE_RANKS)
    ranks = bpe.read_ranks(path)
    ids = bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.little_endian(F.col("ids"), len(ranks)), 256).alias("ids_sha256"),
        F.sha2(bpe.decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"))


@query("op9_ngram_jaccard_join")
def op9(spark, folder):
    """Every document's component under links of 3-word shingles at a Jaccard similarity of 0.9."""
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op4_nearest_neighbours")
def op4(spark, folder):
    """The 20 nearest found for every twentieth embedding."""
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query("op11_whitening")
def op11(spark, folder):
    """Every embedding on the whitened leading components of all distinct ones."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op12_spelling_variants", variants.SQL)
def op12(spark, folder):
    """Every longer word of the documents, its near words and the form that it is a variant of."""
    return variants.spelling_variants(table(spark, folder, "documents"))


@query("op13_exact_dedup", exact.SQL)
def op13(spark, folder):
    """Every document, its group of equal texts, and whether it stays: the largest id of a group does."""
    return exact.exact_dedup(table(spark, folder, "documents"), keep="largest")
