"""Functions for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.operators.ingest import CHARS_PER_TOKEN, chunk_one


@F.udtf(returnType="chunk_index int, content string, char_count int, token_estimate int")
class ChunkText:
    """``SELECT ... FROM docs, LATERAL chunk_text(docs.text)``: the chunks of one text."""

    def eval(self, text: str) -> Iterator[tuple[int, str, int, int]]:
        if text:
            for i, chunk in enumerate(chunk_one(text, fixed.CHUNK_MAX, fixed.CHUNK_MIN, fixed.CHUNK_OVERLAP)):
                yield i, chunk, len(chunk), len(chunk) // CHARS_PER_TOKEN


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``."""
    spark.udtf.register("chunk_text", ChunkText)
