"""Streaming forms of dedup and counting, as extensions.

State is bounded by the watermark: a copy that comes later than that is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.corpus import text_digest


def stream_dedup(docs: DataFrame, time: str, text: str = "text", within: str = "1 hour", *keys: str) -> DataFrame:
    """Documents whose stripped text (and keys) hasn't come within the watermark."""
    marked = docs.withWatermark(time, within).withColumn("digest__", text_digest(text))
    return marked.dropDuplicatesWithinWatermark([*keys, "digest__"]).drop("digest__")


def stream_counts(rows: DataFrame, time: str, window: str, reason: str, late: str = "10 minutes") -> DataFrame:
    """(window, reason, n) in append mode."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), reason).agg(F.count("*").alias("n"))
