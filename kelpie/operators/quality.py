"""Quality filtering with an account of what was rejected and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.functions.text import reject_reason


def with_reason(docs: DataFrame, min_chars: int = 300, max_chars: int = 50_000, text_col: str = "text") -> DataFrame:
    """``docs`` with ``reason``: the first rule that each text fails, null if it is kept."""
    return docs.withColumn("reason", reject_reason(F.col(text_col), min_chars, max_chars))


def kept(docs: DataFrame, **limits) -> DataFrame:
    return with_reason(docs, **limits).where("reason is null").drop("reason")


def rejection_histogram(docs: DataFrame, order: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """reason ('kept' for the rest), documents, first_at and the first example of each (160 characters)."""
    judged = with_reason(docs, text_col=text_col, **limits).select(F.coalesce("reason", F.lit("kept")).alias("reason"), order, F.substring(text_col, 1, 160).alias("start"))
    return judged.groupBy("reason").agg(F.count("*").alias("documents"), F.min(order).alias("first_at"), F.min_by("start", order).alias("example"))
