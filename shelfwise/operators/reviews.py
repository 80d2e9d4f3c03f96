"""Review reasons, counts per item, distinct reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import tags, words
from shelfwise.operators.dedupe import keep_one


def with_reason(df: DataFrame, text: str = "content", rules=tuple(words.REVIEW_REASONS), other: str = words.OTHER_REASON) -> DataFrame:
    """First matching reason of every review over its whole text."""
    return df.withColumn("reason", tags.first_label(text, rules, other))


def reason_counts(df: DataFrame, key: str = "item_id") -> DataFrame:
    """Reviews per item and reason, and per reason overall (NULL item), in one rollup."""
    return df.rollup("reason", key).agg(F.count(F.lit(1)).alias("n")).where(F.col("reason").isNotNull())


def distinct_reviews(df: DataFrame, keys: Sequence[str], text: str, chars: int | None = None, order=None) -> DataFrame:
    """One review per key and text; the text counts whole, or ``chars`` of its head (the published form has 100)."""
    own = F.substring(text, 1, chars) if chars else F.col(text)
    return keep_one(df.withColumn("_own", F.sha2(own, 256)), [*keys, "_own"], order or [F.col(text).asc()]).drop("_own")
