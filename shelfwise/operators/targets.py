"""Which items to fetch next: priority pool, checkpoints, quota windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.operators.distribution import add_ranks, quantiles


def done_rows(checkpoint: DataFrame, status: str = "status", cards: str = "cards") -> DataFrame:
    """Checkpoint rows that need no retry: successes with content, and items the site refuses."""
    good = (F.col(status) == "success") & (F.coalesce(F.col(cards), F.lit(0)) > 0)
    return checkpoint.where(good | (F.col(status) == "access_blocked"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a done row."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def priority_pool(items: DataFrame, rank_within: str = "category", reviews: str = "comments", price: str = "price", top: int = 10, low: float = 0.2, high: float = 0.8, factor: float = 2.0) -> DataFrame:
    """Items that are high in their category, much reviewed, or at the ends of the price range.

    One predicate over one pass of ranks and thresholds instead of a union of filtered copies.
    """
    cuts = quantiles(items, [], {"lo": (price, low), "hi": (price, high)})
    mean = items.agg(F.avg(reviews).alias("m")).scalar()
    ranked = add_ranks(items, [rank_within], reviews, rank_desc="rank_position")
    p = F.col(price)
    keep = (
        (F.col("rank_position") <= top)
        | (F.col(reviews) > mean * factor)
        | (p < cuts.select("lo").scalar())
        | (p > cuts.select("hi").scalar())
    )
    return ranked.where(F.coalesce(keep, F.lit(False)))


def next_batch(items: DataFrame, done: DataFrame, key: str, order: Sequence[Column], quota: int) -> DataFrame:
    """The next ``quota`` pending items: the quota is the feature, the daily allowance of a crawler."""
    return pending(items, done, key).orderBy(*order).limit(quota)


# --- quota windows ------------------------------------------------------------
def limit_window(ts, start_hour: int = 23, end_hour: int = 6) -> Column:
    """``struct(scope, start, end)``: the night window that crosses midnight, else the calendar day."""
    t = tx.col(ts)
    night = (F.hour(t) >= start_hour) | (F.hour(t) < end_hour)
    day = F.date_trunc("day", t)
    hours = lambda h: F.make_dt_interval(hours=F.lit(h))
    opened = F.when(F.hour(t) >= start_hour, day + hours(start_hour)).otherwise(day - hours(24 - start_hour))
    length = (24 - start_hour) + end_hour
    return F.struct(
        F.when(night, "night_window").otherwise("calendar_day").alias("scope"),
        F.when(night, opened).otherwise(day).alias("start"),
        F.when(night, opened + hours(length)).otherwise(day + hours(24)).alias("end"),
    )


def quota_usage(rows: DataFrame, ts: str, quota: int) -> DataFrame:
    """Rows per quota window and what is left of the quota."""
    w = rows.withColumn("_w", limit_window(ts)).groupBy(F.col("_w.scope").alias("scope"), F.col("_w.start").alias("window_start"))
    return w.agg(F.count(F.lit(1)).alias("n")).withColumn("remaining", F.greatest(F.lit(quota) - F.col("n"), F.lit(0)))
