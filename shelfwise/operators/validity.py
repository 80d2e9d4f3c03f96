"""Histories as validity intervals: one row per product and stretch without change.

A round is a dated crawl with at most one row per product. A stretch ends when a value changes or when a round does not
hold the product. ``valid_from`` is the first round of the stretch, ``valid_to`` the first round it no longer covers
(NULL: still open), ``rounds`` how many rounds it spans. A NULL value equals NULL, NaN equals NaN. Rounds without any
row are unknown to :func:`intervals` (pass ``calendar`` where they occur). Rows with a NULL key or date are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(rounds: DataFrame, key: str, date: str, values: Sequence[str], calendar: DataFrame | None = None) -> DataFrame:
    """All rounds at once. Windows are per product and hold a row per round; the calendar has a row per round."""
    rows = rounds.where(F.col(key).isNotNull() & F.col(date).isNotNull()).select(key, F.col(date).alias("_d"), F.struct(*values).alias("_v"))
    days = (rows.select("_d") if calendar is None else calendar.select(F.col(date).alias("_d"))).distinct()
    # the dates of all rounds are one array, as long as the calendar
    dates = days.agg(F.sort_array(F.collect_list("_d")).alias("_all"))
    at = rows.withColumn("_all", dates.scalar()).withColumn("_i", F.array_position("_all", F.col("_d")))
    w = Window.partitionBy(key).orderBy("_i")
    goes_on = F.coalesce(F.col("_v").eqNullSafe(F.lag("_v").over(w)) & (F.lag("_i").over(w) == F.col("_i") - 1), F.lit(False))
    stretch = at.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_s", F.sum("_new").over(w))
    out = stretch.groupBy(key, "_s").agg(
        F.min_by("_d", "_i").alias("valid_from"), F.max("_i").alias("_last"), F.count(F.lit(1)).alias("rounds"), F.first("_v").alias("_v"), F.first("_all").alias("_all")
    )
    return out.select(key, *[F.col(f"_v.{c}").alias(c) for c in values], "valid_from", F.try_element_at("_all", (F.col("_last") + 1).cast("int")).alias("valid_to"), "rounds")


def fold(history: DataFrame, snapshot: DataFrame, key: str, date, values: Sequence[str]) -> DataFrame:
    """A history with one more round, later than all it holds.

    Closed intervals pass through; the open ones meet the round once, by key.
    """
    day = F.lit(date).cast(history.schema["valid_from"].dataType)
    cols = [key, *values, "valid_from", "valid_to", "rounds"]
    closed = history.where(F.col("valid_to").isNotNull()).select(*cols)
    was = history.where(F.col("valid_to").isNull()).select(F.col(key).alias("_k"), F.struct(*values).alias("_o"), "valid_from", "rounds")
    now = snapshot.where(F.col(key).isNotNull()).select(F.col(key).alias("_n"), F.struct(*[F.col(c).cast(history.schema[c].dataType).alias(c) for c in values]).alias("_v"))
    j = was.join(now, F.col("_k") == F.col("_n"), "full_outer")
    known, seen = F.col("_k").isNotNull(), F.col("_n").isNotNull()
    same = known & seen & F.col("_o").eqNullSafe(F.col("_v"))

    def row(k: str, v: str, start: Column, end: Column, n: Column) -> Column:
        return F.struct(F.col(k).alias(key), *[F.col(f"{v}.{c}").alias(c) for c in values], start.alias("valid_from"), end.alias("valid_to"), n.alias("rounds"))

    never = F.lit(None).cast(history.schema["valid_from"].dataType)
    old = F.when(known, row("_k", "_o", F.col("valid_from"), F.when(same, never).otherwise(day), F.col("rounds") + F.when(same, 1).otherwise(0)))
    new = F.when(seen & ~same, row("_n", "_v", day, never, F.lit(1).cast("bigint")))
    return closed.unionByName(j.select(F.inline(F.array_compact(F.array(old, new)))))


def as_of(history: DataFrame, date) -> DataFrame:
    """The rows in force on a day."""
    day = F.lit(date).cast(history.schema["valid_from"].dataType)
    return history.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))


def as_of_join(rows: DataFrame, history: DataFrame, key: str, date: str, values: Sequence[str]) -> DataFrame:
    """Every row with the values in force on its own day, NULL without any.

    An equi-join by key; intervals of a product do not overlap, so at most one holds and rows stay one to one.
    """
    h = history.select(F.col(key).alias("_k"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.struct(*values).alias("_v"))
    holds = (F.col(key) == F.col("_k")) & (F.col(date) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(date) < F.col("_to")))
    return rows.join(h, holds, "left").select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_v.{c}").alias(f"as_of_{c}") for c in values])
