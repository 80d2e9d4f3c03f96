"""One row per key, top rows per group, unions with priority.

``row_number() <= k`` filters let Spark place a partial group limit before the shuffle, so a key that
holds a large share of all rows sends only ``k`` rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group; ``rank`` names an output column with the position."""
    name = rank or "_rn"
    w = Window.partitionBy(*[F.col(c) for c in keys]).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key in the given order."""
    return top_per_group(df, keys, order, 1)


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """Newest row per key; unparsable times sort last, ``ties`` make the choice total."""
    t = F.col(time) if dict(df.dtypes)[time] in ("timestamp", "date", "timestamp_ntz") else F.try_to_timestamp(F.col(time))
    return keep_one(df, keys, [t.desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties]])


def best_per_key(df: DataFrame, keys: Sequence[str], good: Column, time: str, ties: Sequence[str] = ()) -> DataFrame:
    """Prefer rows that satisfy ``good``, then the newest."""
    return keep_one(
        df, keys, [F.coalesce(good, F.lit(False)).desc(), F.col(time).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties]]
    )


def priority_union(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Union by name (absent columns NULL); an earlier frame beats a later one, then ``order`` decides."""
    tagged = [f.withColumn("_prio", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return keep_one(out, keys, [F.col("_prio").asc(), *order]).drop("_prio")


def distinct_products(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One product per combination of ``columns``, chosen by ``order`` (not arbitrarily)."""
    return keep_one(df, columns, order)


def duplicate_count(df: DataFrame, columns: Sequence[str], name: str = "duplicates") -> DataFrame:
    """Rows beyond the first of every combination, NULLs comparing equal.

    Grouping first and summing keeps one hot combination from reaching a single task.
    """
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias(name))
