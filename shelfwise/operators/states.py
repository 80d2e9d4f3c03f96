"""Dated, mergeable states of a market: what a day's rows add up to, so that a period never rescans rows.

A day's state has two tables, both partitioned by ``snapshot_date``:

* ``sums``: per group the rows, per measure the count, sum, least and greatest value, a HyperLogLog sketch of the
  distinct keys and a KLL sketch of the measure's quantiles. Its size follows the groups.
* ``points``: per group and measure every value with its count, and per group every key with its count. It is exact and
  its size follows the distinct values; with ``exact=False`` it is not written.

A rerun of a day replaces that day's folders and nothing else. Any set of days merges by sums and sketch unions.
NULL and NaN measures count in no measure; a NULL key is no key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.distribution import join_on_keys, present, weighted_quantiles
from shelfwise.sources.sinks import write_days


def day_states(df: DataFrame, date: str, keys: Sequence[str], measures: Sequence[str], item: str) -> DataFrame:
    """The ``sums`` rows of all days in ``df``."""
    aggs = [F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(item).cast("string")).alias("items_hll")]
    for m in measures:
        v = F.when(present(F.col(m)), F.col(m).cast("double"))
        aggs += [F.count(v).alias(f"{m}_n"), F.sum(v).alias(f"{m}_sum"), F.min(v).alias(f"{m}_min"), F.max(v).alias(f"{m}_max"), F.kll_sketch_agg_double(v).alias(f"{m}_kll")]
    return df.groupBy(F.col(date).alias("snapshot_date"), *keys).agg(*aggs)


def day_points(df: DataFrame, date: str, keys: Sequence[str], measures: Sequence[str], item: str) -> DataFrame:
    """The ``points`` rows of all days in ``df``: ``(snapshot_date, keys, what, value, item, n)``."""
    entries = [F.struct(F.lit(m).alias("what"), F.when(present(F.col(m)), F.col(m).cast("double")).alias("value"), F.lit(None).cast("string").alias("item")) for m in measures]
    entries.append(F.struct(F.lit("").alias("what"), F.lit(None).cast("double").alias("value"), F.col(item).cast("string").alias("item")))
    long = df.select(F.col(date).alias("snapshot_date"), *keys, F.inline(F.array(*entries))).where(F.coalesce(F.col("value").cast("string"), F.col("item")).isNotNull())
    return long.groupBy("snapshot_date", *keys, "what", "value", "item").agg(F.count(F.lit(1)).alias("n"))


def write_states(df: DataFrame, path: str, date: str, keys: Sequence[str], measures: Sequence[str], item: str, exact: bool = True) -> None:
    """Write the states of the days in ``df``; days written before are replaced, all others stay as they are."""
    write_days(day_states(df, date, keys, measures, item), f"{path}/sums")
    if exact:
        write_days(day_points(df, date, keys, measures, item), f"{path}/points")


def merged(sums: DataFrame, keys: Sequence[str], measures: Sequence[str], probability: float = 0.5) -> DataFrame:
    """Days to one row per group: sums, means and extremes exactly, distinct keys and a quantile from the sketches."""
    aggs = [F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("items_hll")).alias("items_estimate")]
    for m in measures:
        total, rows = F.sum(f"{m}_sum"), F.sum(f"{m}_n")
        aggs += [total.alias(f"{m}_sum"), F.try_divide(total, rows).alias(f"{m}_mean"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max")]
        # a sketch without a value has no quantile
        sketch = F.kll_merge_agg_double(F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_kll")))
        aggs.append(F.when(rows > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(probability)))).alias(f"{m}_quantile_estimate"))
    return sums.groupBy(*keys).agg(*aggs)


def merged_exact(points: DataFrame, keys: Sequence[str], measures: Sequence[str], probability: float = 0.5) -> DataFrame:
    """Days to the exact number of distinct keys and the exact quantile of every measure per group."""
    counts = points.where(F.col("what") == "").groupBy(*keys, "item").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("items"))
    out = counts
    for m in measures:
        mine = points.where(F.col("what") == m).groupBy(*keys, F.col("value").alias("_v")).agg(F.sum("n").alias("_c"))
        out = join_on_keys(out, weighted_quantiles(mine, keys, {f"{m}_quantile": probability}), keys, "left")
    return out
