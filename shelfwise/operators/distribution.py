"""Exact quantiles, percent ranks and positions inside groups, without a one-task-per-group step.

The rows of a group are first collapsed to ``(key, value, count)``.  Values are then cut into bins by their
distances from the group's minimum and maximum, both on a scale of ratios, so that one value far off at either
end leaves the others apart.  Bin totals give each bin its starting count, and only inside a bin are values
sorted.  NaN counts as NULL.  A group with a third of all rows is spread over its bins, and the
result is exact: bins only decide where work happens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTION = 4096


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on named keys; with no keys ``right`` is a global aggregate, that is exactly one row.

    Rows with a NULL key form no group, as in the grouping the operators reproduce.
    """
    if keys:
        return left.join(right, list(keys), how)
    row = right.select(F.struct("*").alias("_row")).scalar()
    added = [c for c in right.columns if c not in left.columns]
    return left.withColumn("_row", row).select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in added])


def present(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def _step(distance: Column) -> Column:
    """About 45 steps for every doubling; square roots are exactly rounded, so every executor agrees."""
    for _ in range(6):
        distance = F.sqrt(distance)
    return F.floor(distance * RESOLUTION)


def _binned(points: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``points(keys, _v, _c)`` with a bin column, and per-bin totals with their starting counts."""
    bounds = points.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    # both steps rise with the value, so a bin is a range of values
    v, lo, hi = (F.col(c).cast("double") for c in ("_v", "_lo", "_hi"))
    place = F.struct(_step(v - lo).alias("up"), (-_step(hi - v)).alias("down"))
    located = join_on_keys(points, bounds, keys, "inner").withColumn("_bin", place)
    totals = located.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_tot"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("_off", F.sum("_tot").over(w) - F.col("_tot"))
    return located.select(*keys, "_bin", "_v", "_c"), totals


def running_counts(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``points(keys, _v, _c)`` plus ``_cum`` (rows with value <= _v) and ``_n`` (rows of the group)."""
    located, totals = _binned(points, keys)
    joined = join_on_keys(located, totals.drop("_tot"), [*keys, "_bin"], "inner")
    w = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(*keys, "_v", "_c", (F.col("_off") + F.sum("_c").over(w)).alias("_cum"), "_n")


def quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Exact linearly interpolated quantiles.

    ``wanted`` maps an output name to ``(column, probability)``.  All columns go through one pass; groups
    without a value give NULL.  ``keys`` may be empty for a global quantile.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    ids = {c: i for i, c in enumerate(columns)}
    entries = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_v")) for c, i in ids.items()])
    long = df.select(*keys, F.inline(entries)).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    gkeys = [*keys, "_m"]
    points = long.groupBy(*gkeys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    located, totals = _binned(points, gkeys)

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_n") - 1)

    def covers(p: float) -> Column:
        lo, hi = F.floor(position(p)), F.ceil(position(p))
        return (F.col("_off") <= hi) & (F.col("_off") + F.col("_tot") > lo)

    probs = sorted({p for _, p in wanted.values()})
    need = None
    for p in probs:
        need = covers(p) if need is None else need | covers(p)
    # only the bins that hold a wanted position are sorted
    joined = join_on_keys(located, totals.where(need).drop("_tot"), [*gkeys, "_bin"], "inner")
    w = Window.partitionBy(*gkeys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = joined.withColumn("_cum", F.col("_off") + F.sum("_c").over(w))

    aggs = []
    for name, (c, p) in wanted.items():
        lo, hi, mine = F.floor(position(p)), F.ceil(position(p)), F.col("_m") == ids[c]
        at = lambda k: F.min(F.when(mine & (F.col("_cum") > k) & (F.col("_cum") - F.col("_c") <= k), F.col("_v")))
        low, high = at(lo), at(hi)
        part = F.max(F.when(mine, position(p) - lo))
        aggs.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def weighted_quantiles(points: DataFrame, keys: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of ``points(keys, _v, _c)``, values with their counts."""
    ranked = running_counts(points, keys)
    aggs = []
    for name, p in wanted.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        at = lambda k: F.min(F.when(F.col("_cum") > k, F.col("_v")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        aggs.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def with_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Attach :func:`quantiles` of ``df`` to a per-group table."""
    return join_on_keys(stats, quantiles(df, keys, wanted), keys, "left")


def add_ranks(df: DataFrame, keys: Sequence[str], value: str, percent: str | None = None, rank_desc: str | None = None, rank_asc: str | None = None) -> DataFrame:
    """Ranks of ``value`` in its group: average-tie percent rank, minimum rank descending or ascending.

    NULL and NaN keep a NULL rank.  The join back is on ``(keys, value)``; adaptive execution splits a
    value that dominates a group.
    """
    points = (
        df.where(present(F.col(value)))
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    r = running_counts(points, keys)
    out = []
    if percent:
        out.append(((F.col("_cum") - (F.col("_c") - 1) / 2) / F.col("_n")).alias(percent))
    if rank_desc:
        out.append((F.col("_n") - F.col("_cum") + 1).cast("bigint").alias(rank_desc))
    if rank_asc:
        out.append((F.col("_cum") - F.col("_c") + 1).cast("bigint").alias(rank_asc))
    return join_on_keys(df, r.select(*keys, F.col("_v").alias(value), *out), [*keys, value], "left")


def small_percent_rank(column: str | Column) -> Column:
    """Average-tie percent rank over a table of one row per group (a few thousand rows at most)."""
    c = F.col(column) if isinstance(column, str) else column
    w = Window.partitionBy(c.isNull()).orderBy(c)
    peers = Window.partitionBy(c)
    whole = Window.partitionBy(c.isNull())
    return F.when(c.isNotNull(), (F.rank().over(w) + (F.count(F.lit(1)).over(peers) - 1) / 2) / F.count(F.lit(1)).over(whole))


def min_max(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Min-max normalise columns per group: constant 1.0, all NULL 0.0, NULL in a mixed group stays NULL.

    The extremes are a small aggregate joined back, so no group is windowed in one task.
    """
    aggs = []
    for i, source in enumerate(columns.values()):
        aggs += [F.min(source).alias(f"_mn{i}"), F.max(source).alias(f"_mx{i}")]
    ext = df.groupBy(*keys).agg(*aggs)
    out = join_on_keys(df, ext, keys, "left")
    for i, (name, source) in enumerate(columns.items()):
        lo, hi = F.col(f"_mn{i}"), F.col(f"_mx{i}")
        out = out.withColumn(
            name, F.when(lo.isNull(), F.lit(0.0)).when(lo == hi, F.lit(1.0)).otherwise((F.col(source) - lo) / (hi - lo))
        )
    return out.drop(*[f"_m{k}{i}" for i in range(len(columns)) for k in "nx"])


def positions(targets: DataFrame, df: DataFrame, keys: Sequence[str], value: str, target_value: str, name: str) -> DataFrame:
    """Share of the group's values that are <= the target's value.

    Targets enter the distribution as points of weight zero, so no target is paired with the rows of its
    group.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    marks = targets.select(*keys, F.col(target_value).cast("double").alias("_v"), F.lit(0).cast("bigint").alias("_c"))
    points = rows.unionByName(marks).where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    r = running_counts(points, keys).select(*keys, F.col("_v").alias(target_value), F.try_divide(F.col("_cum"), F.col("_n")).alias(name))
    return join_on_keys(targets.withColumn(target_value, F.col(target_value).cast("double")), r, [*keys, target_value], "left")


def equal_width_bins(df: DataFrame, keys: Sequence[str], value: str, width: float, aggs: Sequence[Column], name: str = "bin") -> DataFrame:
    """Aggregate by right-open bins of ``width`` from 0, empty bins included up to the maximum of the group."""
    filled = (
        df.where(F.col(value).isNotNull() & (F.col(value) >= 0))
        .withColumn(name, F.floor(F.col(value) / F.lit(float(width))).cast("bigint"))
        .groupBy(*keys, name)
        .agg(*aggs)
    )
    top = filled.groupBy(*keys).agg(F.max(name).alias("_top"))
    spine = top.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_top"))).alias(name))
    return join_on_keys(spine, filled, [*keys, name], "left")
