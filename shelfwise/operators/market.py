"""Category, brand, band and promotion aggregates over a product table.

Column names follow the catalog schema: sku, title, shop, brand, level2, category, price, sales, comments,
promotion, weight_g, unit_price, discount_rate, flavor, package_type, is_gift, has_promotion.
Totals and thresholds enter as scalar subqueries, medians through :mod:`.distribution`.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.functions import words
from shelfwise.operators.dedupe import top_per_group
from shelfwise.operators.distribution import equal_width_bins, join_on_keys, quantiles, small_percent_rank, with_quantiles
from shelfwise.sources.staging import stage


def present(c: str) -> Column:
    """Value unless blank text."""
    return F.nullif(F.col(c), F.lit(""))


def mean_flag(c: str | Column) -> Column:
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("double"))


# --- counts, shares, concentration -------------------------------------------
def value_counts(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "n") -> DataFrame:
    return df.where(present(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias(name))


def top_values(df: DataFrame, column: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent values, ties by value; with ``keys`` the top ``k`` of every group and their ``rank``."""
    counts = value_counts(df, column, keys)
    order = [F.col("n").desc(), F.col(column).asc()]
    return top_per_group(counts, keys, order, k, "rank") if keys else counts.orderBy(*order).limit(k)


def top_value_text(df: DataFrame, column: str, k: int, keys: Sequence[str], name: str) -> DataFrame:
    """Top ``k`` values of every group joined into one text, most frequent first."""
    tops = top_values(df, column, k, keys)
    packed = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(column).cast("string").alias("v")))), lambda x: x["v"])
    return tops.groupBy(*keys).agg(F.array_join(packed, ";").alias(name))


def concentration(df: DataFrame, keys: Sequence[str], member: str, tops: Sequence[int] = (3, 5)) -> DataFrame:
    """Share of the ``n`` largest members of every group (``cr3``, ``cr5``)."""
    counts = df.where(F.col(member).isNotNull()).groupBy(*keys, member).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = top_per_group(counts, keys, [F.col("n").desc(), F.col(member).asc()], max(tops), "rank")
    heads = ranked.groupBy(*keys).agg(*[F.sum(F.when(F.col("rank") <= t, F.col("n")).otherwise(0)).alias(f"_h{t}") for t in tops])
    shares = [F.try_divide(F.col(f"_h{t}"), F.col("total")).alias(f"cr{t}") for t in tops]
    return totals.join(heads, list(keys), "left").select(*keys, *shares)


def share_of_total(df: DataFrame, by: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Count, share, sales sum, mean sales and mean price per value; ``labels`` keeps empty classes."""
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    out = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales_sum"), F.avg("sales").alias("sales_mean"), F.avg("price").alias("price_mean")
    )
    if labels is not None:
        out = label_frame(df, by, labels).join(out, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.col("n") / total)


def label_frame(df: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """A fixed label list as a one-column table."""
    return df.sparkSession.createDataFrame([(x,) for x in labels], f"{name} string")


def brand_tiers(df: DataFrame, keys: Sequence[str] = ("category",), k: int = 20) -> DataFrame:
    """Largest brands of a category with rank, share, running share and tier."""
    counts = df.groupBy(*keys, "brand").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = top_per_group(counts, keys, [F.col("n").desc(), F.col("brand").asc()], k, "rank").join(totals, list(keys))
    run = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.col("n") / F.col("total")
    tier = F.when(F.col("rank") <= 3, "head").when(F.col("rank") <= 10, "mid").otherwise("tail")
    return ranked.select(*keys, "brand", "n", "rank", share.alias("share"), (F.sum("n").over(run) / F.col("total")).alias("running_share"), tier.alias("tier"))


# --- category tables ----------------------------------------------------------
def category_baseline(df: DataFrame, key: str = "category") -> DataFrame:
    """Sizes, price and review statistics and brand concentration per category; one scan of ``df``."""
    df = stage(df.select(key, "sku", "brand", "shop", "price", "comments"))
    stats = df.groupBy(key).agg(
        F.count("sku").alias("items"),
        F.countDistinct("brand").alias("brands"),
        F.countDistinct(present("shop")).alias("shops"),
        F.avg("price").alias("price_mean"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        F.avg("comments").alias("comments_mean"),
        F.sum("comments").alias("comments_sum"),
        F.count("price").alias("with_price"),
        F.count("comments").alias("with_comments"),
    )
    stats = with_quantiles(stats, df, [key], {"price_median": ("price", 0.5), "comments_median": ("comments", 0.5)})
    cr = concentration(df, [key], "brand")
    return (
        stats.join(cr, key, "left")
        .withColumn("cr3", F.col("cr3") * 100)
        .withColumn("cr5", F.col("cr5") * 100)
        .withColumn("shop_density", F.try_divide(F.col("shops"), F.col("items")))
    )


def category_summary(df: DataFrame, key: str = "category", nulls_as_zero: bool = False) -> DataFrame:
    """SKU and brand counts, price and unit-price medians, demand sums and price-history coverage."""
    num = ["price", "unit_price", "sales", "comments", "negatives"]
    base = df.na.fill(0.0, num) if nulls_as_zero else df
    stats = base.groupBy(key).agg(
        F.countDistinct("sku").alias("items"),
        F.countDistinct("brand").alias("brands"),
        F.avg("price").alias("price_mean"),
        F.sum("sales").alias("sales_sum"),
        F.sum("comments").alias("comments_sum"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives_sum"),
        mean_flag(tx.nonempty("history_low")).alias("history_coverage"),
    )
    return with_quantiles(stats, base, [key], {"price_median": ("price", 0.5), "unit_price_median": ("unit_price", 0.5)})


def comparable(df: DataFrame) -> DataFrame:
    """Rows that can be compared by unit price."""
    return df.where((F.coalesce(F.col("brand"), F.lit("")) != "") & (F.col("price") > 0) & (F.col("weight_g") > 0))


def non_standard(df: DataFrame) -> DataFrame:
    """Rows without a usable weight."""
    return df.where(F.col("weight_g").isNull() | (F.col("weight_g") <= 0))


def valid_category(df: DataFrame) -> DataFrame:
    return df.where(~F.trim(F.coalesce(F.col("category"), F.lit(""))).isin("", words.UNCATEGORISED, words.UNKNOWN_CATEGORY))


def brand_strategy(df: DataFrame, k: int = 10) -> DataFrame:
    """Largest brands with mean price, mean unit price and median price."""
    rows = comparable(df)
    stats = rows.groupBy("brand").agg(F.count("title").alias("n"), F.avg("price").alias("price_mean"), F.avg("unit_price").alias("unit_price_mean"))
    top = stats.orderBy(F.col("n").desc(), F.col("brand").asc()).limit(k)
    # medians only for the brands that are reported
    kept = rows.join(F.broadcast(top.select("brand")), "brand", "left_semi")
    return with_quantiles(top, kept, ["brand"], {"price_median": ("price", 0.5)})


def price_spread(df: DataFrame, key: str = "level2") -> DataFrame:
    rows = df.where((F.col("price") > 0) & (F.col("weight_g") > 0) & (F.trim(F.coalesce(F.col(key), F.lit(""))) != ""))
    return rows.groupBy(F.trim(key).alias(key)).agg(
        F.count("title").alias("n"),
        F.avg("price").alias("price_mean"),
        F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("price_std"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        (F.max("price") - F.min("price")).alias("price_range"),
    )


def category_profile(df: DataFrame, min_rows: int = 5, k: int = 5) -> DataFrame:
    """Unit-price quartiles, usual specs, brands, flavours and packages, promotion and gift rates."""
    rows = df.where(F.col("unit_price").isNotNull() & F.col("category").isNotNull()).withColumn("spec", F.bround("weight_g", 0).cast("bigint").cast("string"))
    stats = (
        rows.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("unit_price").alias("mean"),
            F.min("unit_price").alias("min"),
            F.max("unit_price").alias("max"),
            mean_flag("has_promotion").alias("promotion_rate"),
            mean_flag("is_gift").alias("gift_rate"),
        )
        .where(F.col("n") >= min_rows)
    )
    stats = with_quantiles(stats, rows, ["category"], {"p25": ("unit_price", 0.25), "median": ("unit_price", 0.5), "p75": ("unit_price", 0.75)})
    for column, name in (("spec", "specs"), ("brand", "brands"), ("flavor", "flavors"), ("package_type", "packages")):
        stats = stats.join(top_value_text(rows, column, k, ["category"], name), "category", "left")
    return stats


def corpus_frequencies(df: DataFrame, dimensions: Mapping[str, int]) -> DataFrame:
    """Most frequent values per dimension as rows; ``dimensions`` maps a column to its list length."""
    wide = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    long = df.select(F.inline(wide)).where(present("value").isNotNull())
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_per_group(counts, ["dimension"], [F.col("n").desc(), F.col("value").asc()], max(dimensions.values()), "rank")
    keep = None
    for d, k in dimensions.items():
        c = (F.col("dimension") == d) & (F.col("rank") <= k)
        keep = c if keep is None else keep | c
    return ranked.where(keep)


# --- opportunity --------------------------------------------------------------
def opportunity_base(df: DataFrame, min_items: int = 30) -> DataFrame:
    rows = valid_category(df)
    stats = (
        rows.groupBy("category")
        .agg(
            F.countDistinct("sku").alias("items"),
            F.countDistinct("brand").alias("brands"),
            F.countDistinct(present("shop")).alias("shops"),
            F.avg("price").alias("price_mean"),
            F.sum("sales").alias("sales_sum"),
            F.sum("comments").alias("comments_sum"),
            F.avg("comments").alias("comments_mean"),
            mean_flag("has_promotion").alias("promotion_share"),
        )
        .where(F.col("items") >= min_items)
    )
    return with_quantiles(stats, rows, ["category"], {"price_median": ("price", 0.5), "unit_price_median": ("unit_price", 0.5)})


def opportunity_scores(df: DataFrame, min_items: int = 30, profile: str = "balanced") -> DataFrame:
    """Scarcity, demand, price health, competition ease and promotion elasticity of every category, one score.

    The percent ranks run over one row per category.
    """
    s = opportunity_base(df, min_items).withColumn("items_per_brand", F.try_divide(F.col("items"), F.col("brands")))
    rank = small_percent_rank
    s = s.select(
        "*",
        (1 - rank("items")).alias("scarcity"),
        (rank("sales_sum") * 0.55 + rank("comments_sum") * 0.35 + rank("comments_mean") * 0.10).alias("demand"),
        (1 - F.coalesce(rank(F.nullif(F.col("unit_price_median"), F.lit(0.0))), F.lit(0.5))).alias("price_health"),
        (1 - F.coalesce(rank("items_per_brand"), F.lit(0.5))).alias("competition_ease"),
        rank(F.coalesce(F.col("promotion_share"), F.lit(0.0))).alias("promo_elasticity"),
    )
    score = sum(F.col(n) * w for n, w in words.OPPORTUNITY_WEIGHTS[profile].items())
    first, hot, blue, rest = words.OPPORTUNITY_LABELS
    hot_demand = F.col("demand") >= 0.70
    verdict = (
        F.when(hot_demand & (F.col("scarcity") >= 0.45), first).when(hot_demand, hot).when(F.col("scarcity") >= 0.70, blue).otherwise(rest)
    )
    out = s.withColumn("score", score * 100).withColumn("verdict", verdict)
    action = None
    for label, act in zip(words.OPPORTUNITY_LABELS, words.OPPORTUNITY_ACTIONS):
        c = F.col("verdict") == label
        action = F.when(c, act) if action is None else action.when(c, act)
    return out.withColumn("action", action)


# --- promotions ---------------------------------------------------------------
def promotion_summary(df: DataFrame) -> DataFrame:
    """Products and mean sales per promotion class; a product with several classes counts in each."""
    tags = df.select("sku", "sales", F.explode(tx.promotion_keywords("promotion")).alias("keyword"))
    return tags.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("sales", F.lit(0.0))).alias("sales_mean"))


def promotion_compare(df: DataFrame) -> DataFrame:
    flag = F.size(tx.promotion_keywords("promotion")) > 0
    return df.groupBy(flag.alias("promoted")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("sales", F.lit(0.0))).alias("sales_mean"))


def promotion_effect(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sales by promotion class against the unpromoted products (overall mean where there are none); one scan of ``df``."""
    rows = stage(df.select(*keys, "sku", "sales", "comments", "discount_rate", tx.promotion_kind("promotion").alias("promo_type")))
    base = rows.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("promo_type") == words.NO_PROMOTION, F.col("sales"))), F.avg("sales"), F.lit(0.0)).alias("_base"),
        F.count(F.lit(1)).alias("_all"),
    )
    stats = rows.groupBy(*keys, "promo_type").agg(
        F.count("sku").alias("n"),
        F.avg("sales").alias("sales_mean"),
        F.avg("comments").alias("comments_mean"),
        F.avg("discount_rate").alias("discount_mean"),
    )
    stats = with_quantiles(stats, rows, [*keys, "promo_type"], {"sales_median": ("sales", 0.5)})
    joined = join_on_keys(stats, base, keys, "inner")
    ratio = F.when(F.col("_base") > 0, F.col("sales_mean") / F.col("_base"))
    return joined.withColumn("lift", ratio - 1).withColumn("lift_multiple", ratio).withColumn("share", F.col("n") / F.col("_all")).drop("_base", "_all")


def positive_sales_stats(df: DataFrame) -> DataFrame:
    """Promoted and plain product counts with their mean positive sales."""
    flag = tx.has_promotion("promotion")
    pos = F.when(F.col("sales") > 0, F.col("sales"))
    return df.groupBy(flag.alias("promoted")).agg(F.count(F.lit(1)).alias("n"), F.count(pos).alias("selling"), F.avg(pos).alias("sales_mean"))


def keyword_hits(df: DataFrame, column: str, terms: Sequence[str]) -> DataFrame:
    """Occurrences of every term over the whole column, one scan for all terms."""
    aggs = [F.sum(F.regexp_count(F.col(column), F.lit(re.escape(t)))).alias(f"t{i}") for i, t in enumerate(terms)]
    wide = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("hits")) for i, t in enumerate(terms)])
    return wide.select(F.inline(pairs))


# --- bands, cross tables ------------------------------------------------------
def tercile_bands(df: DataFrame, key: str = "category", value: str = "price", name: str = "price_band") -> DataFrame:
    """Low, middle, high price of the own category by its 33rd and 66th percentile (right-closed).

    Fewer than three distinct prices give the middle band; equal cuts compare with the median.  Run it
    after the product key is unique, or duplicates weigh on the cuts.
    """
    low, mid, high = words.TERCILE_LABELS
    q = quantiles(df, [key], {"_q1": (value, 0.33), "_q2": (value, 0.66), "_med": (value, 0.5)})
    distinct = df.groupBy(key).agg(F.countDistinct(value).alias("_d"))
    out = df.join(distinct.join(q, key, "left"), key, "left")
    v = F.col(value)
    band = (
        F.when(F.col("_d") < 3, F.lit(mid))
        .when(v.isNull(), F.lit(words.UNKNOWN_BAND))
        .when(F.col("_q1") >= F.col("_q2"), F.when(v < F.col("_med"), low).when(v > F.col("_med"), high).otherwise(mid))
        .when(v <= F.col("_q1"), low)
        .when(v <= F.col("_q2"), mid)
        .otherwise(high)
    )
    return out.withColumn(name, F.coalesce(band, F.lit(words.UNKNOWN_BAND))).drop("_q1", "_q2", "_med", "_d")


def band_cross(df: DataFrame, keys: Sequence[str] = ("category", "price_band")) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("sku").alias("n"), F.sum("sales").alias("sales_sum"), F.avg("sales").alias("sales_mean"), F.avg("price").alias("price_mean")
    )


def band_pivot(df: DataFrame, labels: Sequence[str], k: int = 12) -> DataFrame:
    """Sales of the ``k`` best selling categories by band, absent cells 0, fixed columns."""
    cells = df.groupBy("category").pivot("price_band", list(labels)).agg(F.sum("sales")).na.fill(0.0)
    top = df.groupBy("category").agg(F.sum("sales").alias("_s")).orderBy(F.col("_s").desc(), F.col("category").asc()).limit(k)
    return cells.join(F.broadcast(top.select("category")), "category", "left_semi")


def brand_band_crosstab(df: DataFrame, labels: Sequence[str], k: int = 8) -> DataFrame:
    """Counts of the ``k`` most frequent brands of every category by band."""
    tops = top_per_group(
        df.groupBy("category", "brand").agg(F.count(F.lit(1)).alias("n")), ["category"], [F.col("n").desc(), F.col("brand").asc()], k, "rank"
    )
    cells = df.groupBy("category", "brand").pivot("price_band", list(labels)).agg(F.count(F.lit(1))).na.fill(0)
    return cells.join(tops.select("category", "brand", "rank"), ["category", "brand"])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "metric", "value")


def competition_index(df: DataFrame) -> DataFrame:
    """Concentration, size, shops and band variety of every category as one 0-100 index."""
    stats = df.groupBy("category").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct(present("shop")).alias("shops"), F.countDistinct("price_band").alias("bands")
    )
    out = stats.join(concentration(df, ["category"], "brand"), "category", "left")
    one = F.lit(1.0)
    index = (
        (1 - F.col("cr3")) * 40
        + F.least(F.col("items") / 300, one) * 25
        + F.least(F.col("shops") / 100, one) * 25
        + F.least(F.col("bands") / 3, one) * 10
    )
    return out.withColumn("density", F.col("shops") / F.col("items")).withColumn("competition_index", index)


def price_gaps(df: DataFrame, width: float = 5.0) -> DataFrame:
    """Supply and demand per price bin of every category against the category medians, with a verdict.

    Also carries the blue-ocean index, demand over competition plus one.
    """
    bins = equal_width_bins(
        df,
        ["category"],
        "price",
        width,
        [
            F.count("sku").alias("items"),
            F.avg("comments").alias("comments_mean"),
            F.avg("sales").alias("sales_mean"),
            F.sum("comments").alias("demand"),
        ],
    ).na.fill(0, ["items", "demand"])
    out = with_quantiles(bins, bins, ["category"], {"items_median": ("items", 0.5), "demand_median": ("demand", 0.5)})
    blue, red, plain = words.GAP_LABELS
    wanted = F.col("demand") >= F.col("demand_median")
    verdict = F.when(wanted & (F.col("items") <= F.col("items_median")), blue).when(wanted, red).otherwise(plain)
    return out.withColumn("verdict", verdict).withColumn("blue_ocean_index", F.col("demand") / (F.col("items") + 1))


def brand_coverage(df: DataFrame) -> DataFrame:
    """SKUs, covered bands and number of flavours per category and brand."""
    return df.groupBy("category", "brand").agg(
        F.count("sku").alias("n"),
        F.array_join(F.sort_array(F.collect_set("price_band")), "、").alias("bands"),
        F.countDistinct(present("flavor")).alias("flavors"),
    )


def brand_portfolio(df: DataFrame, owned: DataFrame, k: int = 15, max_flavors: int = 10) -> DataFrame:
    """Brands that would fill the bands and flavours an owned assortment lacks, best ``k`` per category.

    ``owned`` is ``(category, brand)``.  Missing values are found by anti-joins on the distinct
    ``(category, value)`` lists, candidate brands scored by semi-joins against them.
    """
    mine = df.join(owned.select("category", "brand").distinct(), ["category", "brand"], "left_semi")
    rest = df.join(owned.select("category", "brand").distinct(), ["category", "brand"], "left_anti")

    def missing(column: str) -> DataFrame:
        every = df.where(present(column).isNotNull()).select("category", column).distinct()
        have = mine.where(present(column).isNotNull()).select("category", column).distinct()
        return every.join(have, ["category", column], "left_anti")

    gaps_b = missing("price_band")
    gaps_f = top_per_group(missing("flavor"), ["category"], [F.col("flavor").asc()], max_flavors)
    sizes = rest.groupBy("category", "brand").agg(F.count(F.lit(1)).alias("n"))

    def filled(gaps: DataFrame, column: str, name: str) -> DataFrame:
        hits = rest.select("category", "brand", column).distinct().join(gaps, ["category", column], "left_semi")
        return hits.groupBy("category", "brand").agg(
            F.count(F.lit(1)).alias(f"n_{name}"), F.array_join(F.sort_array(F.collect_set(column)), "、").alias(name)
        )

    out = sizes.join(filled(gaps_b, "price_band", "bands"), ["category", "brand"], "left").join(
        filled(gaps_f, "flavor", "flavors"), ["category", "brand"], "left"
    )
    score = F.coalesce("n_bands", F.lit(0)) * 25 + F.coalesce("n_flavors", F.lit(0)) * 10 + F.least(F.col("n"), F.lit(20))
    scored = out.select("category", "brand", "n", F.coalesce("bands", F.lit("")).alias("bands"), F.coalesce("flavors", F.lit("")).alias("flavors"), score.alias("score"))
    return top_per_group(scored, ["category"], [F.col("score").desc(), F.col("n").desc(), F.col("brand").asc()], k, "rank")


# --- report tables ------------------------------------------------------------
def store_summary(df: DataFrame) -> DataFrame:
    """Self-operated against third-party shops: shares, plain and sales-weighted prices, coupons; one scan of ``df``."""
    rows = stage(df.select("price", "sales", "comments", "promotion", tx.store_type("shop").alias("store_type")))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("s"))
    weight = F.coalesce(F.col("sales"), F.lit(0.0))
    stats = rows.groupBy("store_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("price").alias("price_mean"),
        F.avg("sales").alias("sales_mean"),
        F.sum("sales").alias("sales_sum"),
        F.when(F.sum(weight) > 0, F.sum(F.col("price") * weight) / F.sum(weight)).otherwise(F.avg("price")).alias("weighted_price"),
        F.avg("comments").alias("comments_mean"),
        mean_flag(tx.matches_flag("promotion", words.COUPON_PATTERN)).alias("coupon_share"),
    )
    stats = with_quantiles(stats, rows, ["store_type"], {"price_median": ("price", 0.5), "sales_median": ("sales", 0.5)})
    return stats.withColumn("share", F.col("n") / totals.select("n").scalar()).withColumn("sales_share", F.col("sales_sum") / totals.select("s").scalar())


def hot_profile(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Profile of the products at or above a sales quantile, one row."""
    # five reports read the hot set, and the threshold is asked for twice
    cut = stage(quantiles(df, [], {"threshold": ("sales", share)}))
    hot = stage(df.where(F.col("sales") >= cut.scalar()).select("category", "price_band", "price", "shop", "promotion"))
    stats = hot.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("price").alias("price_mean"),
        mean_flag(tx.store_type("shop") == words.SELF_OPERATED).alias("self_share"),
        mean_flag(tx.matches_flag("promotion", words.COUPON_PATTERN)).alias("coupon_share"),
    )
    modes = []
    for column, name in (("category", "top_category"), ("price_band", "top_band")):
        top = top_values(hot, column, 1)
        modes += [top.select(column).scalar().alias(name), top.select("n").scalar().alias(f"{name}_n")]
    median = quantiles(hot, [], {"m": ("price", 0.5)}).scalar().alias("price_median")
    return stats.select(cut.scalar().alias("threshold"), "*", median, *modes)


def market_kpis(df: DataFrame, high_price: float = 100.0, k: int = 10) -> DataFrame:
    """Market totals in one row; one scan of ``df``."""
    df = stage(df.select("brand", "price", "sales"))
    stats = df.agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("sales").alias("sales_sum"),
        F.avg("price").alias("price_mean"),
        F.avg("sales").alias("sales_mean"),
        F.count_if(F.col("price") >= high_price).alias("high_price_items"),
        mean_flag(F.coalesce(F.col("price") >= high_price, F.lit(False))).alias("high_price_share"),
    )
    q = quantiles(df, [], {"price_median": ("price", 0.5), "sales_median": ("sales", 0.5)})
    medians = q.select(F.struct("price_median", "sales_median").alias("m")).scalar()
    heads = top_values(df, "brand", k).agg(F.sum("n").alias("n"))
    return stats.select(
        "*",
        medians.getField("price_median").alias("price_median"),
        medians.getField("sales_median").alias("sales_median"),
        (heads.scalar() / F.col("items")).alias("top_brand_share"),
    )


def ocean_lists(df: DataFrame, k: int = 10, floor: int = 20, share: float = 0.005) -> DataFrame:
    """Crowded categories (largest ``k``) and sparse ones (at most ``max(floor, ceil(share * N))`` items)."""
    stats = df.groupBy("category").agg(F.count("sku").alias("n"), F.avg("sales").alias("sales_mean"))
    limit = df.agg(F.greatest(F.lit(floor), F.ceil(F.count(F.lit(1)) * share)).alias("m")).scalar()
    red = stats.orderBy(F.col("n").desc(), F.col("category").asc()).limit(k).withColumn("list", F.lit("red"))
    blue = stats.where(F.col("n") <= limit).orderBy(F.col("n").asc(), F.col("sales_mean").desc(), F.col("category").asc()).limit(k).withColumn("list", F.lit("blue"))
    return red.unionByName(blue)


def category_detail(df: DataFrame, top_brands: int = 10, low: float = 0.0, high: float = 10000.0) -> DataFrame:
    """Count, price range within sane limits and most frequent brands of every category."""
    sane = F.when((F.col("price") > low) & (F.col("price") < high), F.col("price"))
    stats = df.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min(sane).alias("price_min"), F.max(sane).alias("price_max"), F.floor(F.avg(sane) + 0.5).alias("price_avg")
    )
    return stats.join(top_value_text(df, "brand", top_brands, ["category"], "brands"), "category", "left")


def brand_detail(df: DataFrame, top_categories: int = 10) -> DataFrame:
    """Products, rounded mean price and most frequent categories of every brand."""
    rows = df.withColumn("_cat", F.coalesce(present("level2"), F.col("category")))
    stats = rows.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg(F.coalesce("price", F.lit(0.0))) + 0.5).alias("price_avg"))
    return stats.join(top_value_text(rows, "_cat", top_categories, ["brand"], "categories"), "brand", "left")


def option_counts(df: DataFrame, keys: Sequence[str] = ("brand",), columns: Sequence[str] = ("level2", "category")) -> DataFrame:
    """How often each option value occurs under its parent, over several columns at once."""
    values = df.select(*keys, F.explode(F.array(*[F.trim(F.col(c)) for c in columns])).alias("option"))
    return value_counts(values, "option", keys)


def clearance_plans(df: DataFrame, key: str = "category") -> DataFrame:
    """Three clearance prices per category from its rounded mean price."""
    mean = df.groupBy(key).agg(F.floor(F.avg("price") + 0.5).alias("price_avg"))
    plans = F.array(*[F.struct(F.lit(n).alias("plan"), F.lit(f).alias("factor"), F.lit(d).alias("days")) for n, f, d in words.CLEARANCE_FACTORS])
    return mean.select(key, "price_avg", F.inline(plans)).withColumn("plan_price", F.floor(F.col("price_avg") * F.col("factor") + 0.5).cast("bigint"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table as rows."""
    out = None
    for name, t in tables.items():
        row = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out
