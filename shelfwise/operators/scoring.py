"""Product scores, unit-price comparison and product analysis against the own category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.functions import words
from shelfwise.operators.dedupe import keep_one, top_per_group
from shelfwise.operators.distribution import add_ranks, join_on_keys, min_max, positions, quantiles
from shelfwise.sources.staging import stage


def keyword_filter(df: DataFrame, keyword: str, columns: Sequence[str] = ("level2", "category", "title"), regex: bool = False) -> DataFrame:
    """Rows with the keyword in any column: literal by default, case-blind regex on request. Blank finds nothing."""
    if not keyword.strip():
        return df.where(F.lit(False))
    hit = F.lit(False)
    for c in columns:
        m = F.col(c).rlike(f"(?i){keyword}") if regex else F.contains(F.col(c), F.lit(keyword))
        hit = hit | F.coalesce(m, F.lit(False))
    return df.where(hit)


# --- comparison ---------------------------------------------------------------
def price_table(df: DataFrame, keys: Sequence[str] = ("brand", "category"), k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Cheapest ``k`` per group by unit price, and a status row per group.

    Status: ``ok``, ``no_standard_weight`` or ``no_valid_price``; a group that is absent is ``no_match``.
    """
    weighed = F.col("weight_g") > 0
    usable = weighed & (F.col("price") > 0)
    status = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"), F.count_if(weighed).alias("weighed"), F.count_if(usable).alias("usable"))
    status = status.withColumn("status", F.when(F.col("usable") > 0, "ok").when(F.col("weighed") == 0, "no_standard_weight").otherwise("no_valid_price"))
    rows = df.where(usable).withColumn("unit_price", F.col("price") / F.col("weight_g"))
    return top_per_group(rows, keys, [F.col("unit_price").asc(), F.col("sku").asc()], k, "rank"), status


def store_extremes(df: DataFrame, keys: Sequence[str] = ("brand", "category"), ties: Sequence[str] = ("shop", "sku")) -> DataFrame:
    """Cheapest and dearest shop of every group over all its offers, gap and gap rate."""
    rows = df.where((F.col("price") > 0) & (F.col("weight_g") > 0)).withColumn("u", F.col("price") / F.col("weight_g"))
    lo = F.min(F.struct("u", *ties))
    hi = F.max(F.struct("u", *ties))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), lo.alias("lo"), hi.alias("hi"))
    gap = F.col("hi.u") - F.col("lo.u")
    return out.select(
        *keys, "n",
        F.col(f"lo.{ties[0]}").alias("cheapest_shop"), F.col("lo.u").alias("cheapest"),
        F.col(f"hi.{ties[0]}").alias("dearest_shop"), F.col("hi.u").alias("dearest"),
        gap.alias("gap"), F.try_divide(gap, F.col("lo.u")).alias("gap_rate"),
    )


# --- scores -------------------------------------------------------------------
def selection_score(df: DataFrame, keys: Sequence[str] = ("category",), price_weight: float = 0.7, top: int | None = None) -> DataFrame:
    """Cheap and well selling: weighted min-max of inverse unit price and of sales inside the group."""
    w = min(max(float(price_weight), 0.0), 1.0)
    rows = df.where((F.col("unit_price") > 0) & (F.col("sales") > 0)).withColumn("_inv", 1 / F.col("unit_price"))
    scored = min_max(rows, keys, {"price_norm": "_inv", "sales_norm": "sales"}).drop("_inv")
    scored = scored.withColumn("final_score", F.col("price_norm") * w + F.col("sales_norm") * (1 - w))
    if top is None:
        return scored
    return top_per_group(scored, keys, [tx.stable_round("final_score", 6).desc(), F.col("sku").asc()], top, "rank")


def value_score(df: DataFrame, key: str = "category", ranked: bool = True) -> DataFrame:
    """``100 - 40 * unit-price rank - 30 * discount + 0.3 * comment heat`` clipped to 0-100, with the category rank."""
    heat = df.groupBy(key).agg(F.greatest(F.max("comments"), F.lit(1.0)).alias("_max"))
    rows = add_ranks(df, [key], "unit_price", percent="_pct")
    rows = join_on_keys(rows, heat, [key])
    raw = (
        100
        - F.coalesce(F.col("_pct"), F.lit(1.0)) * 100 * 0.40
        - F.coalesce(F.col("discount_rate"), F.lit(0.0)) * 30
        + F.least(F.coalesce(F.col("comments"), F.lit(0.0)) / F.col("_max") * 100, F.lit(100.0)) * 0.30
    )
    scored = rows.withColumn("unit_price_percentile", F.coalesce(F.col("_pct"), F.lit(1.0)) * 100)
    scored = scored.withColumn("value_score", tx.stable_round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 2)).drop("_pct", "_max")
    # the second ranking reads the scores three times
    return add_ranks(stage(scored), [key], "value_score", rank_desc="category_rank") if ranked else scored


PRODUCT_KEY = ("title", "price", "weight_g")


def reference_score(df: DataFrame, key: str = "category", top: int | None = 10, keyword_count: str | None = "keyword_count") -> DataFrame:
    """0.45 price rank + 0.35 sales rank + 0.20 structure quality over distinct products."""
    rows = keep_one(df.where(F.col("unit_price").isNotNull()), [key, *PRODUCT_KEY], [F.col("sku").asc()])
    rows = add_ranks(add_ranks(rows, [key], "unit_price", percent="_p"), [key], "sales", percent="_s")
    structure = (
        (F.coalesce(F.col("brand_match_status"), F.lit("")) == "consistent").cast("double") * 0.4
        + (F.coalesce(F.col("weight_match_status"), F.lit("")) == "consistent").cast("double") * 0.4
        + F.least(F.col(keyword_count), F.lit(8)) / 8 * 0.2
    )
    scored = rows.withColumn("selection_score", (1 - F.col("_p")) * 0.45 + F.col("_s") * 0.35 + structure * 0.20).drop("_p", "_s")
    if top is None:
        return scored
    return top_per_group(scored, [key], [tx.stable_round("selection_score", 6).desc(), F.col("sku").asc()], top, "rank")


# --- analysis of target products ---------------------------------------------
def market_position(targets: DataFrame, df: DataFrame, min_rows: int = 5) -> DataFrame:
    """Where a target's unit price sits in its category: percentile, quartiles, ratio to the mean, label."""
    rows = df.where(F.col("unit_price").isNotNull())
    marks = targets.withColumn("target_unit", tx.unit_price("price", "weight_g"))
    placed = positions(marks, rows, ["category"], "unit_price", "target_unit", "percentile")
    stats = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("unit_price").alias("mean"))
    q = quantiles(rows, ["category"], {"q25": ("unit_price", 0.25), "q50": ("unit_price", 0.5), "q75": ("unit_price", 0.75)})
    out = placed.join(stats.join(q, "category"), "category")
    low, mid, high = words.POSITION_LABELS
    enough = F.col("n") >= min_rows
    p = F.col("percentile") * 100
    return out.select(
        "target_id", "category", "target_unit", "n",
        F.when(enough, p).alias("percentile"),
        F.when(enough, F.when(p < 25, low).when(p > 75, high).otherwise(mid)).alias("position"),
        "q25", "q50", "q75",
        F.try_divide(F.col("target_unit"), F.col("mean")).alias("mean_ratio"),
        tx.confidence_label("n").alias("confidence"),
    )


def _gap(x: Column, lo: Column, hi: Column) -> Column:
    """Distance of a point to an interval."""
    return F.greatest(lo - x, x - hi, F.lit(0.0))


def similar_products(targets: DataFrame, df: DataFrame, k: int = 20, bins: int = 32) -> DataFrame:
    """The ``k`` most similar products of every target, exactly, without pairing it with its whole category.

    Distance is relative weight gap plus unit-price gap minus tag bonuses (flavour 0.20, package 0.10);
    the weight gap must stay within 100 % unless fewer than ``min(5, n)`` products do.

    Products are first grouped into cells of weight and unit price with exact extremes and counts.  Cell
    bounds give every target a radius that surely holds ``k`` products; only products of cells that reach
    into the radius are scored.
    """
    rows = keep_one(df.where(F.col("unit_price").isNotNull()), ["category", *PRODUCT_KEY], [F.col("sku").asc()])
    ext = rows.groupBy("category").agg(
        F.min("weight_g").alias("_w0"), F.max("weight_g").alias("_w1"), F.min("unit_price").alias("_u0"), F.max("unit_price").alias("_u1"), F.count(F.lit(1)).alias("_n")
    )

    def place(v: str, lo: str, hi: str) -> Column:
        f = F.coalesce(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
        return F.least(F.floor(F.sqrt(F.sqrt(f)) * bins), F.lit(bins - 1)).cast("int")

    located = rows.join(ext, "category").withColumn("_cw", place("weight_g", "_w0", "_w1")).withColumn("_cu", place("unit_price", "_u0", "_u1"))
    cells = located.groupBy("category", "_cw", "_cu").agg(
        F.min("weight_g").alias("_wlo"), F.max("weight_g").alias("_whi"), F.min("unit_price").alias("_ulo"), F.max("unit_price").alias("_uhi"),
        F.count(F.lit(1)).alias("_cnt"), F.first("_n").alias("_n"),
    )
    t = targets.select(
        "target_id", "category", F.col("weight_g").alias("t_weight"), tx.unit_price("price", "weight_g").alias("t_unit"),
        F.coalesce("flavor", F.lit("")).alias("t_flavor"), F.coalesce("package_type", F.lit("")).alias("t_package"), F.col("brand").alias("t_brand"),
    ).where(F.col("t_unit").isNotNull()).withColumn("t_reach", F.col("t_weight") * 2)
    # products within twice the target weight, counted through the weight distribution
    near = positions(t.select("target_id", "category", "t_reach"), rows, ["category"], "weight_g", "t_reach", "_share").select("target_id", "_share")
    t = t.join(near, "target_id")
    near_n = F.floor(F.col("_share") * F.col("_n") + 0.5)
    tc = t.join(cells, "category").withColumn("free", near_n < F.least(F.lit(5), F.col("_n")))
    w, u = F.col("t_weight"), F.col("t_unit")
    bonus = F.when(F.col("t_flavor") != "", 0.20).otherwise(0.0) + F.when(F.col("t_package") != "", 0.10).otherwise(0.0)
    nearest = _gap(w, F.col("_wlo"), F.col("_whi")) / w + _gap(u, F.col("_ulo"), F.col("_uhi")) - bonus
    farthest = F.greatest(F.abs(F.col("_wlo") - w), F.abs(F.col("_whi") - w)) / w + F.greatest(F.abs(F.col("_ulo") - u), F.abs(F.col("_uhi") - u))
    tc = tc.withColumn("_near", nearest).withColumn("_far", farthest)
    inside = F.col("free") | (F.col("_whi") <= F.col("t_reach"))
    tc = tc.where(F.col("free") | (F.col("_wlo") <= F.col("t_reach")))
    by_far = Window.partitionBy("target_id").orderBy(inside.desc(), F.col("_far").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tc = tc.withColumn("_have", F.sum(F.when(inside, F.col("_cnt")).otherwise(0)).over(by_far))
    radius = tc.groupBy("target_id").agg(F.min(F.when(inside & (F.col("_have") >= k), F.col("_far"))).alias("_r"))
    chosen = tc.join(radius, "target_id").where(F.col("_r").isNull() | (F.col("_near") <= F.col("_r") + 1e-9))
    chosen = chosen.select("target_id", "category", "_cw", "_cu", "t_weight", "t_unit", "t_flavor", "t_package", "t_brand", "free")

    items = located.select("category", "_cw", "_cu", "sku", "title", "brand", "price", "weight_g", "unit_price", "flavor", "package_type", "has_promotion")
    pairs = items.join(chosen, ["category", "_cw", "_cu"])
    weight_gap = F.abs(F.col("weight_g") - F.col("t_weight")) / F.col("t_weight")
    tag = F.when((F.col("t_flavor") != "") & F.contains(F.coalesce("flavor", F.lit("")), F.col("t_flavor")), 0.20).otherwise(0.0) + F.when(
        (F.col("t_package") != "") & F.contains(F.coalesce("package_type", F.lit("")), F.col("t_package")), 0.10
    ).otherwise(0.0)
    scored = pairs.withColumn("weight_gap", weight_gap).where(F.col("free") | (F.col("weight_gap") <= 1.0))
    scored = scored.withColumn("distance", F.col("weight_gap") + F.abs(F.col("unit_price") - F.col("t_unit")) - tag)
    order = [tx.stable_round("distance", 6).asc(), tx.stable_round("unit_price", 6).asc(), F.col("sku").asc()]
    return top_per_group(scored, ["target_id"], order, k, "rank").drop("_cw", "_cu", "free")


def competitiveness(targets: DataFrame, df: DataFrame, k: int = 20) -> DataFrame:
    """Share of similar products that are dearer, stars, promotion pressure, same-brand median, main rivals."""
    sim = stage(similar_products(targets, df, k))
    dearer = F.count_if(F.col("unit_price") > F.col("t_unit"))
    n = F.count(F.lit(1))
    same = F.when(F.contains(F.coalesce("brand", F.lit("")), F.col("t_brand")) & (F.col("t_brand") != ""), F.col("unit_price"))
    # at most k rows per target reach this aggregate
    stats = sim.groupBy("target_id").agg(
        n.alias("n"), (dearer / n).alias("beat_rate"), F.avg(F.col("has_promotion").cast("double")).alias("promotion_rate"),
        F.count(same).alias("same_brand_n"), F.percentile(same, F.lit(0.5)).alias("same_brand_median"), F.first("t_unit").alias("t_unit"),
    )
    brands = top_per_group(sim.groupBy("target_id", "brand").agg(F.count(F.lit(1)).alias("c")), ["target_id"], [F.col("c").desc(), F.col("brand").asc()], 3, "r")
    rivals = brands.groupBy("target_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "brand"))), lambda x: x["brand"]), ";").alias("rivals"))
    stars = F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.col("beat_rate") * 4).cast("int") + 1))
    judged = F.col("same_brand_n") >= 3
    advantages = F.concat_ws(
        ";", F.when(F.col("beat_rate") >= 0.6, F.lit("cheaper_than_most")), F.when(judged & (F.col("t_unit") <= F.col("same_brand_median")), F.lit("below_brand_median"))
    )
    risks = F.concat_ws(
        ";", F.when(F.col("beat_rate") < 0.6, F.lit("no_price_edge")), F.when(judged & (F.col("t_unit") > F.col("same_brand_median")), F.lit("above_brand_median")),
        F.when(F.col("promotion_rate") >= 0.5, F.lit("promotion_pressure")),
    )
    out = stats.join(rivals, "target_id").withColumn("stars", stars).withColumn("advantages", advantages).withColumn("risks", risks)
    return out.withColumn("confidence", tx.confidence_label("n")).withColumn("enough", F.col("n") >= 3)


def band_opportunities(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """Per category and fixed price band: count, share, mean sales and whether it is a gap or crowded."""
    bounds, labels = words.POSITION_BANDS
    rows = df.where(F.col("unit_price").isNotNull()).withColumn("band", tx.band("price", bounds, labels))
    stats = rows.groupBy("category").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_rows)
    stats = join_on_keys(stats, quantiles(rows, ["category"], {"sales_median": ("sales", 0.5)}), ["category"])
    bands = rows.groupBy("category", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("sales").alias("sales_mean"))
    spine = stats.select("category", "total", "sales_median", F.explode(F.array(*[F.lit(x) for x in labels])).alias("band"))
    out = spine.join(bands, ["category", "band"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.col("total")
    gap = (share > 0) & (share < 0.10) & (F.col("sales_mean") >= F.col("sales_median"))
    return out.withColumn("share", share).withColumn("signal", F.when(gap, "opportunity").when(share > 0.30, "crowded").otherwise("none"))


def analyze_products(targets: DataFrame, df: DataFrame) -> DataFrame:
    """Position, competitiveness, target band and band signals of every target in one row."""
    bounds, labels = words.POSITION_BANDS
    targets = stage(targets)
    pos = market_position(targets, df).drop("category", "n")
    comp = competitiveness(targets, df).select("target_id", F.col("n").alias("similar"), "beat_rate", "stars", "rivals", "advantages", "risks")
    own = targets.select("target_id", "category", "price", tx.band("price", bounds, labels).alias("band"))
    signals = band_opportunities(df).select("category", "band", "share", "signal")
    return own.join(signals, ["category", "band"], "left").join(pos, "target_id", "left").join(comp, "target_id", "left")


# --- text search --------------------------------------------------------------
SEARCH_WEIGHTS = (("title", 10), ("brand", 5), ("level2", 3), ("category", 2))


def weighted_search(df: DataFrame, query: str, weights: Sequence[tuple[str, int]] = SEARCH_WEIGHTS, k: int = 50) -> DataFrame:
    """Case-blind literal search scored by the columns that match, best ``k``."""
    if not query.strip():
        return df.where(F.lit(False)).withColumn("score", F.lit(0))
    q = query.lower()
    score = sum((F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q)), w).otherwise(0) for c, w in weights), F.lit(0))
    return df.withColumn("score", score).where(F.col("score") > 0).orderBy(F.col("score").desc(), F.col("sku").asc()).limit(k)


def resolve_categories(queries: DataFrame, df: DataFrame, query: str = "query") -> DataFrame:
    """Category scope of every query text: exact, contained in a category name, or contained in title text.

    Exact and name matches run over the distinct categories.  Texts are matched once per distinct text and
    query through :func:`.extraction.contained_pairs`.
    """
    from shelfwise.operators.extraction import contained_pairs

    rows = df.where(F.col("unit_price").isNotNull())
    cats = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    q = queries.select(F.trim(F.col(query)).alias("q")).where(F.col("q") != "").distinct()
    exact = q.join(cats, q.q == cats.category).select("q", F.col("category").alias("label"), F.col("n").alias("rows"), F.lit(1).alias("level"))
    named = contained_pairs(cats, "category", "category", q, "q").join(cats, "category")
    by_name = named.groupBy("q").agg(F.max_by("category", F.struct("n", "category")).alias("label"), F.sum("n").alias("rows")).withColumn("level", F.lit(2))
    texts = rows.groupBy("level2", "title").agg(F.count(F.lit(1)).alias("n")).withColumn("both", F.concat_ws("\n", "level2", "title"))
    found = contained_pairs(texts, "both", "both", q, "q").join(texts.groupBy("both").agg(F.sum("n").alias("n")), "both")
    by_text = found.groupBy("q").agg(F.sum("n").alias("rows")).select("q", F.col("q").alias("label"), "rows", F.lit(3).alias("level"))
    best = keep_one(exact.unionByName(by_name.select("q", "label", "rows", "level")).unionByName(by_text), ["q"], [F.col("level").asc()])
    scope = F.when(F.col("level") == 1, "exact").when(F.col("level") == 2, "name").otherwise("text")
    return q.join(best, "q", "left").select("q", "label", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("level").isNotNull(), scope).otherwise("none").alias("scope"))
