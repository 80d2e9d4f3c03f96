"""Scores, comparisons, product analysis, search and price-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.functions import words
from shelfwise.operators import dedupe as dd
from shelfwise.operators import distribution as ds
from shelfwise.operators import history as hs
from shelfwise.operators import market as mk
from shelfwise.operators import scoring as sc
from shelfwise.plans.markets import rounded
from shelfwise.plans.registry import query
from shelfwise.plans.sqlviews import bands, rnd
from shelfwise.sources import views
from shelfwise.sources.staging import stage


def pct(c: str, part: str, order: str = "") -> str:
    """Average-tie percent rank in SQL."""
    return f"((rank() OVER (PARTITION BY {part} ORDER BY {c} {order}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY {part}))"


# --- ranks and normalisation --------------------------------------------------
@query(
    "price_percent_ranks",
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, amount, {rnd(pct('price', 'category'), 6)} AS price_pct, rank() OVER (PARTITION BY category ORDER BY price DESC) AS price_rank FROM offers""",
    ["offers"],
)
def price_percent_ranks(spark, sf):
    o = views.offers(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", "amount", "category", "price")
    out = ds.add_ranks(o, ["category"], "price", percent="price_pct", rank_desc="price_rank")
    return rounded(out, "price_pct", digits=6).drop("category", "price")


@query(
    "neutral_ranks",
    f"""SELECT sku, {rnd("coalesce(CASE WHEN package_type <> '' THEN (rank() OVER (PARTITION BY package_type <> '' ORDER BY unit_price) + (count(*) OVER (PARTITION BY package_type <> '', unit_price) - 1) / 2.0) / count(*) OVER (PARTITION BY package_type <> '') END, 0.5)", 6)} AS unit_rank FROM catalog""",
    ["catalog"],
)
def neutral_ranks(spark, sf):
    c = views.catalog(spark, sf).select("sku", F.when(F.col("package_type") != "", F.col("unit_price")).alias("u"))
    out = ds.add_ranks(c, [], "u", percent="p")
    return rounded(out.select("sku", F.coalesce("p", F.lit(0.5)).alias("unit_rank")), "unit_rank", digits=6)


@query(
    "min_max_scores",
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, amount, {rnd("CASE WHEN max(price) OVER w = min(price) OVER w THEN 1.0 ELSE (price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w) END", 6)} AS norm
        FROM offers WINDOW w AS (PARTITION BY sku)""",
    ["offers"],
)
def min_max_scores(spark, sf):
    o = views.offers(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", "amount", "sku", "price")
    return rounded(ds.min_max(o, ["sku"], {"norm": "price"}), "norm", digits=6).drop("sku", "price")


@query(
    "offer_price_quantiles",
    f"""SELECT category, {rnd('quantile_cont(price, 0.2)')} AS p20, {rnd('quantile_cont(price, 0.33)')} AS p33, {rnd('median(price)')} AS p50, {rnd('quantile_cont(price, 0.8)')} AS p80, {rnd('quantile_cont(price, 0.9)')} AS p90,
        {rnd('median(sales)')} AS sales_median FROM offers GROUP BY category""",
    ["offers"],
)
def offer_price_quantiles(spark, sf):
    q = ds.quantiles(views.offers(spark, sf), ["category"], {"p20": ("price", 0.2), "p33": ("price", 0.33), "p50": ("price", 0.5), "p80": ("price", 0.8), "p90": ("price", 0.9), "sales_median": ("sales", 0.5)})
    return rounded(q, "p20", "p33", "p50", "p80", "p90", "sales_median")


# --- scores -------------------------------------------------------------------
_SEL = """s AS (SELECT *, CASE WHEN max(1/unit_price) OVER w = min(1/unit_price) OVER w THEN 1.0 ELSE (1/unit_price - min(1/unit_price) OVER w) / (max(1/unit_price) OVER w - min(1/unit_price) OVER w) END AS pn,
   CASE WHEN max(sales) OVER w = min(sales) OVER w THEN 1.0 ELSE (sales - min(sales) OVER w) / (max(sales) OVER w - min(sales) OVER w) END AS sn
   FROM catalog WHERE unit_price > 0 AND sales > 0 WINDOW w AS (PARTITION BY category)), f AS (SELECT *, pn * 0.7 + sn * (1 - 0.7::DOUBLE) AS final_score FROM s)"""


@query(
    "selection_top3",
    f"""WITH {_SEL} SELECT category, sku, brand, price, {rnd('final_score')} AS final_score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {rnd('final_score', 6)} DESC, sku) AS r FROM f) WHERE r <= 3""",
    ["catalog"],
)
def selection_top3(spark, sf):
    out = sc.selection_score(views.catalog(spark, sf), top=3)
    return rounded(out, "final_score").select("category", "sku", "brand", "price", "final_score", "rank")


_VAL = f"""v AS (SELECT *, {rnd(f"least(greatest(100 - {pct('unit_price', 'category')} * 100 * 0.40 - discount_rate * 30 + least(comments / greatest(max(comments) OVER (PARTITION BY category), 1.0) * 100, 100.0) * 0.30, 0.0), 100.0)", 2)} AS value_score,
   {pct('unit_price', 'category')} * 100 AS up FROM catalog)"""


@query(
    "value_scores",
    f"""WITH {_VAL} SELECT sku, category, {rnd('up')} AS unit_price_percentile, value_score, rank() OVER (PARTITION BY category ORDER BY value_score DESC) AS category_rank FROM v""",
    ["catalog"],
)
def value_scores(spark, sf):
    out = sc.value_score(stage(views.catalog(spark, sf)))
    return rounded(out, "unit_price_percentile").select("sku", "category", "unit_price_percentile", "value_score", "category_rank")


_REF = f"""d AS (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY category, title, price, weight_g ORDER BY sku) = 1),
   r AS (SELECT *, (1 - {pct('unit_price', 'category')}) * 0.45 + {pct('sales', 'category')} * 0.35 + (CASE WHEN has_promotion THEN 0.4 ELSE 0 END + CASE WHEN is_gift THEN 0.4 ELSE 0 END + least(shops, 8) / 8 * 0.2) * 0.20 AS score FROM d)"""


@query(
    "reference_scores_top10",
    f"""WITH {_REF} SELECT category, sku, {rnd('score')} AS selection_score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {rnd('score', 6)} DESC, sku) AS k FROM r) WHERE k <= 10""",
    ["catalog"],
)
def reference_scores_top10(spark, sf):
    c = stage(views.catalog(spark, sf)).withColumn("brand_match_status", F.when(F.col("has_promotion"), "consistent")).withColumn("weight_match_status", F.when(F.col("is_gift"), "consistent"))
    out = sc.reference_score(c.withColumn("keyword_count", F.col("shops")))
    return rounded(out, "selection_score").select("category", "sku", "selection_score", "rank")


# --- comparison ---------------------------------------------------------------
@query(
    "cheapest_offers",
    """SELECT brand, category, sku, shop, price, weight_g, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY brand, category ORDER BY price / weight_g, sku) AS r FROM catalog WHERE price > 0 AND weight_g > 0) WHERE r <= 3""",
    ["catalog"],
)
def cheapest_offers(spark, sf):
    top, _ = sc.price_table(views.catalog(spark, sf))
    return top.select("brand", "category", "sku", "shop", "price", "weight_g", "rank")


@query(
    "price_table_status",
    """SELECT brand, category, count(*) AS matched, count(*) FILTER (w > 0) AS weighed, count(*) FILTER (w > 0 AND price > 300) AS usable,
       CASE WHEN count(*) FILTER (w > 0 AND price > 300) > 0 THEN 'ok' WHEN count(*) FILTER (w > 0) = 0 THEN 'no_standard_weight' ELSE 'no_valid_price' END AS status
       FROM (SELECT *, CASE WHEN weight_g >= 200 THEN weight_g END AS w FROM offers) GROUP BY 1, 2""",
    ["offers"],
)
def price_table_status(spark, sf):
    o = views.offers(spark, sf).withColumn("weight_g", F.when(F.col("weight_g") >= 200, F.col("weight_g"))).withColumn("price", F.col("price") - 300)
    return sc.price_table(o)[1]


@query(
    "store_price_extremes",
    f"""SELECT brand, category, count(*) AS n, arg_min(shop, row(price / weight_g, shop, sku)) AS cheapest_shop, {rnd('min(price / weight_g)', 6)} AS cheapest, arg_max(shop, row(price / weight_g, shop, sku)) AS dearest_shop,
        {rnd('max(price / weight_g)', 6)} AS dearest, {rnd('max(price / weight_g) - min(price / weight_g)', 6)} AS gap, {rnd('(max(price / weight_g) - min(price / weight_g)) / min(price / weight_g)')} AS gap_rate FROM offers GROUP BY 1, 2""",
    ["offers"],
)
def store_price_extremes(spark, sf):
    out = sc.store_extremes(views.offers(spark, sf))
    return rounded(rounded(out, "cheapest", "dearest", "gap", digits=6), "gap_rate")


@query(
    "store_price_details",
    f"""SELECT brand, category, shop, sku, {rnd('u', 6)} AS unit_price, CAST(r AS INT) AS rank FROM (SELECT *, price / weight_g AS u, row_number() OVER (PARTITION BY brand, category ORDER BY price / weight_g, sku, l_orderkey, l_linenumber, l_suppkey, amount) AS r FROM offers) WHERE r <= 10""",
    ["offers"],
)
def store_price_details(spark, sf):
    o = views.offers(spark, sf).withColumn("u", F.col("price") / F.col("weight_g"))
    order = [F.col(c).asc() for c in ("u", "sku", "l_orderkey", "l_linenumber", "l_suppkey", "amount")]
    top = dd.top_per_group(o, ["brand", "category"], order, 10, "rank")
    return rounded(top.withColumn("unit_price", F.col("u")), "unit_price", digits=6).select("brand", "category", "shop", "sku", "unit_price", "rank")


@query(
    "top_sellers",
    "SELECT sku, title, shop, price, sales, comments FROM catalog ORDER BY sales DESC, sku LIMIT 30",
    ["catalog"],
)
def top_sellers(spark, sf):
    return views.catalog(spark, sf).orderBy(F.col("sales").desc(), F.col("sku").asc()).limit(30).select("sku", "title", "shop", "price", "sales", "comments")


@query(
    "literal_keyword_filter",
    "SELECT sku, category, title, price FROM offers WHERE (contains(level2, 'ring') OR contains(category, 'ring') OR contains(title, 'ring')) AND price <= 300",
    ["offers"],
)
def literal_keyword_filter(spark, sf):
    return sc.keyword_filter(views.offers(spark, sf), "ring").where(F.col("price") <= 300).select("sku", "category", "title", "price")


@query(
    "regex_keyword_filter",
    "SELECT sku, category, title, price FROM offers WHERE regexp_matches(category, '(?i)promo b|r.ng$')",
    ["offers"],
)
def regex_keyword_filter(spark, sf):
    return sc.keyword_filter(views.offers(spark, sf), "promo b|r.ng$", ["category"], regex=True).select("sku", "category", "title", "price")


@query(
    "comparable_and_nonstandard",
    f"""SELECT 'comparable' AS kind, band, count(*) AS n FROM (SELECT *, {bands('price', *words.COARSE_BANDS)} AS band FROM offers WHERE weight_g >= 200) GROUP BY 2 UNION ALL
        SELECT 'non_standard', band, count(*) FROM (SELECT *, {bands('price', *words.COARSE_BANDS)} AS band FROM offers WHERE weight_g < 200) GROUP BY 2""",
    ["offers"],
)
def comparable_and_nonstandard(spark, sf):
    o = views.offers(spark, sf).withColumn("weight_g", F.when(F.col("weight_g") >= 200, F.col("weight_g"))).withColumn("band", tx.band("price", *words.COARSE_BANDS))
    side = lambda df, k: df.groupBy("band").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "band", "n")
    return side(mk.comparable(o), "comparable").unionByName(side(mk.non_standard(o), "non_standard"))


@query(
    "weighted_search",
    """SELECT sku, title, brand, score FROM (SELECT *, CASE WHEN contains(lower(title), 'ring') THEN 10 ELSE 0 END + CASE WHEN contains(lower(brand), 'ring') THEN 5 ELSE 0 END
       + CASE WHEN contains(lower(level2), 'ring') THEN 3 ELSE 0 END + CASE WHEN contains(lower(category), 'ring') THEN 2 ELSE 0 END AS score FROM catalog) WHERE score > 0 ORDER BY score DESC, sku LIMIT 50""",
    ["catalog"],
)
def weighted_search(spark, sf):
    return sc.weighted_search(views.catalog(spark, sf), "RING").select("sku", "title", "brand", "score")


@query(
    "brand_category_compare",
    f"""SELECT sku, shop, price, {rnd('unit_price', 6)} AS unit_price FROM catalog WHERE contains(brand, 'Brand#1') AND contains(category, 'gear') ORDER BY price, sku LIMIT 30""",
    ["catalog"],
)
def brand_category_compare(spark, sf):
    hit = sc.keyword_filter(sc.keyword_filter(views.catalog(spark, sf), "gear", ["category"]), "Brand#1", ["brand"])
    return rounded(hit.orderBy("price", "sku").limit(30).select("sku", "shop", "price", "unit_price"), "unit_price", digits=6)


_OPP_N = "(SELECT category, count(DISTINCT sku) AS n FROM catalog GROUP BY 1 ORDER BY n DESC, category LIMIT 5)"


@query(
    "decision_picks",
    f"""WITH {_VAL}, t AS {_OPP_N}, p AS (SELECT v.*, row_number() OVER (PARTITION BY category ORDER BY value_score DESC, comments DESC, sku) AS r FROM v SEMI JOIN t USING (category))
        SELECT sku, category, value_score FROM p WHERE r <= 3 ORDER BY value_score DESC, comments DESC, sku LIMIT 12""",
    ["catalog"],
)
def decision_picks(spark, sf):
    c = stage(views.catalog(spark, sf))
    heads = c.groupBy("category").agg(F.countDistinct("sku").alias("n")).orderBy(F.col("n").desc(), F.col("category").asc()).limit(5)
    scored = sc.value_score(c.join(F.broadcast(heads.select("category")), "category", "left_semi"), ranked=False)
    order = [F.col("value_score").desc(), F.col("comments").desc(), F.col("sku").asc()]
    return dd.top_per_group(scored, ["category"], order, 3).orderBy(*order).limit(12).select("sku", "category", "value_score")


# --- product analysis ---------------------------------------------------------
def targets(c):
    """One planned product per category and flavour, at the mean price and weight of what is sold."""
    return c.groupBy("category", "flavor").agg(
        (F.floor(F.sum(F.floor(F.col("price") * 100 + 0.5)) / F.count(F.lit(1))) / 100).alias("price"),
        F.floor(F.avg("weight_g")).cast("double").alias("weight_g"), F.min("brand").alias("brand"), F.max("package_type").alias("package_type"),
    ).withColumn("target_id", F.concat_ws("|", "category", "flavor"))


_TARGETS = """t AS (SELECT category || '|' || flavor AS target_id, category, flavor, floor(sum(floor(price * 100 + 0.5)) / count(*)) / 100 AS price, floor(avg(weight_g)) AS weight_g,
   min(brand) AS brand, max(package_type) AS package_type FROM catalog GROUP BY category, flavor)"""
_SIM = f"""{_TARGETS}, d AS (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY category, title, price, weight_g ORDER BY sku) = 1),
   p AS (SELECT t.target_id, t.brand AS t_brand, t.price / t.weight_g AS t_unit, d.*, abs(d.weight_g - t.weight_g) / t.weight_g AS wg,
     abs(d.weight_g - t.weight_g) / t.weight_g + abs(d.unit_price - t.price / t.weight_g) - CASE WHEN t.flavor <> '' AND contains(d.flavor, t.flavor) THEN 0.20 ELSE 0 END
     - CASE WHEN t.package_type <> '' AND contains(d.package_type, t.package_type) THEN 0.10 ELSE 0 END AS distance FROM t JOIN d ON t.category = d.category),
   c AS (SELECT *, count(*) FILTER (wg <= 1.0) OVER (PARTITION BY target_id) AS near_n, count(*) OVER (PARTITION BY target_id) AS all_n FROM p),
   k AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY {rnd('distance', 6)}, {rnd('unit_price', 6)}, sku) AS r FROM c WHERE wg <= 1.0 OR near_n < least(5, all_n))"""


@query("similar_products", f"WITH {_SIM} SELECT target_id, sku, {rnd('distance')} AS distance, CAST(r AS INT) AS rank FROM k WHERE r <= 20", ["catalog"])
def similar_products(spark, sf):
    c = stage(views.catalog(spark, sf))
    out = sc.similar_products(targets(c), c)
    return rounded(out, "distance").select("target_id", "sku", "distance", "rank")


_POS = f"""pos AS (SELECT target_id, t.category, t.price / t.weight_g AS tu, count(*) AS n, count(*) FILTER (c.unit_price <= t.price / t.weight_g) * 100.0 / count(*) AS p, quantile_cont(c.unit_price, 0.25) AS q25,
   median(c.unit_price) AS q50, quantile_cont(c.unit_price, 0.75) AS q75, avg(c.unit_price) AS m FROM t JOIN catalog c ON t.category = c.category GROUP BY ALL)"""


@query(
    "market_position",
    f"""WITH {_TARGETS}, {_POS} SELECT target_id, category, {rnd('tu', 6)} AS target_unit, n, CASE WHEN n >= 5 THEN {rnd('p')} END AS percentile,
        CASE WHEN n >= 5 THEN CASE WHEN p < 25 THEN '低价/性价比定位' WHEN p > 75 THEN '高端/高溢价定位' ELSE '主流价格带' END END AS position,
        {rnd('q25', 6)} AS q25, {rnd('q50', 6)} AS q50, {rnd('q75', 6)} AS q75, {rnd('tu / m')} AS mean_ratio,
        CASE WHEN n >= 80 THEN '高' WHEN n >= 30 THEN '中' WHEN n >= 10 THEN '低' ELSE '不足' END AS confidence FROM pos""",
    ["catalog"],
)
def market_position(spark, sf):
    c = stage(views.catalog(spark, sf))
    out = sc.market_position(targets(c), c)
    return rounded(rounded(out, "target_unit", "q25", "q50", "q75", digits=6), "percentile", "mean_ratio")


_COMP = f"""{_SIM}, k20 AS (SELECT * FROM k WHERE r <= 20), s AS (SELECT target_id, count(*) AS n, count(*) FILTER (unit_price > t_unit) / count(*) AS beat, avg(CAST(has_promotion AS DOUBLE)) AS pr,
     count(*) FILTER (contains(brand, t_brand)) AS sb, median(unit_price) FILTER (contains(brand, t_brand)) AS sm, any_value(t_unit) AS tu FROM k20 GROUP BY 1),
   rv AS (SELECT target_id, string_agg(brand, ';' ORDER BY r2) AS rivals FROM (SELECT target_id, brand, row_number() OVER (PARTITION BY target_id ORDER BY count(*) DESC, brand) AS r2 FROM k20 GROUP BY 1, 2) WHERE r2 <= 3 GROUP BY 1)"""


@query(
    "competitiveness",
    f"""WITH {_COMP} SELECT target_id, n, {rnd('beat')} AS beat_rate, {rnd('pr')} AS promotion_rate, sb AS same_brand_n, {rnd('sm', 6)} AS same_brand_median, rivals,
        CAST(greatest(1, least(5, CAST(round_even(beat * 4, 0) AS INT) + 1)) AS INT) AS stars, concat_ws(';', CASE WHEN beat >= 0.6 THEN 'cheaper_than_most' END, CASE WHEN sb >= 3 AND tu <= sm THEN 'below_brand_median' END) AS advantages,
        concat_ws(';', CASE WHEN beat < 0.6 THEN 'no_price_edge' END, CASE WHEN sb >= 3 AND tu > sm THEN 'above_brand_median' END, CASE WHEN pr >= 0.5 THEN 'promotion_pressure' END) AS risks,
        CASE WHEN n >= 80 THEN '高' WHEN n >= 30 THEN '中' WHEN n >= 10 THEN '低' ELSE '不足' END AS confidence, n >= 3 AS enough FROM s JOIN rv USING (target_id)""",
    ["catalog"],
)
def competitiveness(spark, sf):
    c = stage(views.catalog(spark, sf))
    out = sc.competitiveness(targets(c), c).drop("t_unit")
    return rounded(rounded(out, "same_brand_median", digits=6), "beat_rate", "promotion_rate")


_BANDOPP = f"""bd AS (SELECT *, {bands('price', *words.POSITION_BANDS)} AS band FROM catalog), st AS (SELECT category, count(*) AS total, median(sales) AS sm FROM bd GROUP BY 1 HAVING count(*) >= 10),
   bo AS (SELECT st.category, l.band, coalesce(n, 0) AS n, total, sm, av, coalesce(n, 0) / total AS share FROM st CROSS JOIN (SELECT unnest([{', '.join(f"'{x}'" for x in words.POSITION_BANDS[1])}]) AS band) l
     LEFT JOIN (SELECT category, band, count(*) AS n, avg(sales) AS av FROM bd GROUP BY 1, 2) b ON b.category = st.category AND b.band = l.band),
   bs AS (SELECT *, CASE WHEN share > 0 AND share < 0.10 AND av >= sm THEN 'opportunity' WHEN share > 0.30 THEN 'crowded' ELSE 'none' END AS signal FROM bo)"""


@query(
    "band_opportunities",
    f"""WITH {_BANDOPP} SELECT category, band, n, total, {rnd('sm')} AS sales_median, {rnd('av')} AS sales_mean, {rnd('share', 6)} AS share, signal FROM bs""",
    ["catalog"],
)
def band_opportunities(spark, sf):
    out = sc.band_opportunities(views.catalog(spark, sf))
    return rounded(rounded(out, "sales_median", "sales_mean"), "share", digits=6)


@query(
    "product_analysis",
    f"""WITH {_COMP}, {_POS}, {_BANDOPP} SELECT t.target_id, t.category, t.price, b.band, {rnd('b.share', 6)} AS share, b.signal, {rnd('pos.p')} AS percentile, s.n AS similar, {rnd('s.beat')} AS beat_rate, rv.rivals
        FROM t LEFT JOIN bs b ON b.category = t.category AND b.band = {bands('t.price', *words.POSITION_BANDS)} LEFT JOIN pos ON pos.target_id = t.target_id LEFT JOIN s ON s.target_id = t.target_id
        LEFT JOIN rv ON rv.target_id = t.target_id""",
    ["catalog"],
)
def product_analysis(spark, sf):
    c = stage(views.catalog(spark, sf))
    out = sc.analyze_products(targets(c), c)
    return rounded(rounded(out, "share", digits=6), "percentile", "beat_rate").select("target_id", "category", "price", "band", "share", "signal", "percentile", "similar", "beat_rate", "rivals")


@query(
    "category_scopes",
    """WITH q AS (SELECT DISTINCT x AS q FROM (SELECT category AS x FROM catalog UNION ALL SELECT flavor FROM catalog UNION ALL SELECT split_part(category, ' ', 2) FROM catalog UNION ALL SELECT 'zzz-' || level2 FROM catalog)),
       e AS (SELECT q, category AS label, count(*) AS rows, 1 AS level FROM q JOIN catalog ON category = q GROUP BY 1, 2),
       n AS (SELECT q, arg_max(category, row(c, category)) AS label, CAST(sum(c) AS BIGINT) AS rows, 2 AS level FROM q JOIN (SELECT category, count(*) AS c FROM catalog GROUP BY 1) ON contains(category, q) GROUP BY 1),
       x AS (SELECT q, q AS label, count(*) AS rows, 3 AS level FROM q JOIN catalog ON contains(level2 || chr(10) || title, q) GROUP BY 1),
       b AS (SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM n UNION ALL SELECT * FROM x) QUALIFY row_number() OVER (PARTITION BY q ORDER BY level) = 1)
       SELECT q.q, label, coalesce(rows, 0) AS rows, CASE level WHEN 1 THEN 'exact' WHEN 2 THEN 'name' WHEN 3 THEN 'text' ELSE 'none' END AS scope FROM q LEFT JOIN b USING (q)""",
    ["catalog"],
)
def category_scopes(spark, sf):
    c = views.catalog(spark, sf)
    asked = c.select(F.explode(F.array("category", "flavor", views.noun(F.col("category")), F.concat(F.lit("zzz-"), "level2"))).alias("query"))
    return sc.resolve_categories(asked, c)


@query(
    "category_structure",
    f"""WITH {_SEL}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {rnd('final_score', 6)} DESC, sku) AS k FROM f)
        SELECT c.category, n, {rnd('pm')} AS price_mean, brands, top FROM (SELECT category, count(*) AS n, avg(price) AS pm FROM catalog GROUP BY 1) c
        JOIN (SELECT category, string_agg(sku, ';' ORDER BY k) AS top FROM r WHERE k <= 10 GROUP BY 1) t USING (category)
        JOIN (SELECT category, string_agg(brand, ';' ORDER BY k) AS brands FROM (SELECT category, brand, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, brand) AS k FROM catalog GROUP BY 1, 2) WHERE k <= 10 GROUP BY 1) b USING (category)""",
    ["catalog"],
)
def category_structure(spark, sf):
    c = views.catalog(spark, sf)
    base = c.groupBy("category").agg(F.count("title").alias("n"), F.avg("price").alias("price_mean"))
    top = sc.selection_score(c, top=10)
    packed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "sku"))), lambda x: x["sku"])
    out = base.join(top.groupBy("category").agg(F.array_join(packed, ";").alias("top")), "category").join(mk.top_value_text(c, "brand", 10, ["category"], "brands"), "category")
    return rounded(out, "price_mean")


# --- price history ------------------------------------------------------------
@query(
    "price_history_summary",
    """SELECT sku, arg_max(price, row(ship_date, l_orderkey, l_linenumber, l_suppkey, price)) AS current_price, min(price) AS lowest_price, arg_min(ship_date, row(price, ship_date)) AS lowest_day, max(price) AS highest_price, count(*) AS points FROM offers GROUP BY 1""",
    ["offers"],
)
def price_history_summary(spark, sf):
    p = views.offers(spark, sf).withColumn("ts", F.col("ship_date"))
    return hs.history_summary(p, "sku", ["l_orderkey", "l_linenumber", "l_suppkey"]).withColumnRenamed("lowest_ts", "lowest_day")


_DAILY = "dl AS (SELECT sku, ship_date AS day, min(price) AS low, sum(price) AS price_sum, count(*) AS n FROM offers GROUP BY 1, 2)"


@query(
    "rolling_lows",
    f"""WITH {_DAILY} SELECT sku, day, low, min(low) OVER (PARTITION BY sku ORDER BY day RANGE BETWEEN INTERVAL 25 MONTH PRECEDING AND CURRENT ROW) AS rolling_low,
        {rnd('sum(price_sum) OVER m / sum(n) OVER m')} AS rolling_mean FROM dl WINDOW m AS (PARTITION BY sku ORDER BY day RANGE BETWEEN INTERVAL 60 DAY PRECEDING AND CURRENT ROW)""",
    ["offers"],
)
def rolling_lows(spark, sf):
    d = hs.daily_prices(views.offers(spark, sf).withColumnRenamed("ship_date", "day"), "sku")
    return rounded(hs.windowed_lows(d, "sku"), "rolling_mean").select("sku", "day", "low", "rolling_low", "rolling_mean")


@query(
    "as_of_prices",
    f"""WITH {_DAILY}, q AS (SELECT o_orderkey, CAST(o_orderkey % (SELECT count(*) FROM part) AS VARCHAR) AS sku, CAST(o_orderdate AS DATE) AS day FROM orders)
        SELECT o_orderkey, q.sku, q.day, low AS as_of_price FROM q ASOF LEFT JOIN dl ON q.sku = dl.sku AND q.day >= dl.day""",
    ["offers"],
)
def as_of_prices(spark, sf):
    d = hs.daily_prices(views.offers(spark, sf).withColumnRenamed("ship_date", "day"), "sku")
    parts = views.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    q = views.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % parts).cast("string").alias("sku"), F.to_date("o_orderdate").alias("day"))
    return hs.as_of_price(q, d, "sku").select("o_orderkey", "sku", "day", "as_of_price")


@query(
    "trend_points",
    """SELECT l_orderkey, l_linenumber, l_suppkey, amount, sku, ship_date AS day, unnest(CASE WHEN price = original_price THEN [price] ELSE [price, original_price] END) AS price, promotion AS promo FROM offers""",
    ["offers"],
)
def trend_points(spark, sf):
    points = hs.trend_points(_trend_strings(views.offers(spark, sf)).withColumn("k", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "amount", "sku")), "k", "trend")
    return points.select("k.*", F.to_date("ts").alias("day"), "price", "promo")


def _trend_strings(o):
    """A trend string per offer as feeds deliver them: array form for even years, object form for odd ones, one void point.

    What its points share, and each price, is written once; behind a column of its own Spark does not repeat it.
    """
    ms = (F.unix_seconds(F.col("ship_date").cast("timestamp")) * 1000).cast("string")
    even = F.year("ship_date") % 2 == 0
    o = o.withColumns({
        "_head": F.when(even, F.concat(F.lit("["), ms, F.lit(","))).otherwise(F.concat(F.lit('{"timestamp":'), ms, F.lit(',"price":'))),
        "_tail": F.when(even, F.concat(F.lit(',"'), "promotion", F.lit('"]'))).otherwise(F.concat(F.lit(',"promo":"'), "promotion", F.lit('"}'))),
        "_now": F.col("price").cast("string"), "_was": F.col("original_price").cast("string"),
    })
    points = [F.concat("_head", p, "_tail") for p in (F.col("_now"), F.lit("0"), F.col("_was"), F.col("_now"))]
    return o.withColumn("trend", F.concat(F.lit("["), F.concat_ws(",", *points), F.lit("]"))).drop("_head", "_tail", "_now", "_was")


@query(
    "trend_point_counts",
    "SELECT sku, CAST(count(*) * 4 AS BIGINT) AS points FROM offers GROUP BY 1",
    ["offers"],
)
def trend_point_counts(spark, sf):
    return _trend_strings(views.offers(spark, sf)).select("sku", hs.point_count("trend").alias("n")).groupBy("sku").agg(F.sum("n").alias("points"))


@query(
    "history_query_status",
    """SELECT c.sku, o.cur AS current_price, o.lo AS lowest_price, o.hi AS highest_price, coalesce(o.n, 0) AS points, CASE WHEN o.sku IS NOT NULL THEN 'success' WHEN c.is_gift THEN 'no_result' ELSE 'error' END AS status
       FROM catalog c LEFT JOIN (SELECT sku, arg_max(price, row(ship_date, price)) AS cur, min(price) AS lo, max(price) AS hi, count(*) AS n FROM offers GROUP BY 1) o USING (sku)""",
    ["catalog", "offers"],
)
def history_query_status(spark, sf):
    p = views.offers(spark, sf).withColumn("ts", F.col("ship_date"))
    out = hs.query_status(views.catalog(spark, sf).select("sku", "is_gift"), hs.history_summary(p, "sku"), None, "sku", "is_gift")
    return out.drop("lowest_ts")
