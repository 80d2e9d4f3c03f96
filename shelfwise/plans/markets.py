"""Category, brand, band and promotion queries over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.functions import words
from shelfwise.operators import market as mk
from shelfwise.plans.registry import query
from shelfwise.plans.sqlviews import PROMO_KIND, STORE_TYPE, bands, cents, rnd
from shelfwise.sources import views
from shelfwise.sources.staging import stage


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Last step of a query: round doubles for display."""
    return df.withColumns({c: tx.stable_round(c, digits) for c in columns})


def banded(spark: SparkSession, sf: str) -> DataFrame:
    return mk.tercile_bands(stage(views.catalog(spark, sf)))


def report_banded(spark: SparkSession, sf: str) -> DataFrame:
    bounds, labels = words.REPORT_BANDS
    return views.offers(spark, sf).withColumn("price_band", tx.band("price", bounds, labels))


_REPORT_BAND = bands("price", *words.REPORT_BANDS)


@query(
    "category_baseline",
    f"""SELECT category, count(sku) AS items, count(DISTINCT brand) AS brands, count(DISTINCT shop) AS shops,
        {rnd('avg(price)')} AS price_mean, min(price) AS price_min, max(price) AS price_max, {rnd('avg(comments)')} AS comments_mean,
        sum(comments) AS comments_sum, count(price) AS with_price, count(comments) AS with_comments,
        {rnd('median(price)')} AS price_median, {rnd('median(comments)')} AS comments_median,
        {rnd('any_value(h3) * 100.0 / count(*)')} AS cr3, {rnd('any_value(h5) * 100.0 / count(*)')} AS cr5,
        {rnd('count(DISTINCT shop) / count(*)')} AS shop_density
        FROM catalog JOIN (
          SELECT category, CAST(sum(CASE WHEN r <= 3 THEN n END) AS DOUBLE) AS h3, CAST(sum(CASE WHEN r <= 5 THEN n END) AS DOUBLE) AS h5
          FROM (SELECT category, brand, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, brand) AS r
                FROM catalog GROUP BY 1, 2) GROUP BY 1) USING (category)
        GROUP BY category""",
    ["catalog"],
)
def category_baseline(spark, sf):
    out = mk.category_baseline(views.catalog(spark, sf))
    return rounded(out, "price_mean", "comments_mean", "price_median", "comments_median", "cr3", "cr5", "shop_density")


@query(
    "category_summary",
    f"""SELECT category, count(DISTINCT sku) AS items, count(DISTINCT brand) AS brands, {rnd('avg(price)')} AS price_mean,
        sum(sales) AS sales_sum, sum(comments) AS comments_sum, sum(negatives) AS negatives_sum,
        {rnd('avg(CASE WHEN history_low IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS history_coverage,
        {rnd('median(price)')} AS price_median, {rnd('median(unit_price)')} AS unit_price_median
        FROM catalog LEFT JOIN (SELECT sku, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS negatives, min(price) FILTER (discount > 0.08) AS history_low
                                FROM offers GROUP BY sku) USING (sku) GROUP BY category""",
    ["catalog", "offers"],
)
def category_summary(spark, sf):
    o = views.offers(spark, sf).groupBy("sku").agg(
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("negatives"), F.min(F.when(F.col("discount") > 0.08, F.col("price"))).alias("history_low")
    )
    out = mk.category_summary(views.catalog(spark, sf).join(o, "sku", "left"))
    return rounded(out, "price_mean", "history_coverage", "price_median", "unit_price_median")


@query(
    "brand_concentration",
    f"""SELECT category, {rnd('sum(CASE WHEN r <= 3 THEN n ELSE 0 END) / sum(n)', 6)} AS cr3, {rnd('sum(CASE WHEN r <= 5 THEN n ELSE 0 END) / sum(n)', 6)} AS cr5
        FROM (SELECT category, brand, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, brand) AS r
              FROM offers GROUP BY 1, 2) GROUP BY category""",
    ["offers"],
)
def brand_concentration(spark, sf):
    return rounded(mk.concentration(views.offers(spark, sf), ["category"], "brand"), "cr3", "cr5", digits=6)


@query(
    "brand_strategy_top10",
    f"""SELECT brand, count(title) AS n, {rnd('avg(price)')} AS price_mean, {rnd('avg(unit_price)', 6)} AS unit_price_mean, {rnd('median(price)')} AS price_median
        FROM catalog WHERE price > 0 AND weight_g > 0 GROUP BY brand ORDER BY n DESC, brand LIMIT 10""",
    ["catalog"],
)
def brand_strategy(spark, sf):
    out = rounded(mk.brand_strategy(views.catalog(spark, sf)), "price_mean", "price_median")
    return rounded(out, "unit_price_mean", digits=6)


@query(
    "promotion_summary",
    f"""SELECT keyword, count(*) AS n, {rnd('avg(sales)')} AS sales_mean FROM (
          SELECT DISTINCT sku, l_orderkey, l_linenumber, l_suppkey, amount, sales, CASE WHEN contains(k, '满减') OR regexp_matches(k, '满\\d+减\\d+') THEN '满减'
                 WHEN contains(k, '券') THEN '优惠券' WHEN contains(k, '包邮') THEN '包邮' WHEN contains(k, '秒杀') THEN '秒杀' ELSE k END AS keyword
          FROM (SELECT *, unnest(regexp_split_to_array(promotion, '[, ]+')) AS k FROM offers) WHERE k <> '') GROUP BY keyword""",
    ["offers"],
)
def promotion_summary(spark, sf):
    return rounded(mk.promotion_summary(views.offers(spark, sf)), "sales_mean")


@query(
    "promotion_top_keywords",
    """SELECT keyword, count(*) AS n FROM (
          SELECT CASE WHEN contains(k, '券') THEN '优惠券' WHEN contains(k, '包邮') THEN '包邮' WHEN contains(k, '秒杀') THEN '秒杀'
                 WHEN regexp_matches(k, '满\\d+减\\d+') THEN '满减' ELSE k END AS keyword
          FROM (SELECT unnest(regexp_split_to_array(promotion, '[, ]+')) AS k FROM catalog) WHERE k <> '') GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10""",
    ["catalog"],
)
def promotion_top_keywords(spark, sf):
    tags = views.catalog(spark, sf).select(F.explode(tx.promotion_keywords("promotion")).alias("keyword"))
    return mk.top_values(tags, "keyword", 10)


@query(
    "promotion_compare",
    f"SELECT promotion <> '' AS promoted, count(*) AS n, {rnd('avg(sales)')} AS sales_mean FROM offers GROUP BY 1",
    ["offers"],
)
def promotion_compare(spark, sf):
    return rounded(mk.promotion_compare(views.offers(spark, sf)), "sales_mean")


@query(
    "promotion_effect",
    f"""SELECT category, promo_type, count(*) AS n, {rnd('avg(sales)')} AS sales_mean, {rnd('avg(comments)')} AS comments_mean,
          {rnd('avg(discount_rate)', 6)} AS discount_mean, {rnd('median(sales)')} AS sales_median,
          {rnd('avg(sales) / any_value(base) - 1')} AS lift, {rnd('avg(sales) / any_value(base)')} AS lift_multiple, {rnd('count(*) / any_value(total)', 6)} AS share
        FROM (SELECT *, {PROMO_KIND} AS promo_type,
                greatest((original_price - price) / original_price, 0.0) AS discount_rate FROM offers)
        JOIN (SELECT category, coalesce(avg(CASE WHEN promotion = '' THEN sales END), avg(sales)) AS base, count(*) AS total FROM offers GROUP BY category) USING (category)
        GROUP BY category, promo_type""",
    ["offers"],
)
def promotion_effect(spark, sf):
    o = views.offers(spark, sf).withColumn("discount_rate", tx.discount_rate("price", "original_price"))
    out = mk.promotion_effect(o, ["category"])
    return rounded(rounded(out, "sales_mean", "comments_mean", "sales_median", "lift", "lift_multiple"), "discount_mean", "share", digits=6)


@query(
    "positive_sales_stats",
    f"""SELECT promotion <> '' AS promoted, count(*) AS n, count(CASE WHEN sales > 25 THEN 1 END) AS selling,
        {rnd('avg(CASE WHEN sales > 25 THEN sales - 25 END)')} AS sales_mean FROM offers GROUP BY 1""",
    ["offers"],
)
def positive_sales_stats(spark, sf):
    shifted = views.offers(spark, sf).withColumn("sales", F.col("sales") - 25)
    return rounded(mk.positive_sales_stats(shifted), "sales_mean")


@query(
    "promotion_keyword_hits",
    """SELECT term, CAST(sum((length(promotion) - length(replace(promotion, term, ''))) // length(term)) AS BIGINT) AS hits
       FROM offers, (SELECT unnest(['满', '券', '包邮', '特价', '秒杀', '买赠']) AS term) GROUP BY term""",
    ["offers"],
)
def promotion_keyword_hits(spark, sf):
    return mk.keyword_hits(views.offers(spark, sf), "promotion", ["满", "券", "包邮", "特价", "秒杀", "买赠"]).withColumn("hits", F.col("hits").cast("bigint"))


@query(
    "level2_price_spread",
    f"""SELECT level2, count(*) AS n, {rnd('avg(price)')} AS price_mean, {rnd('coalesce(stddev_samp(price), 0)')} AS price_std,
        min(price) AS price_min, max(price) AS price_max, {rnd('max(price) - min(price)')} AS price_range FROM offers WHERE price > 0 AND weight_g > 0 GROUP BY level2""",
    ["offers"],
)
def level2_price_spread(spark, sf):
    return rounded(mk.price_spread(views.offers(spark, sf)), "price_mean", "price_std", "price_range")


def _top_text(column: str, k: int, key: str = "category", source: str = "catalog") -> str:
    return f"""(SELECT {key}, string_agg({column}, ';' ORDER BY r) AS v FROM (
        SELECT {key}, {column}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {column}) AS r FROM {source} WHERE {column} <> '' GROUP BY 1, 2)
        WHERE r <= {k} GROUP BY {key})"""


@query(
    "category_profile",
    f"""SELECT s.*, sp.v AS specs, b.v AS brands, f.v AS flavors, p.v AS packages FROM (
          SELECT category, count(*) AS n, {rnd('avg(unit_price)', 6)} AS mean, {rnd('min(unit_price)', 6)} AS min, {rnd('max(unit_price)', 6)} AS max,
            {rnd('avg(CAST(has_promotion AS DOUBLE))')} AS promotion_rate, {rnd('avg(CAST(is_gift AS DOUBLE))')} AS gift_rate,
            {rnd('quantile_cont(unit_price, 0.25)', 6)} AS p25, {rnd('median(unit_price)', 6)} AS median, {rnd('quantile_cont(unit_price, 0.75)', 6)} AS p75
          FROM catalog GROUP BY category HAVING count(*) >= 5) s
        LEFT JOIN {_top_text('spec', 5, source="(SELECT category, CAST(CAST(weight_g AS BIGINT) AS VARCHAR) AS spec FROM catalog)")} sp USING (category)
        LEFT JOIN {_top_text('brand', 5)} b USING (category) LEFT JOIN {_top_text('flavor', 5)} f USING (category)
        LEFT JOIN {_top_text('package_type', 5)} p USING (category)""",
    ["catalog"],
)
def category_profile(spark, sf):
    out = mk.category_profile(views.catalog(spark, sf))
    return rounded(rounded(out, "mean", "min", "max", "p25", "median", "p75", digits=6), "promotion_rate", "gift_rate")


@query(
    "corpus_frequencies",
    """SELECT dimension, value, n, rank FROM (
         SELECT dimension, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, value) AS INT) AS rank
         FROM (SELECT 'brand' AS dimension, brand AS value FROM catalog UNION ALL SELECT 'flavor', flavor FROM catalog
               UNION ALL SELECT 'package_type', package_type FROM catalog UNION ALL SELECT 'title', title FROM catalog) WHERE value <> '' GROUP BY 1, 2)
       WHERE rank <= CASE WHEN dimension = 'title' THEN 12 ELSE 5 END""",
    ["catalog"],
)
def corpus_frequencies(spark, sf):
    return mk.corpus_frequencies(views.catalog(spark, sf), {"brand": 5, "flavor": 5, "package_type": 5, "title": 12})


_PCT = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"
_OPP_BASE = """base AS (SELECT category, count(DISTINCT sku) AS items, count(DISTINCT brand) AS brands, count(DISTINCT shop) AS shops, avg(price) AS price_mean,
      sum(sales) AS sales_sum, sum(comments) AS comments_sum, avg(comments) AS comments_mean, avg(CAST(has_promotion AS DOUBLE)) AS promotion_share,
      median(price) AS price_median, median(unit_price) AS unit_price_median FROM catalog GROUP BY category HAVING count(DISTINCT sku) >= {m})"""


@query(
    "opportunity_base",
    f"""WITH {_OPP_BASE.format(m=30)} SELECT category, items, brands, shops, {rnd('price_mean')} AS price_mean, sales_sum, comments_sum, {rnd('comments_mean')} AS comments_mean,
        {rnd('promotion_share')} AS promotion_share, {rnd('price_median')} AS price_median, {rnd('unit_price_median', 6)} AS unit_price_median FROM base""",
    ["catalog"],
)
def opportunity_base(spark, sf):
    out = mk.opportunity_base(views.catalog(spark, sf))
    return rounded(rounded(out, "price_mean", "comments_mean", "promotion_share", "price_median"), "unit_price_median", digits=6)


def _opportunity_sql(profile: str, min_items: int) -> str:
    w = words.OPPORTUNITY_WEIGHTS[profile]
    score = " + ".join(f"{n} * {v}" for n, v in w.items())
    p = lambda c: _PCT.format(c=c)
    return f"""WITH {_OPP_BASE.format(m=min_items)},
      s AS (SELECT category, items, 1 - {p('items')} AS scarcity,
        {p('sales_sum')} * 0.55 + {p('comments_sum')} * 0.35 + {p('comments_mean')} * 0.10 AS demand, 1 - {p('unit_price_median')} AS price_health,
        1 - {p('CAST(items AS DOUBLE) / brands')} AS competition_ease, {p('promotion_share')} AS promo_elasticity FROM base),
      t AS (SELECT *, ({score}) * 100 AS sc, CASE WHEN demand >= 0.70 AND scarcity >= 0.45 THEN '优先测试' WHEN demand >= 0.70 THEN '高热高竞争'
        WHEN scarcity >= 0.70 THEN '蓝海观察' ELSE '常规跟踪' END AS verdict FROM s)
      SELECT category, items, {rnd('scarcity', 6)} AS scarcity, {rnd('demand', 6)} AS demand, {rnd('price_health', 6)} AS price_health,
        {rnd('competition_ease', 6)} AS competition_ease, {rnd('promo_elasticity', 6)} AS promo_elasticity, {rnd('sc')} AS score, verdict FROM t"""


def _opportunity(profile: str):
    def run(spark, sf):
        out = mk.opportunity_scores(views.catalog(spark, sf), 20, profile)
        cols = ["scarcity", "demand", "price_health", "competition_ease", "promo_elasticity"]
        return rounded(rounded(out, *cols, digits=6), "score").select("category", "items", *cols, "score", "verdict")

    return run


for _p in words.OPPORTUNITY_WEIGHTS:
    query(f"opportunity_scores_{_p}", _opportunity_sql(_p, 20), ["catalog"])(_opportunity(_p))


@query(
    "band_cross_table",
    f"""SELECT category, price_band, count(*) AS n, sum(sales) AS sales_sum, {rnd('avg(sales)')} AS sales_mean, {rnd('avg(price)')} AS price_mean
        FROM (SELECT *, {_REPORT_BAND} AS price_band FROM offers) GROUP BY 1, 2""",
    ["offers"],
)
def band_cross_table(spark, sf):
    return rounded(mk.band_cross(report_banded(spark, sf)), "sales_mean", "price_mean")


@query(
    "store_type_summary",
    f"""SELECT store_type, count(*) AS n, {rnd('avg(price)')} AS price_mean, {rnd('avg(sales)')} AS sales_mean, sum(sales) AS sales_sum,
        {rnd('sum(price * sales) / sum(sales)')} AS weighted_price, {rnd('avg(comments)')} AS comments_mean,
        {rnd("avg(CASE WHEN regexp_matches(promotion, '券|满减|百亿补贴') THEN 1.0 ELSE 0.0 END)")} AS coupon_share,
        {rnd('median(price)')} AS price_median, {rnd('median(sales)')} AS sales_median,
        {rnd('count(*) / (SELECT count(*) FROM offers)')} AS share, {rnd('sum(sales) / (SELECT sum(sales) FROM offers)')} AS sales_share
        FROM (SELECT *, {STORE_TYPE} AS store_type FROM offers) GROUP BY store_type""",
    ["offers"],
)
def store_type_summary(spark, sf):
    out = mk.store_summary(views.offers(spark, sf))
    return rounded(out, *[c for c in out.columns if c not in ("store_type", "n", "sales_sum")])


def _share_sql(by: str, source: str) -> str:
    return f"""SELECT {by}, count(*) AS n, sum(sales) AS sales_sum, {rnd('avg(sales)')} AS sales_mean, {rnd('avg(price)')} AS price_mean,
        {rnd('count(*) / sum(count(*)) OVER ()', 6)} AS share FROM {source} GROUP BY {by}"""


@query("category_distribution", _share_sql("category", "offers"), ["offers"])
def category_distribution(spark, sf):
    return rounded(rounded(mk.share_of_total(views.offers(spark, sf), "category"), "sales_mean", "price_mean"), "share", digits=6)


@query("brand_distribution", _share_sql("brand", "offers"), ["offers"])
def brand_distribution(spark, sf):
    return rounded(rounded(mk.share_of_total(views.offers(spark, sf), "brand"), "sales_mean", "price_mean"), "share", digits=6)


_LABELS = ", ".join(f"'{x}'" for x in words.REPORT_BANDS[1])


@query(
    "price_band_distribution",
    f"""WITH b AS (SELECT price_band, count(*) AS n, sum(sales) AS sales_sum, avg(sales) AS sales_mean, avg(price) AS price_mean
               FROM (SELECT *, {_REPORT_BAND} AS price_band FROM offers) GROUP BY 1)
        SELECT l.price_band, coalesce(n, 0) AS n, sales_sum, {rnd('sales_mean')} AS sales_mean, {rnd('price_mean')} AS price_mean,
          {rnd('coalesce(n, 0) / (SELECT count(*) FROM offers)', 6)} AS share
        FROM (SELECT unnest([{_LABELS}]) AS price_band) l LEFT JOIN b ON l.price_band = b.price_band""",
    ["offers"],
)
def price_band_distribution(spark, sf):
    out = mk.share_of_total(report_banded(spark, sf), "price_band", words.REPORT_BANDS[1])
    return rounded(rounded(out, "sales_mean", "price_mean"), "share", digits=6)


@query(
    "hot_product_profile",
    f"""WITH c AS (SELECT *, {bands('price', *words.REPORT_BANDS)} AS price_band FROM catalog), h AS (SELECT * FROM c WHERE sales >= (SELECT quantile_cont(sales, 0.9) FROM c)),
        tc AS (SELECT category, count(*) AS n FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), tb AS (SELECT price_band, count(*) AS n FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
        SELECT {rnd('(SELECT quantile_cont(sales, 0.9) FROM c)')} AS threshold, count(*) AS n, {rnd('avg(price)')} AS price_mean,
          {rnd(f"avg(CASE WHEN {STORE_TYPE} = '京东自营' THEN 1.0 ELSE 0.0 END)")} AS self_share,
          {rnd("avg(CASE WHEN regexp_matches(promotion, '券|满减|百亿补贴') THEN 1.0 ELSE 0.0 END)")} AS coupon_share, {rnd('median(price)')} AS price_median,
          (SELECT category FROM tc) AS top_category, (SELECT n FROM tc) AS top_category_n, (SELECT price_band FROM tb) AS top_band, (SELECT n FROM tb) AS top_band_n FROM h""",
    ["catalog"],
)
def hot_product_profile(spark, sf):
    bounds, labels = words.REPORT_BANDS
    out = mk.hot_profile(stage(views.catalog(spark, sf)).withColumn("price_band", tx.band("price", bounds, labels)))
    return rounded(out, "threshold", "price_mean", "self_share", "coupon_share", "price_median")


@query(
    "market_kpis",
    f"""SELECT count(*) AS items, sum(sales) AS sales_sum, {rnd('avg(price)')} AS price_mean, {rnd('avg(sales)')} AS sales_mean, count(*) FILTER (price >= 100) AS high_price_items,
        {rnd('count(*) FILTER (price >= 100) / count(*)')} AS high_price_share, {rnd('median(price)')} AS price_median, {rnd('median(sales)')} AS sales_median,
        {rnd('(SELECT sum(n) FROM (SELECT count(*) AS n FROM offers GROUP BY brand ORDER BY n DESC, brand LIMIT 10)) / count(*)')} AS top_brand_share FROM offers""",
    ["offers"],
)
def market_kpis(spark, sf):
    out = mk.market_kpis(views.offers(spark, sf))
    return rounded(out, "price_mean", "sales_mean", "high_price_share", "price_median", "sales_median", "top_brand_share")


@query(
    "ocean_lists",
    f"""WITH s AS (SELECT category, count(*) AS n, avg(sales) AS m FROM catalog GROUP BY 1), red AS (SELECT * FROM s ORDER BY n DESC, category LIMIT 10),
        blue AS (SELECT * FROM s WHERE n <= (SELECT greatest(40, ceil(count(*) * 0.005)) FROM catalog) ORDER BY n, m DESC, category LIMIT 10)
        SELECT category, n, {rnd('m')} AS sales_mean, 'red' AS list FROM red UNION ALL SELECT category, n, {rnd('m')}, 'blue' FROM blue""",
    ["catalog"],
)
def ocean_lists(spark, sf):
    return rounded(mk.ocean_lists(views.catalog(spark, sf), floor=40), "sales_mean")


@query(
    "category_detail",
    f"""SELECT s.*, b.v AS brands FROM (SELECT category, count(*) AS n, min(price) FILTER (price > 0 AND price < 500) AS price_min, max(price) FILTER (price > 0 AND price < 500) AS price_max,
        floor(avg(price) FILTER (price > 0 AND price < 500) + 0.5) AS price_avg FROM catalog GROUP BY category) s LEFT JOIN {_top_text('brand', 10)} b USING (category)""",
    ["catalog"],
)
def category_detail(spark, sf):
    return mk.category_detail(views.catalog(spark, sf), high=500.0).withColumn("price_avg", F.col("price_avg").cast("double"))


@query(
    "brand_detail",
    f"""SELECT s.*, b.v AS categories FROM (SELECT brand, count(*) AS n, floor(avg(price) + 0.5) AS price_avg FROM catalog GROUP BY brand) s
        LEFT JOIN {_top_text('level2', 10, 'brand')} b USING (brand)""",
    ["catalog"],
)
def brand_detail(spark, sf):
    return mk.brand_detail(views.catalog(spark, sf)).withColumn("price_avg", F.col("price_avg").cast("double"))


@query(
    "top_counts",
    """SELECT dimension, value, n, CAST(rank AS INT) AS rank FROM (
         SELECT dimension, value, count(*) AS n, row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, value) AS rank
         FROM (SELECT 'category' AS dimension, category AS value FROM offers UNION ALL SELECT 'brand', brand FROM offers) GROUP BY 1, 2) WHERE rank <= 15""",
    ["offers"],
)
def top_counts(spark, sf):
    return mk.corpus_frequencies(views.offers(spark, sf), {"category": 15, "brand": 15})


_BANDED_CR = """(SELECT category, CAST(sum(CASE WHEN r <= 3 THEN n END) AS DOUBLE) / sum(n) AS cr3, CAST(sum(CASE WHEN r <= 5 THEN n END) AS DOUBLE) / sum(n) AS cr5
   FROM (SELECT category, brand, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, brand) AS r FROM banded GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "competition_index",
    f"""SELECT category, items, shops, bands, {rnd('cr3', 6)} AS cr3, {rnd('cr5', 6)} AS cr5, {rnd('shops / items', 6)} AS density,
        {rnd('(1 - cr3) * 40 + least(items / 300, 1.0) * 25 + least(shops / 100, 1.0) * 25 + least(bands / 3, 1.0) * 10')} AS competition_index
        FROM (SELECT category, count(*) AS items, count(DISTINCT shop) AS shops, count(DISTINCT price_band) AS bands FROM banded GROUP BY 1) JOIN {_BANDED_CR} USING (category)""",
    ["banded"],
)
def competition_index(spark, sf):
    out = mk.competition_index(banded(spark, sf))
    return rounded(rounded(out, "cr3", "cr5", "density", digits=6), "competition_index")


@query("tercile_price_bands", "SELECT sku, category, price, price_band FROM banded", ["banded"])
def tercile_price_bands(spark, sf):
    return banded(spark, sf).select("sku", "category", "price", "price_band")


@query(
    "brand_tiers",
    f"""SELECT category, brand, n, CAST(r AS INT) AS rank, {rnd('n / total', 6)} AS share, {rnd('sum(n) OVER (PARTITION BY category ORDER BY r) / total', 6)} AS running_share,
        CASE WHEN r <= 3 THEN 'head' WHEN r <= 10 THEN 'mid' ELSE 'tail' END AS tier
        FROM (SELECT category, brand, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, brand) AS r, sum(count(*)) OVER (PARTITION BY category) AS total
              FROM catalog GROUP BY 1, 2) WHERE r <= 20""",
    ["catalog"],
)
def brand_tiers(spark, sf):
    return rounded(mk.brand_tiers(views.catalog(spark, sf)), "share", "running_share", digits=6)


_PIV = ", ".join(f"coalesce(sum(CASE WHEN price_band = '{x}' THEN sales END), 0) AS \"{x}\"" for x in words.REPORT_BANDS[1])


@query(
    "band_sales_pivot",
    f"""WITH b AS (SELECT *, {_REPORT_BAND} AS price_band FROM offers), t AS (SELECT category, sum(sales) AS s FROM b GROUP BY 1 ORDER BY s DESC, category LIMIT 12)
        SELECT category, {_PIV} FROM b WHERE category IN (SELECT category FROM t) GROUP BY category""",
    ["offers"],
)
def band_sales_pivot(spark, sf):
    return mk.band_pivot(report_banded(spark, sf), words.REPORT_BANDS[1])


_XT = ", ".join(f"count(CASE WHEN price_band = '{x}' THEN 1 END) AS \"{x}\"" for x in [*words.TERCILE_LABELS, words.UNKNOWN_BAND])


@query(
    "brand_band_crosstab",
    f"""SELECT category, brand, {_XT}, CAST(rank AS INT) AS rank FROM banded JOIN (SELECT category, brand, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, brand) AS rank
        FROM banded GROUP BY 1, 2) USING (category, brand) WHERE rank <= 8 GROUP BY category, brand, rank""",
    ["banded"],
)
def brand_band_crosstab(spark, sf):
    return mk.brand_band_crosstab(banded(spark, sf), [*words.TERCILE_LABELS, words.UNKNOWN_BAND])


@query(
    "melted_band_report",
    f"""WITH b AS (SELECT category, {_REPORT_BAND} AS price_band, count(*) AS n, sum(sales) AS demand FROM offers GROUP BY 1, 2)
        SELECT category, price_band, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM b UNION ALL SELECT category, price_band, 'demand', demand FROM b""",
    ["offers"],
)
def melted_band_report(spark, sf):
    cells = report_banded(spark, sf).groupBy("category", "price_band").agg(F.count("sku").cast("double").alias("n"), F.sum("sales").alias("demand"))
    return mk.melt(cells, ["category", "price_band"], ["n", "demand"])


@query(
    "price_gap_report",
    f"""WITH f AS (SELECT category, CAST(floor(price / 20.0) AS BIGINT) AS bin, count(*) AS items, avg(comments) AS cm, avg(sales) AS sm, sum(comments) AS demand FROM catalog GROUP BY 1, 2),
        s AS (SELECT category, unnest(range(0, max(bin) + 1)) AS bin FROM f GROUP BY category),
        g AS (SELECT s.category, s.bin, coalesce(items, 0) AS items, cm, sm, coalesce(demand, 0.0) AS demand FROM s LEFT JOIN f ON s.category = f.category AND s.bin = f.bin),
        m AS (SELECT *, median(items) OVER (PARTITION BY category) AS im, median(demand) OVER (PARTITION BY category) AS dm FROM g)
        SELECT category, bin, items, {rnd('cm')} AS comments_mean, {rnd('sm')} AS sales_mean, demand, {rnd('im')} AS items_median, {rnd('dm')} AS demand_median,
          CASE WHEN items <= im AND demand >= dm THEN '蓝海候选' WHEN items > im AND demand >= dm THEN '红海高需' ELSE '普通/低需' END AS verdict,
          {rnd('demand / (items + 1)')} AS blue_ocean_index FROM m""",
    ["catalog"],
)
def price_gap_report(spark, sf):
    out = mk.price_gaps(views.catalog(spark, sf), 20.0)
    return rounded(out, "comments_mean", "sales_mean", "items_median", "demand_median", "blue_ocean_index")


@query(
    "brand_coverage",
    """SELECT category, brand, count(*) AS n, string_agg(DISTINCT price_band, '、' ORDER BY price_band) AS bands, count(DISTINCT flavor) AS flavors FROM banded GROUP BY 1, 2""",
    ["banded"],
)
def brand_coverage(spark, sf):
    return mk.brand_coverage(banded(spark, sf))


@query(
    "brand_portfolio",
    """WITH owned AS (SELECT category, brand FROM (SELECT category, brand, row_number() OVER (PARTITION BY category ORDER BY brand) AS r FROM (SELECT DISTINCT category, brand FROM banded)) WHERE r <= 3),
        mine AS (SELECT * FROM banded SEMI JOIN owned USING (category, brand)), rest AS (SELECT * FROM banded ANTI JOIN owned USING (category, brand)),
        gb AS (SELECT DISTINCT category, price_band FROM banded EXCEPT SELECT category, price_band FROM mine),
        gf AS (SELECT category, flavor FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY flavor) AS r FROM (SELECT DISTINCT category, flavor FROM banded EXCEPT SELECT category, flavor FROM mine)) WHERE r <= 10),
        s AS (SELECT category, brand, count(*) AS n FROM rest GROUP BY 1, 2),
        b AS (SELECT category, brand, count(*) AS nb, string_agg(price_band, '、' ORDER BY price_band) AS bands FROM (SELECT DISTINCT category, brand, price_band FROM rest) SEMI JOIN gb USING (category, price_band) GROUP BY 1, 2),
        f AS (SELECT category, brand, count(*) AS nf, string_agg(flavor, '、' ORDER BY flavor) AS flavors FROM (SELECT DISTINCT category, brand, flavor FROM rest) SEMI JOIN gf USING (category, flavor) GROUP BY 1, 2),
        t AS (SELECT category, brand, n, coalesce(bands, '') AS bands, coalesce(flavors, '') AS flavors, coalesce(nb, 0) * 25 + coalesce(nf, 0) * 10 + least(n, 20) AS score
              FROM s LEFT JOIN b USING (category, brand) LEFT JOIN f USING (category, brand))
        SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, n DESC, brand) AS INT) AS rank FROM t
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, n DESC, brand) <= 15""",
    ["banded"],
)
def brand_portfolio(spark, sf):
    df = stage(banded(spark, sf))
    from shelfwise.operators.dedupe import top_per_group

    owned = top_per_group(df.select("category", "brand").distinct(), ["category"], [F.col("brand").asc()], 3)
    return mk.brand_portfolio(df, owned)


@query(
    "option_counts",
    "SELECT brand, option, count(*) AS n FROM (SELECT brand, unnest([level2, category]) AS option FROM catalog) GROUP BY 1, 2",
    ["catalog"],
)
def option_counts(spark, sf):
    return mk.option_counts(views.catalog(spark, sf))


@query(
    "clearance_plans",
    """SELECT category, a AS price_avg, plan, factor, days, CAST(floor(a * factor + 0.5) AS BIGINT) AS plan_price
       FROM (SELECT category, floor(avg(price) + 0.5) AS a FROM catalog GROUP BY 1),
            (VALUES ('激进', 0.60::DOUBLE, '3-5天'), ('平衡', 0.75::DOUBLE, '7-14天'), ('保守', 0.85::DOUBLE, '14-30天')) v(plan, factor, days)""",
    ["catalog"],
)
def clearance_plans(spark, sf):
    return mk.clearance_plans(views.catalog(spark, sf)).withColumn("price_avg", F.col("price_avg").cast("double"))


@query(
    "table_counts",
    "SELECT 'catalog' AS \"table\", count(*) AS n FROM part UNION ALL SELECT 'offers', count(*) FROM lineitem UNION ALL SELECT 'reviews', count(*) FROM documents UNION ALL SELECT 'feed', count(*) FROM events",
)
def table_counts(spark, sf):
    return mk.table_counts({n: views.table(spark, sf, t) for n, t in (("catalog", "part"), ("offers", "lineitem"), ("reviews", "documents"), ("feed", "events"))})


@query(
    "client_category_stats",
    f"""SELECT level2, count(*) AS n, floor(avg(price) + 0.5) AS price_avg, {rnd('min(price)')} AS price_min, {rnd('max(price)')} AS price_max FROM catalog GROUP BY level2""",
    ["catalog"],
)
def client_category_stats(spark, sf):
    return rounded(
        views.catalog(spark, sf).groupBy("level2").agg(
            F.count(F.lit(1)).alias("n"), F.floor(F.avg("price") + 0.5).cast("double").alias("price_avg"), F.min("price").alias("price_min"), F.max("price").alias("price_max")
        ),
        "price_min", "price_max",
    )
