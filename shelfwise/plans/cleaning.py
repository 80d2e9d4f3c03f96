"""Cleaning of raw listing cells, one query per family of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import tags, urls, words
from shelfwise.functions import text as tx
from shelfwise.functions import weight as wt
from shelfwise.operators import snapshots as sn
from shelfwise.plans.markets import rounded
from shelfwise.plans.registry import query
from shelfwise.plans.sqlviews import bands, rnd
from shelfwise.sources import views
from shelfwise.sources.readers import conform, null_counts

KEYS = ["l_orderkey", "l_linenumber", "l_suppkey", "amount"]
KEY_SQL = "l_orderkey, l_linenumber, l_suppkey, amount"
TIES_SQL = "l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, amount DESC"


@query(
    "clean_text_cells",
    f"SELECT {KEY_SQL}, trim(regexp_replace(shop_name, '[\\s　]+', ' ', 'g')) AS shop, trim(item_id) AS item, length(trim(item_id)) > 0 AS filled FROM listing",
    ["listing"],
)
def clean_text_cells(spark, sf):
    return views.raw_listing(spark, sf).select(
        *KEYS, tx.clean_text("shop_name", collapse=True).alias("shop"), tx.clean_text("item_id").alias("item"), tx.nonempty("item_id").alias("filled")
    )


@query(
    "parse_prices",
    f"""SELECT {KEY_SQL}, CAST(regexp_extract(replace(price, ',', ''), '(\\d+(\\.\\d+)?)', 1) AS DOUBLE) AS price,
        CAST(regexp_extract(replace(original_price, ',', ''), '(\\d+(\\.\\d+)?)', 1) AS DOUBLE) AS original_price FROM listing""",
    ["listing"],
)
def parse_prices(spark, sf):
    return views.raw_listing(spark, sf).select(*KEYS, tx.first_number("price").alias("price"), tx.first_number("original_price", signed=True).alias("original_price"))


@query(
    "parse_magnitudes",
    f"""SELECT {KEY_SQL}, {rnd("CAST(regexp_extract(sales_text, '(\\d+(\\.\\d+)?)', 1) AS DOUBLE) * CASE WHEN contains(sales_text, '万') THEN 10000 ELSE 1 END")} AS sales,
        {rnd("CAST(regexp_extract(review_count, '(\\d+(\\.\\d+)?)', 1) AS DOUBLE) * 10000")} AS reviews FROM listing""",
    ["listing"],
)
def parse_magnitudes(spark, sf):
    return rounded(views.raw_listing(spark, sf).select(*KEYS, tx.magnitude("sales_text").alias("sales"), tx.magnitude("review_count", None).alias("reviews")), "sales", "reviews")


_LOW = "CAST(regexp_extract(sales_text, '(\\d+(\\.\\d+)?)', 1) AS DOUBLE) * CASE WHEN contains(sales_text, '万') THEN 10000 ELSE 1 END"


def _range_sql(upper: str) -> str:
    return f"""SELECT {KEY_SQL}, {rnd('lo')} AS lower, {rnd(upper)} AS upper, CASE WHEN w OR lo >= 1000 THEN 'medium' ELSE 'low' END AS confidence
        FROM (SELECT *, {_LOW} AS lo, contains(sales_text, '万') AS w FROM listing)"""


_UPPER = "CASE WHEN w THEN lo * 5 WHEN lo < 1000 THEN least(lo * 5, 500.0) WHEN lo < 10000 THEN lo * 2 ELSE lo * 5 END"


@query("sales_ranges", _range_sql(_UPPER), ["listing"])
def sales_ranges(spark, sf):
    s = views.raw_listing(spark, sf).withColumn("s", tx.sales_range("sales_text"))
    return rounded(s.select(*KEYS, F.col("s.lower").alias("lower"), F.col("s.upper").alias("upper"), F.col("s.confidence").alias("confidence")), "lower", "upper")


@query("sales_ranges_monotone", _range_sql(f"greatest(lo, {_UPPER})"), ["listing"])
def sales_ranges_monotone(spark, sf):
    s = views.raw_listing(spark, sf).withColumn("s", tx.sales_range("sales_text", "monotone"))
    return rounded(s.select(*KEYS, F.col("s.lower").alias("lower"), F.col("s.upper").alias("upper"), F.col("s.confidence").alias("confidence")), "lower", "upper")


@query(
    "normalize_keys",
    f"""SELECT {KEY_SQL}, sku AS plain, sku AS longest, lpad(sku, 9, '1') AS from_url, lpad(sku, 9, '1') AS sci FROM listing""",
    ["listing"],
)
def normalize_keys(spark, sf):
    raw = views.raw_listing(spark, sf)
    number = F.lpad(tx.normalize_key("item_id"), 9, "1")
    sci = F.concat(F.substring(number, 1, 1), F.lit("."), F.substring(number, 2, 8), F.lit("E+8"))
    return raw.select(
        *KEYS, tx.normalize_key("item_id").alias("plain"),
        tx.normalize_key(F.concat(F.lit("a1b"), tx.normalize_key("item_id"), F.lit("9x"), F.lit("c1")), "longest_run").alias("longest_raw"),
        tx.normalize_key(F.lit(""), url="detail_url").alias("from_url"), tx.normalize_key(sci).alias("sci"),
    ).withColumn("longest", F.substring("longest_raw", F.lit(1), F.length("longest_raw") - 1)).drop("longest_raw")


@query(
    "clean_brands",
    f"""SELECT sku, brand AS spaced, brand AS dashed, brand AS stripped, category AS second, CASE WHEN brand = '' THEN '未知品牌' ELSE brand END AS known FROM catalog""",
    ["catalog"],
)
def clean_brands(spark, sf):
    c = views.catalog(spark, sf)
    raw = F.concat("brand", F.lit(" - "), "category")
    return c.select(
        "sku", tx.clean_brand(raw).alias("spaced"), tx.clean_brand(F.concat("brand", F.lit("－x"), "category"), "dash").alias("dashed"),
        tx.clean_brand(F.concat("brand", F.lit("旗舰店 | "), "category"), "any", True).alias("stripped"), tx.split_pair(raw)[1].alias("second"),
        tx.clean_brand("brand", "dash", unknown=words.UNKNOWN_BRAND).alias("known"),
    )


@query(
    "category_paths",
    f"""SELECT {KEY_SQL}, 'Goods' AS l1, level2 AS l2, split_part(category, ' ', 2) AS l3, '' AS r1, level2 AS r2, split_part(category, ' ', 2) AS r3,
        split_part(category, ' ', 2) AS leaf, CASE WHEN level2 = 'PROMO' THEN '' ELSE level2 END AS cleaned FROM listing""",
    ["listing"],
)
def category_paths(spark, sf):
    raw = views.raw_listing(spark, sf)
    left = tx.category_levels("category_breadcrumb", "left")
    tail = F.regexp_replace("category_breadcrumb", "^Goods > ", "")
    right = tx.category_levels(tail)
    promo = F.regexp_replace(left["level2"], "^PROMO$", "PROMO热卖榜")
    return raw.select(
        *KEYS, left["level1"].alias("l1"), left["level2"].alias("l2"), left["level3"].alias("l3"), right["level1"].alias("r1"), right["level2"].alias("r2"),
        right["level3"].alias("r3"), tx.category_leaf("category_breadcrumb").alias("leaf"), tx.clean_category(promo).alias("cleaned"),
    )


@query(
    "promotion_cells",
    f"""SELECT {KEY_SQL}, array_to_string(list_filter(regexp_split_to_array(promotion_tag, '[|, ]+'), lambda x: x <> ''), '|') AS tags,
        regexp_matches(promotion_tag, '券|满减|百亿补贴') AS coupon, promotion_tag <> '' AS promoted,
        CASE WHEN promotion_tag = '' THEN '无促销' WHEN regexp_matches(promotion_tag, '券|礼金') THEN '优惠券/礼金' WHEN regexp_matches(promotion_tag, '满|减|每') THEN '满减'
             WHEN regexp_matches(promotion_tag, '直降|特价|秒杀|折') THEN '限时特价/折扣' WHEN contains(promotion_tag, '包邮') THEN '包邮' ELSE '其他促销' END AS kind FROM listing""",
    ["listing"],
)
def promotion_cells(spark, sf):
    return views.raw_listing(spark, sf).select(
        *KEYS, F.array_join(tx.promo_tokens("promotion_tag"), "|").alias("tags"), tx.matches_flag("promotion_tag", words.COUPON_PATTERN).alias("coupon"),
        tx.has_promotion("promotion_tag").alias("promoted"), tx.promotion_kind("promotion_tag").alias("kind"),
    )


@query(
    "store_types",
    f"SELECT {KEY_SQL}, CASE WHEN regexp_matches(shop, '京东自营|自营旗舰店|自营店') THEN '京东自营' ELSE '第三方店铺' END AS store_type FROM listing",
    ["listing"],
)
def store_types(spark, sf):
    return views.raw_listing(spark, sf).select(*KEYS, tx.store_type("shop_name").alias("store_type"))


@query(
    "merged_cells",
    """SELECT sku, CASE WHEN package_type = '' THEN flavor ELSE package_type END AS first, CASE WHEN package_type <> '' THEN package_type ELSE flavor END AS preferred,
       package_type IS NOT NULL AND package_type <> '' AS filled FROM catalog""",
    ["catalog"],
)
def merged_cells(spark, sf):
    return views.catalog(spark, sf).select(
        "sku", tx.merge_first("package_type", "flavor").alias("first"), tx.merge_prefer_right("flavor", "package_type").alias("preferred"), tx.nonempty("package_type").alias("filled")
    )


@query(
    "keyword_cells",
    """SELECT sku, flavor || ';' || level2 AS json_form, flavor || ';' || level2 AS literal_form, flavor || ';' || level2 AS delimited_form FROM catalog""",
    ["catalog"],
)
def keyword_cells(spark, sf):
    j = F.concat(F.lit('["'), "flavor", F.lit('", "'), "level2", F.lit('"]'))
    p = F.concat(F.lit("['"), "flavor", F.lit("', '"), "level2", F.lit("']"))
    d = F.concat("flavor", F.lit("，"), "level2", F.lit(";"))
    return views.catalog(spark, sf).select(
        "sku", *[F.array_join(tx.keyword_list(c), ";").alias(n) for n, c in (("json_form", j), ("literal_form", p), ("delimited_form", d))]
    )


@query(
    "unit_prices_and_discounts",
    f"""SELECT {KEY_SQL}, {rnd('price / nullif(weight_g, 0)', 6)} AS unit_price, {rnd('greatest((original_price - price) / original_price, 0)', 6)} AS discount_rate FROM offers""",
    ["offers"],
)
def unit_prices_and_discounts(spark, sf):
    o = views.offers(spark, sf).select(*KEYS, tx.unit_price("price", "weight_g").alias("unit_price"), tx.discount_rate("price", "original_price").alias("discount_rate"))
    return rounded(o, "unit_price", "discount_rate", digits=6)


@query(
    "price_bands",
    f"""SELECT {KEY_SQL}, {bands('price', *words.REPORT_BANDS)} AS report_band, {bands('price', *words.POSITION_BANDS)} AS position_band, {bands('price', *words.COARSE_BANDS)} AS coarse_band FROM offers""",
    ["offers"],
)
def price_bands(spark, sf):
    return views.offers(spark, sf).select(
        *KEYS, tx.band("price", *words.REPORT_BANDS).alias("report_band"), tx.band("price", *words.POSITION_BANDS).alias("position_band"), tx.band("price", *words.COARSE_BANDS).alias("coarse_band")
    )


@query(
    "sample_confidence",
    "SELECT category, brand, count(*) AS n, CASE WHEN count(*) >= 80 THEN '高' WHEN count(*) >= 30 THEN '中' WHEN count(*) >= 10 THEN '低' ELSE '不足' END AS confidence FROM offers GROUP BY 1, 2",
    ["offers"],
)
def sample_confidence(spark, sf):
    return views.offers(spark, sf).groupBy("category", "brand").agg(F.count(F.lit(1)).alias("n")).withColumn("confidence", tx.confidence_label("n"))


@query(
    "brand_backfill",
    """SELECT sku, CASE WHEN has_promotion THEN brand WHEN is_gift THEN level2 ELSE shop END AS brand FROM (SELECT *, substr(shop, 1, 12) AS s FROM (SELECT * REPLACE (substr(shop, 1, 12) AS shop) FROM catalog))""",
    ["catalog"],
)
def brand_backfill(spark, sf):
    c = views.catalog(spark, sf)
    explicit = F.when(F.col("has_promotion"), F.col("brand"))
    pair = F.when(F.col("is_gift"), F.concat("level2", F.lit(" - "), "category"))
    return c.select("sku", tx.brand_backfill([explicit], F.coalesce(pair, F.lit("")), F.concat("shop", F.lit("京东自营官方旗舰店")), "title").alias("brand"))


@query(
    "category_translation",
    """SELECT sku, CASE level2 WHEN 'PROMO' THEN '促销' WHEN 'SMALL' THEN '小号' ELSE level2 END AS level2 FROM catalog""",
    ["catalog"],
)
def category_translation(spark, sf):
    from shelfwise.sources.readers import translate

    names = spark.createDataFrame([("PROMO", "促销"), ("SMALL", "小号")], "id string, name string")
    return translate(views.catalog(spark, sf).select("sku", "level2"), "level2", names)


@query(
    "conformed_offers",
    """SELECT sku, title, price, '' AS level1, CAST(NULL AS DOUBLE) AS rating, brand FROM offers""",
    ["offers"],
)
def conformed_offers(spark, sf):
    raw = views.offers(spark, sf).select(F.col("sku").alias("ITEM_ID"), F.col("title").alias("Product_Title"), F.col("price").cast("string").alias("现价"), "brand")
    return conform(raw, {
        "sku": {"aliases": ["item_id", "product_id"], "required": True}, "title": {"aliases": ["product_title"]}, "price": {"aliases": ["现价"], "type": "double"},
        "level1": {"default": ""}, "rating": {"type": "double"}, "brand": {},
    })


@query(
    "column_value_counts",
    """SELECT 'title' AS "column", count(title) AS non_null FROM catalog UNION ALL SELECT 'brand', count(brand) FROM catalog UNION ALL SELECT 'package', count(nullif(package_type, '')) FROM catalog
       UNION ALL SELECT 'nothing', 0""",
    ["catalog"],
)
def column_value_counts(spark, sf):
    c = views.catalog(spark, sf).select("title", "brand", F.nullif("package_type", F.lit("")).alias("package"), F.lit(None).cast("string").alias("nothing"))
    return null_counts(c)


# --- weights and tags from listing titles -------------------------------------
_W = "CAST(regexp_extract(title, '(\\d+)g\\*(\\d+)', 1) AS DOUBLE)"
_N = "CAST(regexp_extract(title, '(\\d+)g\\*(\\d+)', 2) AS DOUBLE)"


@query(
    "title_weights",
    f"""SELECT {KEY_SQL}, {_W} AS first, {_W} * {_N} AS multi, {_W} AS strict, {_W} * {_N} AS structured, '倍数重量' AS note, {_W} * {_N} AS fallback FROM listing""",
    ["listing"],
)
def title_weights(spark, sf):
    return views.raw_listing(spark, sf).withColumn("s", wt.weight_structured("title")).select(
        *KEYS, wt.weight_first("title").alias("first"), wt.weight_multi("title").alias("multi"), wt.weight_strict("title").alias("strict"),
        F.col("s.weight_g").alias("structured"), F.col("s.note").alias("note"), wt.weight_fallback("title", F.col("s.weight_g")).alias("fallback"),
    )


@query(
    "title_tags",
    f"""SELECT {KEY_SQL}, '袋装' AS packages, CASE WHEN contains(lower(level2), 'g') THEN '' ELSE '系列:' || level2 || ';' END || CAST(q AS VARCHAR) || '袋' AS specification, false AS gift,
        CASE WHEN contains(title, 'bolt') THEN 'bolt' WHEN contains(title, 'ring') THEN 'ring' ELSE '' END AS flavor FROM listing""",
    ["listing"],
)
def title_tags(spark, sf):
    name = F.col("_name")
    return views.raw_listing(spark, sf).withColumn("_name", tx.normalize_text("title")).select(
        *KEYS, F.array_join(tags.package_tags(name), ";").alias("packages"), F.array_join(tags.specification(name), ";").alias("specification"), tags.is_gift(name).alias("gift"),
        F.array_join(tags.flavor_tags(name, ["bolt", "bol", "ring", "in"]), ";").alias("flavor_all"),
    ).withColumn("flavor", F.when(F.contains("flavor_all", F.lit("bolt")), "bolt").when(F.contains("flavor_all", F.lit("ring")), "ring").otherwise("")).drop("flavor_all")


# --- listing jobs -------------------------------------------------------------
_LISTING_SQL = f"""SELECT sku AS product_id, title AS product_title, CAST(regexp_extract(replace(price, ',', ''), '(\\d+(\\.\\d+)?)', 1) AS DOUBLE) AS current_price,
        array_to_string(list_filter(regexp_split_to_array(promotion_tag, '[|, ]+'), lambda x: x <> ''), '|') AS promotion_tags, {rnd('lo')} AS sales_sort,
        CASE WHEN w OR lo >= 1000 THEN 'medium' ELSE 'low' END AS sales_confidence, shop AS shop_name, category_breadcrumb AS category_path, CAST(crawl_time AS DATE) AS crawl_date
        FROM (SELECT *, {_LOW} AS lo, contains(sales_text, '万') AS w FROM listing)
        QUALIFY row_number() OVER (PARTITION BY sku ORDER BY lo DESC, crawl_time DESC, {TIES_SQL}) = 1"""


@query("prepared_listing", _LISTING_SQL, ["listing"])
def prepared_listing(spark, sf):
    out = sn.prepare_listing(views.raw_listing(spark, sf), KEYS).withColumn("crawl_date", F.to_date("crawl_timestamp"))
    return rounded(out, "sales_sort").select("product_id", "product_title", "current_price", "promotion_tags", "sales_sort", "sales_confidence", "shop_name", "category_path", "crawl_date")


@query(
    "appended_listing",
    f"""WITH a AS (SELECT sku AS product_id, shop AS shop_name, {_LOW} AS lo FROM listing WHERE crawl_year = (SELECT max(crawl_year) FROM listing) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY lo DESC, crawl_time DESC, {TIES_SQL}) = 1),
        b AS (SELECT sku AS product_id, shop AS shop_name, {_LOW} AS lo FROM listing WHERE crawl_year < (SELECT max(crawl_year) FROM listing) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY lo DESC, crawl_time DESC, {TIES_SQL}) = 1)
        SELECT product_id, shop_name, {rnd('lo')} AS sales_sort FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY lo DESC, s) = 1""",
    ["listing"],
)
def appended_listing(spark, sf):
    """The last year's crawl before all earlier ones."""
    raw = views.raw_listing(spark, sf)
    last = raw.agg(F.max("crawl_year")).first()[0]
    new, old = (sn.prepare_listing(raw.where(part), KEYS) for part in (F.col("crawl_year") == last, F.col("crawl_year") < last))
    return rounded(sn.append_existing(new, old), "sales_sort").select("product_id", "shop_name", "sales_sort")


@query(
    "url_parts",
    f"""SELECT {KEY_SQL}, lpad(sku, 9, '1') AS product_id, 'https:' || detail_url AS canonical, 'item.jd.com' AS host,
        'https://item.jd.com/' || lpad(sku, 9, '1') || '.html?from=page&page=2' AS rewritten FROM listing""",
    ["listing"],
)
def url_parts(spark, sf):
    # a column of its own: all other parts start from it
    c = views.raw_listing(spark, sf).select(*KEYS, "detail_url", urls.canonical_url("detail_url").alias("canonical"))
    return c.select(
        *KEYS, urls.product_id("detail_url", canonical=F.col("canonical")).alias("product_id"), "canonical", urls.url_host("canonical").alias("host"),
        urls.set_query_params("canonical", {"from": "page", "page": "2"}).alias("rewritten"),
    )
