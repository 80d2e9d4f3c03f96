"""Catalog, offers, snapshots, feeds and texts out of the sample star schema.

The same views exist as SQL in :mod:`shelfwise.plans.sqlviews` for the result check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.dedupe import keep_one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan of a few unsplittable files before text-heavy work.

    Off unless the session sets ``spark.shelfwise.minScanPartitions``: a table of many files already
    scans in parallel, and then the extra shuffle would only cost.
    """
    n = int(df.sparkSession.conf.get("spark.shelfwise.minScanPartitions", "0"))
    return df.repartition(n) if n > 1 else df


def cents(c: Column) -> Column:
    """Two decimals by plain arithmetic, the same in every engine."""
    return F.floor(c * 100 + 0.5) / 100


_PROMOTIONS = ["", "包邮", "包邮", "满99减10", "满99减10", "优惠券", "优惠券", "限时特价 秒杀", "限时特价 秒杀", "券,包邮", "券,包邮"]


def promotion_text(discount: Column) -> Column:
    """Promotion wording that goes with a discount of 0 to 10 percent."""
    step = F.floor(discount * 100 + 0.5).cast("int")
    return F.element_at(F.array(*[F.lit(p) for p in _PROMOTIONS]), step + 1)


def noun(name: Column) -> Column:
    return F.split(name, " ")[1]


def adjective(name: Column) -> Column:
    return F.split(name, " ")[0]


def part_columns() -> list[Column]:
    p = F.col
    return [
        p("p_partkey"),
        p("p_name").alias("title"),
        p("p_brand").alias("brand"),
        p("p_type").alias("level2"),
        F.concat(p("p_type"), F.lit(" "), noun(p("p_name"))).alias("category"),
        adjective(p("p_name")).alias("flavor"),
        (p("p_size") * 10).cast("double").alias("weight_g"),
        cents(p("p_retailprice") / p("p_size")).alias("price"),
    ]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product: parts with what their line items say about sales, offers and promotions."""
    li = table(spark, sf_dir, "lineitem")
    stats = li.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("sales"),
        F.count(F.lit(1)).cast("double").alias("comments"),
        F.countDistinct("l_suppkey").alias("shops"),
        F.min("l_suppkey").alias("shop_key"),
        F.max_by("l_discount", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")).alias("last_discount"),
        F.max("l_shipdate").alias("crawl_time"),
    )
    part = table(spark, sf_dir, "part").select(*part_columns())
    df = part.join(stats, part.p_partkey == stats.l_partkey, "left")
    d = F.coalesce("last_discount", F.lit(0.0))
    return df.select(
        F.col("p_partkey").cast("string").alias("sku"),
        "title", "brand", "level2", "category", "flavor", "weight_g", "price",
        cents(F.col("price") / (1 - d)).alias("original_price"),
        F.coalesce("sales", F.lit(0.0)).alias("sales"),
        F.coalesce("comments", F.lit(0.0)).alias("comments"),
        F.coalesce("shops", F.lit(0)).alias("shops"),
        F.concat(F.lit("Supplier "), F.coalesce(F.col("shop_key").cast("string"), F.lit("?"))).alias("shop"),
        promotion_text(d).alias("promotion"),
        (d > 0).alias("has_promotion"),
        F.when(F.col("weight_g") >= 300, "箱装").when(F.col("weight_g") >= 100, "袋装").otherwise("").alias("package_type"),
        (F.col("weight_g") > 400).alias("is_gift"),
        (F.col("price") / F.col("weight_g")).alias("unit_price"),
        F.greatest((cents(F.col("price") / (1 - d)) - F.col("price")) / cents(F.col("price") / (1 - d)), F.lit(0.0)).alias("discount_rate"),
        F.col("crawl_time").cast("date").alias("crawl_date"),
    )


def offers(spark: SparkSession, sf_dir: str, parallel: bool = False) -> DataFrame:
    """One row per line item: a shop's offer of a product on a day. ``parallel`` prepares for text-heavy work."""
    li = table(spark, sf_dir, "lineitem")
    li = spread(li) if parallel else li
    part = table(spark, sf_dir, "part").select(*part_columns()).drop("price")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    df = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    price = cents(F.col("l_extendedprice") / F.col("l_quantity") / 100)
    suffix = F.when(F.col("s_nationkey") < 8, "京东自营旗舰店").when(F.col("s_nationkey") < 16, "专营店").otherwise("店铺")
    return df.select(
        F.col("l_partkey").cast("string").alias("sku"),
        "title", "brand", "level2", "category", "flavor", "weight_g",
        F.col("s_name").alias("shop_key"),
        F.concat("s_name", suffix).alias("shop"),
        price.alias("price"),
        cents(price / (1 - F.col("l_discount"))).alias("original_price"),
        F.col("l_quantity").alias("sales"),
        F.floor(F.col("l_tax") * 100 + 0.5).cast("double").alias("comments"),
        promotion_text(F.col("l_discount")).alias("promotion"),
        F.col("l_discount").alias("discount"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag",
        F.col("l_extendedprice").alias("amount"),
    )


OFFER_TIES = ["l_orderkey", "l_linenumber", "l_suppkey", "sales", "amount"]


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers as a crawler would have seen them: every cell dirty text."""
    o = offers(spark, sf_dir, parallel=True)
    c = F.floor(F.col("price") * 100 + 0.5).cast("bigint")
    whole, rest = (c / 100).cast("bigint"), F.lpad((c % 100).cast("string"), 2, "0")
    grouped = F.when(whole >= 1000, F.concat((whole / 1000).cast("bigint").cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    q = F.col("sales").cast("int")
    sales = (
        F.when(F.col("l_returnflag") == "N", F.concat(q.cast("string"), F.lit("+")))
        .when(F.col("l_returnflag") == "A", F.concat((q * 100).cast("string"), F.lit("+")))
        .otherwise(F.concat((q / 10).cast("int").cast("string"), F.lit("."), (q % 10).cast("string"), F.lit("万+")))
    )
    item = (
        F.when(F.col("l_returnflag") == "A", F.concat("sku", F.lit(".0")))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit(" "), "sku", F.lit(" ")))
        .otherwise(F.col("sku"))
    )
    n = F.split("category", " ")[1]
    return o.select(
        item.alias("item_id"),
        F.concat(F.lit("【"), "level2", F.lit("】"), "brand", F.lit(" "), "title", F.lit(" "), F.col("weight_g").cast("int").cast("string"), F.lit("g*"), q.cast("string"), F.lit("袋")).alias("title"),
        F.concat(F.lit("￥"), grouped, F.lit("."), rest).alias("price"),
        F.concat(F.lit("原价 "), grouped, F.lit("."), rest, F.lit(" 元")).alias("original_price"),
        F.col("promotion").alias("promotion_tag"),
        F.concat(F.col("comments").cast("int").cast("string"), F.lit("万+")).alias("review_count"),
        sales.alias("sales_text"),
        F.concat(F.lit(" "), "shop", F.lit("　")).alias("shop_name"),
        F.concat(F.lit("Goods > "), "level2", F.lit(" > "), n).alias("category_breadcrumb"),
        F.concat(F.lit("//item.jd.com/"), F.lpad("sku", 9, "1"), F.lit(".html?from=list")).alias("detail_url"),
        F.col("ship_date").cast("string").alias("crawl_time"),
        F.year("ship_date").alias("crawl_year"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("amount"),
    )


SNAPSHOT = ["sku", "title", "brand", "category", "shop", "price", "original_price", "sales", "comments", "promotion", "ship_date"]


def last_offers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last offer of every key."""
    return keep_one(rows, keys, [F.col("ship_date").desc(), *[F.col(c).desc() for c in OFFER_TIES]])


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last offer of every product over all years."""
    return last_offers(offers(spark, sf_dir), ["sku"]).select(*SNAPSHOT)


def snapshot_rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every year's crawl against the next one's, for all pairs of consecutive years at once: the key is the product and the earlier year."""
    rows = last_offers(offers(spark, sf_dir).withColumn("year", F.year("ship_date")), ["sku", "year"])
    first, last = offers(spark, sf_dir).agg(F.min(F.year("ship_date")), F.max(F.year("ship_date"))).first()
    key = lambda year: F.concat("sku", F.lit("@"), year.cast("string")).alias("sku")
    old = rows.where(F.col("year") < last).select(key(F.col("year")), *SNAPSHOT[1:])
    return old, rows.where(F.col("year") > first).select(key(F.col("year") - 1), *SNAPSHOT[1:])


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawler feed log: a status per item and time."""
    e = table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "signup", "access_blocked")
        .when(F.col("event_type") == "view", "no_result")
        .otherwise("success")
    )
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("item_id"), status.alias("status"),
        "value", F.get_json_object("props", "$.k").try_cast("int").alias("cards"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews of the source they belong to; labels mark the negative ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("item_id"), "n_chars")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").withColumn("negative", F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), "text")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
