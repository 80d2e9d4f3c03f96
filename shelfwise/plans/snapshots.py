"""Snapshot merge, change capture, reconciliation, supplements and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.functions import words
from shelfwise.operators import dedupe as dd
from shelfwise.operators import integration as ig
from shelfwise.operators import quality as ql
from shelfwise.operators import snapshots as sn
from shelfwise.operators import states as st
from shelfwise.operators import targets as tg
from shelfwise.operators import validity as vl
from shelfwise.plans.markets import rounded
from shelfwise.plans.registry import query
from shelfwise.plans.sqlviews import rnd
from shelfwise.sources import views
from shelfwise.sources.staging import new_path, stage

TIES = ["l_orderkey", "l_linenumber", "l_suppkey", "sales", "amount"]
TIES_DESC = ", ".join(f"{c} DESC" for c in TIES)


def pair(spark, sf):
    return [s.withColumn("sales_text", F.concat(F.col("sales").cast("int").cast("string"), F.lit("+"))) for s in views.snapshot_rounds(spark, sf)]


_J = """j AS (SELECT o.sku AS osku, n.sku AS nsku, o.shop AS os, n.shop AS ns, o.promotion AS opr, n.promotion AS npr, o.price AS op, n.price AS np, o.original_price AS oo, n.original_price AS no,
     o.comments AS oc, n.comments AS nc, CAST(CAST(o.sales AS INT) AS VARCHAR) || '+' AS ost, CAST(CAST(n.sales AS INT) AS VARCHAR) || '+' AS nst
     FROM snap_old o FULL OUTER JOIN snap_new n ON o.sku = n.sku)"""


@query(
    "snapshot_merge",
    f"""WITH {_J} SELECT coalesce(osku, nsku) AS sku, CASE WHEN osku IS NULL THEN 'new' WHEN nsku IS NULL THEN 'not_seen' ELSE 'matched' END AS state,
        CASE WHEN osku IS NULL OR (nsku IS NOT NULL AND abs(np - op) > 1e-4) THEN np ELSE op END AS price, CASE WHEN abs(np - op) > 1e-4 THEN op END AS price_history,
        coalesce(abs(np - op) > 1e-4, false) AS price_changed, coalesce(no, oo) AS original_price,
        CASE WHEN osku IS NULL OR (nsku IS NOT NULL AND npr <> '' AND npr <> opr) THEN npr ELSE opr END AS promotion, CASE WHEN osku IS NULL OR nc > oc THEN nc ELSE oc END AS comments,
        CASE WHEN osku IS NOT NULL AND nsku IS NOT NULL THEN greatest(nc - oc, 0.0) END AS review_growth, coalesce(nst, ost) AS sales_text FROM j""",
    ["snap_old", "snap_new"],
)
def snapshot_merge(spark, sf):
    old, new = pair(spark, sf)
    return sn.merge_snapshots(old, new).select(
        "sku", "state", "price", "price_history", "price_changed", "original_price", "promotion", "comments", "review_growth", "sales_text"
    )


_LOG = f"""WITH {_J}, m AS (SELECT * FROM j WHERE osku IS NOT NULL AND nsku IS NOT NULL),
   l AS (SELECT osku AS sku, 'shop' AS field, os AS old_value, ns AS new_value, 'updated' AS change_type, CAST(NULL AS DOUBLE) AS amount FROM m WHERE os <> ns
     UNION ALL SELECT osku, 'promotion', opr, npr, 'updated', NULL FROM m WHERE npr <> '' AND opr <> npr
     UNION ALL SELECT osku, 'price', CAST(op AS VARCHAR), CAST(np AS VARCHAR), CASE WHEN np > op THEN 'up' ELSE 'down' END, np - op FROM m WHERE abs(np - op) > 1e-4
     UNION ALL SELECT osku, 'reviews', CAST(oc AS VARCHAR), CAST(nc AS VARCHAR), 'growth', nc - oc FROM m WHERE nc > oc
     UNION ALL SELECT osku, 'sales_text', ost, nst, 'updated', NULL FROM m WHERE ost <> nst)"""


@query("change_log", f"{_LOG} SELECT sku, field, old_value, new_value, change_type, {rnd('amount')} AS change_amount FROM l", ["snap_old", "snap_new"])
def change_log(spark, sf):
    old, new = pair(spark, sf)
    return rounded(sn.change_log(old, new).drop("change_desc"), "change_amount")


@query("change_counts", f"{_LOG} SELECT field, change_type, count(*) AS n FROM l GROUP BY 1, 2", ["snap_old", "snap_new"])
def change_counts(spark, sf):
    return sn.change_counts(sn.change_log(*pair(spark, sf)))


@query(
    "snapshot_coverage",
    f"""WITH {_J} SELECT count(*) AS total, count(*) FILTER (osku IS NOT NULL AND nsku IS NOT NULL) AS matched, count(*) FILTER (osku IS NULL) AS new_only, count(*) FILTER (nsku IS NULL) AS not_seen,
        {rnd('count(*) FILTER (osku IS NOT NULL AND nsku IS NOT NULL) * 100.0 / count(*)')} AS matched_pct, {rnd('count(*) FILTER (osku IS NULL) * 100.0 / count(*)')} AS new_pct,
        {rnd('count(*) FILTER (nsku IS NULL) * 100.0 / count(*)')} AS not_seen_pct FROM j""",
    ["snap_old", "snap_new"],
)
def snapshot_coverage(spark, sf):
    old, new = pair(spark, sf)
    return rounded(sn.coverage(old, new), "matched_pct", "new_pct", "not_seen_pct")


@query(
    "key_sets",
    """SELECT 'both' AS side, sku FROM (SELECT sku FROM snap_old INTERSECT SELECT sku FROM snap_new) UNION ALL SELECT 'old_only', sku FROM (SELECT sku FROM snap_old EXCEPT SELECT sku FROM snap_new)
       UNION ALL SELECT 'new_only', sku FROM (SELECT sku FROM snap_new EXCEPT SELECT sku FROM snap_old)""",
    ["snap_old", "snap_new"],
)
def key_sets(spark, sf):
    old, new = (s.select("sku") for s in pair(spark, sf))
    side = lambda df, n: df.select(F.lit(n).alias("side"), "sku")
    return side(old.intersect(new), "both").unionByName(side(old.join(new, "sku", "left_anti"), "old_only")).unionByName(side(new.join(old, "sku", "left_anti"), "new_only"))


@query(
    "new_over_history",
    """SELECT coalesce(n.sku, o.sku) AS sku, coalesce(n.price, o.price) AS price, n.sku IS NOT NULL AS is_new_crawl, o.ship_date AS old_only_date
       FROM snap_new n FULL OUTER JOIN (SELECT * FROM snap_old) o ON n.sku = o.sku AND n.sku IS NOT NULL WHERE n.sku IS NULL OR o.sku IS NULL OR true""",
    ["snap_old", "snap_new"],
)
def new_over_history(spark, sf):
    old, new = pair(spark, sf)
    a = new.select(F.col("sku").alias("product_id"), "price", F.col("sales").alias("sales_sort"))
    b = old.select(F.col("sku").alias("product_id"), "price", F.col("sales").alias("sales_sort"), "ship_date")
    merged = sn.with_history(a, b).select(F.col("product_id").alias("sku"), "price", "is_new_crawl")
    return merged.join(old.select("sku", F.col("ship_date").alias("old_only_date")), "sku", "left")


_MONTHLY = """m AS (SELECT * FROM (SELECT sku, date_trunc('year', ship_date)::DATE AS snapshot_date, price, comments, ship_date, l_orderkey, l_linenumber, l_suppkey, sales, amount FROM offers)
    QUALIFY row_number() OVER (PARTITION BY sku, snapshot_date ORDER BY ship_date DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, sales DESC, amount DESC) = 1)"""


def yearly(spark, sf):
    o = views.offers(spark, sf).withColumn("snapshot_date", F.trunc("ship_date", "year"))
    order = [F.col("ship_date").desc(), *[F.col(c).desc() for c in TIES]]
    return dd.keep_one(o, ["sku", "snapshot_date"], order).select("sku", "snapshot_date", "price", "comments")


@query(
    "snapshot_deltas",
    f"""WITH {_MONTHLY} SELECT sku, snapshot_date, price, comments, {rnd('coalesce(price - lag(price) OVER w, 0.0)')} AS price_change, coalesce(comments - lag(comments) OVER w, 0.0) AS review_change
        FROM m WINDOW w AS (PARTITION BY sku ORDER BY snapshot_date)""",
    ["offers"],
)
def snapshot_deltas(spark, sf):
    return rounded(sn.snapshot_deltas(yearly(spark, sf)), "price_change")


@query(
    "snapshot_trend",
    f"WITH {_MONTHLY} SELECT snapshot_date, count(*) AS n, {rnd('avg(price)')} AS price_mean, {rnd('avg(comments)')} AS comments_mean FROM m GROUP BY 1",
    ["offers"],
)
def snapshot_trend(spark, sf):
    return rounded(sn.trend(yearly(spark, sf)), "price_mean", "comments_mean")


_STRETCHES = f"""{_MONTHLY}, c AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS i FROM (SELECT DISTINCT snapshot_date FROM m)),
    g AS (SELECT sku, snapshot_date, comments, i, CASE WHEN comments IS NOT DISTINCT FROM lag(comments) OVER w AND lag(i) OVER w = i - 1 THEN 0 ELSE 1 END AS f
          FROM m JOIN c USING (snapshot_date) WINDOW w AS (PARTITION BY sku ORDER BY snapshot_date)),
    s AS (SELECT *, sum(f) OVER (PARTITION BY sku ORDER BY i) AS st FROM g),
    v AS (SELECT sku, any_value(comments) AS comments, min(snapshot_date) AS valid_from, max(i) AS last, count(*) AS rounds FROM s GROUP BY sku, st)"""


@query(
    "validity_history",
    f"WITH {_STRETCHES} SELECT sku, comments, valid_from, c.snapshot_date AS valid_to, rounds FROM v LEFT JOIN c ON c.i = last + 1",
    ["offers"],
)
def validity_history(spark, sf):
    return vl.intervals(yearly(spark, sf), "sku", "snapshot_date", ["comments"])


@query(
    "validity_as_of",
    f"""WITH {_MONTHLY}, q AS (SELECT o_orderkey, CAST(o_orderkey % (SELECT count(*) FROM part) AS VARCHAR) AS sku, CAST(o_orderdate AS DATE) AS day FROM orders),
        r AS (SELECT *, (SELECT max(snapshot_date) FROM m) AS newest FROM q)
        SELECT o_orderkey, r.sku, day, comments AS as_of_comments, price AS as_of_price FROM r LEFT JOIN m ON m.sku = r.sku AND m.snapshot_date = least(date_trunc('year', day)::DATE, newest)""",
    ["offers"],
)
def validity_as_of(spark, sf):
    history = vl.intervals(yearly(spark, sf), "sku", "snapshot_date", ["comments", "price"])
    parts = views.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    q = views.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % parts).cast("string").alias("sku"), F.to_date("o_orderdate").alias("day"))
    return vl.as_of_join(q, history, "sku", "day", ["comments", "price"])


@query(
    "market_states",
    f"""SELECT category, count(*) AS n, count(DISTINCT sku) AS items, {rnd('sum(price)')} AS price_sum, {rnd('avg(price)')} AS price_mean, min(price) AS price_min, max(price) AS price_max,
        {rnd('median(price)')} AS price_median, {rnd('sum(sales)')} AS sales_sum, {rnd('median(sales)')} AS sales_median FROM offers GROUP BY category""",
    ["offers"],
)
def market_states(spark, sf):
    """States of every month are written, the last month is written again, the whole period is read from the states."""
    o = stage(views.offers(spark, sf).select("category", "sku", "price", "sales", F.trunc("ship_date", "month").alias("month")))
    path, keys, measures = new_path(spark, "states"), ["category"], ["price", "sales"]
    st.write_states(o, path, "month", keys, measures, "sku")
    st.write_states(o.where(F.col("month") == o.agg(F.max("month").alias("m")).scalar()), path, "month", keys, measures, "sku")
    sums = st.merged(spark.read.parquet(f"{path}/sums"), keys, measures)
    exact = st.merged_exact(spark.read.parquet(f"{path}/points"), keys, measures)
    out = sums.join(exact, "category").select(
        "category", "n", "items", "price_sum", "price_mean", "price_min", "price_max", F.col("price_quantile").alias("price_median"), "sales_sum", F.col("sales_quantile").alias("sales_median")
    )
    return rounded(out, "price_sum", "price_mean", "price_median", "sales_sum", "sales_median")


@query(
    "search_keywords",
    """SELECT DISTINCT 'brand' AS kind, brand, '' AS category FROM catalog UNION ALL SELECT DISTINCT 'pair', brand, category FROM catalog
       UNION ALL SELECT 'category', '', c FROM (SELECT category AS c FROM catalog UNION SELECT level2 FROM catalog)""",
    ["catalog"],
)
def search_keywords(spark, sf):
    return sn.search_keywords(views.catalog(spark, sf).withColumn("brand_raw", F.concat("brand", F.lit(" - "), "category")))


@query(
    "historical_unified",
    f"""SELECT sku AS product_id, title AS product_title, price AS current_price, promotion AS promotion_tags, CAST(sales * 100 AS DOUBLE) AS sales_lower, 'medium' AS sales_confidence,
        'Goods > ' || level2 || ' > ' || category AS category_path FROM catalog""",
    ["catalog"],
)
def historical_unified(spark, sf):
    c = views.catalog(spark, sf)
    hist = c.select(
        F.concat("sku", F.lit(".0")).alias("sku"), "title", F.format_string("￥%.2f", "price").alias("price"), F.format_string("%.2f", "original_price").alias("original_price"),
        F.regexp_replace("promotion", "[, ]", "|").alias("promotion"), "comments", F.concat((F.col("sales") * 100).cast("bigint").cast("string"), F.lit("+")).alias("sales_text"), "shop",
        F.lit("Goods").alias("level1"), "level2", "category",
    )
    out = sn.historical_to_unified(hist).withColumn("promotion_tags", F.regexp_replace("promotion_tags", r"\|", ","))
    out = out.withColumn("promotion_tags", F.regexp_replace("promotion_tags", "限时特价,秒杀", "限时特价 秒杀"))
    return out.select("product_id", "product_title", "current_price", "promotion_tags", "sales_lower", "sales_confidence", "category_path")


# --- supplements --------------------------------------------------------------
@query(
    "negative_review_counts",
    """SELECT c.sku, coalesce(n, 0) AS negative_review_count FROM catalog c LEFT JOIN (SELECT sku, count(*) AS n FROM offers WHERE l_returnflag = 'R' GROUP BY 1) r USING (sku)""",
    ["catalog", "offers"],
)
def negative_review_counts(spark, sf):
    bad = views.offers(spark, sf).where(F.col("l_returnflag") == "R")
    return ig.attach_counts(views.catalog(spark, sf).select("sku"), bad, "sku", "negative_review_count")


@query(
    "latest_details",
    f"""SELECT c.sku, d.shop AS detail_shop, d.ship_date AS detail_date FROM catalog c LEFT JOIN (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY sku ORDER BY ship_date DESC, {TIES_DESC}) = 1) d USING (sku)""",
    ["catalog", "offers"],
)
def latest_details(spark, sf):
    c = views.catalog(spark, sf).select("sku", F.lit("stale").alias("detail_shop"))
    return ig.attach_latest(c, views.offers(spark, sf), "sku", "ship_date", {"shop": "detail_shop", "ship_date": "detail_date"}, TIES)


@query(
    "best_history_rows",
    f"""SELECT sku, l_returnflag, price, ship_date FROM offers QUALIFY row_number() OVER (PARTITION BY sku ORDER BY CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END DESC, ship_date DESC, {TIES_DESC}) = 1""",
    ["offers"],
)
def best_history_rows(spark, sf):
    return dd.best_per_key(views.offers(spark, sf), ["sku"], F.col("l_returnflag") == "N", "ship_date", TIES).select("sku", "l_returnflag", "price", "ship_date")


@query(
    "review_counts",
    """SELECT item_id, count(*) AS review_rows, count(nullif(trim(text), '')) AS review_nonempty, count(DISTINCT nullif(trim(text), '')) AS review_unique FROM reviews GROUP BY 1""",
    ["reviews"],
)
def review_counts(spark, sf):
    return ig.review_counts(views.reviews(spark, sf), "item_id", "text", "review")


def _sources(spark, sf):
    c = views.catalog(spark, sf)
    structured = c.where(~F.col("is_gift")).select(
        "sku", "brand", "category", F.when(F.col("package_type") == "", None).otherwise(F.col("weight_g")).cast("string").alias("weight_g"), "flavor", "title"
    )
    listing = views.snapshot(spark, sf).select(
        "sku", F.concat(F.lit("new "), "title").alias("title"), F.lit("").alias("brand"), F.col("category"), F.lit("77").alias("weight_g"), "price", "sales", "comments", "shop"
    )
    return listing, structured


_REC = """l AS (SELECT sku, 'new ' || title AS title, category, 77.0::DOUBLE AS weight_g, price, sales, comments, shop FROM snap_last), s AS (SELECT * FROM catalog WHERE NOT is_gift),
   r AS (SELECT coalesce(l.sku, s.sku) AS sku, coalesce(l.title, s.title) AS title, coalesce(s.brand, '') AS brand, coalesce(s.category, l.category) AS category,
     coalesce(CASE WHEN s.package_type <> '' THEN s.weight_g END, l.weight_g) AS weight_g, s.flavor, l.price, l.sales, l.comments, l.shop,
     CASE WHEN l.sku IS NULL THEN 'structured' WHEN s.sku IS NULL THEN 'merged' ELSE 'merged+structured' END AS source_flags FROM l FULL OUTER JOIN s ON l.sku = s.sku)"""


@query("reconciled_sources", f"WITH {_REC} SELECT * FROM r", ["catalog", "snap_last"])
def reconciled_sources(spark, sf):
    return ig.reconcile(*_sources(spark, sf)).withColumn("weight_g", F.col("weight_g").cast("double"))


@query(
    "integrated_catalog",
    f"""WITH {_REC}, n AS (SELECT sku, count(*) AS negative_rows, count(promotion) FILTER (promotion <> '') AS negative_nonempty, count(DISTINCT nullif(promotion, '')) AS negative_unique FROM offers WHERE l_returnflag = 'R' GROUP BY 1),
        h AS (SELECT sku, price AS history_low, CASE WHEN l_returnflag = 'N' THEN 'success' ELSE 'error' END AS history_status FROM offers
              QUALIFY row_number() OVER (PARTITION BY sku ORDER BY CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END DESC, ship_date DESC, {TIES_DESC}) = 1)
        SELECT sku, r.title, CASE WHEN brand = '' THEN '未知品牌' ELSE brand END AS brand, category, weight_g, price, coalesce(sales, 0.0) AS sales, coalesce(comments, 0.0) AS comments,
          {rnd('price / weight_g', 6)} AS unit_price, source_flags, negative_rows, negative_nonempty, negative_unique, history_low, history_status
        FROM r LEFT JOIN n USING (sku) LEFT JOIN h USING (sku)""",
    ["catalog", "snap_last", "offers"],
)
def integrated_catalog(spark, sf):
    o = views.offers(spark, sf)
    negatives = o.where(F.col("l_returnflag") == "R").select("sku", F.col("promotion").alias("content"))
    status = F.when(F.col("l_returnflag") == "N", "success").otherwise("error")
    history = dd.best_per_key(o, ["sku"], F.col("l_returnflag") == "N", "ship_date", TIES).select(
        "sku", F.col("price").alias("current_price"), F.col("price").alias("lowest_price"), F.col("price").alias("highest_price"), F.lit("[]").alias("price_trend"),
        status.alias("status"), F.col("ship_date").alias("query_time"),
    )
    out = ig.integrate(*_sources(spark, sf), negatives=negatives, price_history=history)
    return rounded(out, "unit_price", digits=6).select(
        "sku", "title", "brand", "category", "weight_g", "price", "sales", "comments", "unit_price", "source_flags", "negative_rows", "negative_nonempty", "negative_unique", "history_low", "history_status"
    )


# --- quality ------------------------------------------------------------------
@query(
    "column_coverage",
    f"""SELECT * FROM (SELECT unnest([{{'column': 'title', 'nonempty': count(nullif(title, '')), 'coverage': {rnd("count(nullif(title, '')) / count(*)")}}},
        {{'column': 'package_type', 'nonempty': count(nullif(package_type, '')), 'coverage': {rnd("count(nullif(package_type, '')) / count(*)")}}},
        {{'column': 'promotion', 'nonempty': count(nullif(promotion, '')), 'coverage': {rnd("count(nullif(promotion, '')) / count(*)")}}}], recursive := true) FROM offers_p)""".replace("offers_p", "(SELECT c.*, o.promotion AS p2 FROM offers o JOIN catalog c USING (sku))"),
    ["catalog", "offers"],
)
def column_coverage(spark, sf):
    df = views.offers(spark, sf).select("sku").join(views.catalog(spark, sf), "sku")
    return rounded(ql.coverage(df, ["title", "package_type", "promotion"]), "coverage")


@query(
    "quality_report",
    f"""WITH q AS (SELECT *, price > 500 AS dear FROM catalog), d AS (SELECT count(*) - count(DISTINCT (title, price, weight_g)) AS x FROM q)
        SELECT section, metric, {rnd('CAST(value AS DOUBLE)')} AS value FROM (
        SELECT 'totals' AS section, 'rows' AS metric, count(*) AS value FROM q UNION ALL SELECT 'totals', 'distinct_sku', count(DISTINCT sku) FROM q UNION ALL SELECT 'totals', 'duplicate_sku', count(sku) - count(DISTINCT sku) FROM q
        UNION ALL SELECT 'coverage', 'title', count(nullif(title, '')) / count(*) FROM q UNION ALL SELECT 'coverage', 'package_type', count(nullif(package_type, '')) / count(*) FROM q
        UNION ALL SELECT 'flags', 'missing_sku', 0 UNION ALL SELECT 'flags', 'missing_title', 0 UNION ALL SELECT 'flags', 'missing_category', 0 UNION ALL SELECT 'flags', 'invalid_price', 0
        UNION ALL SELECT 'flags', 'invalid_weight', 0 UNION ALL SELECT 'flags', 'price_over_1000', count(*) FILTER (price > 1000) FROM q UNION ALL SELECT 'flags', 'weight_over_10kg', count(*) FILTER (weight_g > 10000) FROM q
        UNION ALL SELECT 'flags', 'duplicate_title_price_weight', x FROM d UNION ALL SELECT 'status', package_type, count(*) FROM q WHERE package_type <> '' GROUP BY package_type)""",
    ["catalog"],
)
def quality_report(spark, sf):
    return rounded(ql.quality_report(views.catalog(spark, sf), ["title", "package_type"], status="package_type"), "value")


@query("duplicate_products", "SELECT CAST(count(*) - count(DISTINCT (title, weight_g)) AS BIGINT) AS duplicates FROM catalog", ["catalog"])
def duplicate_products(spark, sf):
    return dd.duplicate_count(views.catalog(spark, sf), ["title", "weight_g"])


@query(
    "distinct_products",
    "SELECT title, price, weight_g, min(sku) AS sku FROM catalog GROUP BY 1, 2, 3",
    ["catalog"],
)
def distinct_products(spark, sf):
    return dd.distinct_products(views.catalog(spark, sf), ["title", "price", "weight_g"], [F.col("sku").asc()]).select("title", "price", "weight_g", "sku")


@query(
    "input_freshness",
    """SELECT 'offers' AS "table", max(l_shipdate)::DATE AS newest, date_diff('day', max(l_shipdate)::DATE, DATE '2024-02-01') AS days_ago FROM lineitem
       UNION ALL SELECT 'feed', max(ts)::DATE, date_diff('day', max(ts)::DATE, DATE '2024-02-01') FROM events UNION ALL SELECT 'orders', max(o_orderdate)::DATE, date_diff('day', max(o_orderdate)::DATE, DATE '2024-02-01') FROM orders""",
)
def input_freshness(spark, sf):
    t = {"offers": (views.table(spark, sf, "lineitem"), "l_shipdate"), "feed": (views.table(spark, sf, "events"), "ts"), "orders": (views.table(spark, sf, "orders"), "o_orderdate")}
    return ql.freshness(t, "2024-02-01")


@query(
    "feed_status_counts",
    f"SELECT status, count(*) AS n, {rnd('count(*) / (SELECT count(*) FROM feed)')} AS share FROM feed GROUP BY 1",
    ["feed"],
)
def feed_status_counts(spark, sf):
    return rounded(ql.status_counts(views.feed(spark, sf)), "share")


_FM = """SELECT CAST(ts AS DATE) AS day, count(*) AS rows, count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status = 'success') / count(*) AS success_ratio,
   count(*) FILTER (status = 'error') / count(*) AS error_ratio, count(*) FILTER (status = 'no_result') / count(*) AS no_result_ratio, count(*) FILTER (status = 'access_blocked') / count(*) AS blocked_ratio,
   count(*) FILTER (status = 'success' AND value > 0) / nullif(count(*) FILTER (status = 'success'), 0) AS low_price_ratio FROM feed GROUP BY 1"""


@query(
    "feed_metrics_daily",
    f"SELECT day, rows, success_count, {', '.join(rnd(c) + ' AS ' + c for c in ('success_ratio', 'error_ratio', 'no_result_ratio', 'blocked_ratio', 'low_price_ratio'))} FROM ({_FM})",
    ["feed"],
)
def feed_metrics_daily(spark, sf):
    f = views.feed(spark, sf).withColumn("day", F.to_date("ts"))
    return rounded(ql.feed_metrics(f, ["day"]), "success_ratio", "error_ratio", "no_result_ratio", "blocked_ratio", "low_price_ratio")


@query(
    "feed_alerts_daily",
    f"""SELECT day, 'blocked_ratio' AS metric, {rnd('blocked_ratio')} AS value, 0.2::DOUBLE AS threshold FROM ({_FM}) WHERE blocked_ratio > 0.2
        UNION ALL SELECT day, 'error_ratio', {rnd('error_ratio')}, 0.2::DOUBLE FROM ({_FM}) WHERE error_ratio > 0.2 UNION ALL SELECT day, 'low_price_ratio', {rnd('low_price_ratio')}, 0.8::DOUBLE FROM ({_FM}) WHERE low_price_ratio < 0.8
        UNION ALL SELECT day, 'success_count', success_count, 0.0::DOUBLE FROM ({_FM}) WHERE success_count <= 0""",
    ["feed"],
)
def feed_alerts_daily(spark, sf):
    f = views.feed(spark, sf).withColumn("day", F.to_date("ts"))
    return rounded(ql.alerts(ql.feed_metrics(f, ["day"]), ["day"]).drop("message"), "value")


@query(
    "quota_windows",
    """SELECT scope, window_start, count(*) AS n, greatest(50 - count(*), 0) AS remaining FROM (SELECT CASE WHEN hour(ts) >= 23 OR hour(ts) < 6 THEN 'night_window' ELSE 'calendar_day' END AS scope,
         CASE WHEN hour(ts) >= 23 THEN date_trunc('day', ts) + INTERVAL 23 HOUR WHEN hour(ts) < 6 THEN date_trunc('day', ts) - INTERVAL 1 HOUR ELSE date_trunc('day', ts) END AS window_start FROM feed) GROUP BY 1, 2""",
    ["feed"],
)
def quota_windows(spark, sf):
    return tg.quota_usage(views.feed(spark, sf), "ts", 50).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "pending_items",
    """WITH f AS (SELECT *, item_id || '@' || CAST(ts AS DATE) AS task FROM feed)
       SELECT task, count(*) AS n FROM f WHERE task NOT IN (SELECT task FROM f WHERE (status = 'success' AND cards > 0) OR status = 'access_blocked') GROUP BY 1""",
    ["feed"],
)
def pending_items(spark, sf):
    """A task is an item on a day."""
    f = views.feed(spark, sf).withColumn("task", F.concat(F.col("item_id").cast("string"), F.lit("@"), F.to_date("ts").cast("string")))
    tasks = f.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    return tg.pending(tasks, tg.done_rows(f), "task")


_POOL = """pool AS (SELECT sku, category, price, comments FROM (SELECT *, rank() OVER (PARTITION BY category ORDER BY comments DESC) AS r FROM catalog) WHERE r <= 3 OR comments > (SELECT avg(comments) * 1.3 FROM catalog)
   OR price < (SELECT quantile_cont(price, 0.2) FROM catalog) OR price > (SELECT quantile_cont(price, 0.8) FROM catalog))"""


@query("priority_pool", f"WITH {_POOL} SELECT * FROM pool", ["catalog"])
def priority_pool(spark, sf):
    return tg.priority_pool(stage(views.catalog(spark, sf)), top=3, factor=1.3).select("sku", "category", "price", "comments")


@query(
    "next_crawl_batch",
    f"WITH {_POOL} SELECT sku, comments FROM pool WHERE sku NOT IN (SELECT sku FROM offers WHERE ship_date >= DATE '2001-06-01' AND l_returnflag = 'N') ORDER BY comments DESC, sku LIMIT 80",
    ["catalog", "offers"],
)
def next_crawl_batch(spark, sf):
    done = views.offers(spark, sf).where((F.col("ship_date") >= "2001-06-01") & (F.col("l_returnflag") == "N"))
    pool = tg.priority_pool(stage(views.catalog(spark, sf)), top=3, factor=1.3).select("sku", "comments")
    return tg.next_batch(pool, done, "sku", [F.col("comments").desc(), F.col("sku").asc()], 80)


@query(
    "layer_audit",
    f"""SELECT layer, metric, {rnd('CAST(value AS DOUBLE)')} AS value FROM (
        SELECT 'L0' AS layer, 'sku' AS metric, count(*) AS value FROM catalog UNION ALL SELECT 'L0', 'brands', count(DISTINCT brand) FROM catalog UNION ALL SELECT 'L0', 'categories', count(DISTINCT category) FROM catalog
        UNION ALL SELECT 'L1', 'title', 1 UNION ALL SELECT 'L1', 'brand', 1 UNION ALL SELECT 'L1', 'category', 1 UNION ALL SELECT 'L1', 'price', 1 UNION ALL SELECT 'L2', 'weight_g', 1 UNION ALL SELECT 'L2', 'unit_price', 1
        UNION ALL SELECT 'L3', 'reviews', count(*) FROM reviews UNION ALL SELECT 'L3', 'negatives', count(*) FILTER (negative) FROM reviews UNION ALL SELECT 'L4', status, count(*) FROM feed GROUP BY status
        UNION ALL SELECT 'L5', 'rows', count(DISTINCT (sku, year(ship_date))) FROM offers UNION ALL SELECT 'L5', 'snapshots', count(DISTINCT year(ship_date)) FROM offers)""",
    ["catalog", "reviews", "feed", "offers"],
)
def layer_audit(spark, sf):
    r = views.reviews(spark, sf)
    return rounded(ql.layer_audit(views.catalog(spark, sf), r, r.where("negative"), views.feed(spark, sf), yearly(spark, sf)), "value")


def _decisions(spark, sf):
    o = views.table(spark, sf, "orders")
    action = F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("added")
    return o.select(F.col("o_custkey").alias("decision_id"), F.col("o_orderdate").alias("event_time"), action.alias("action"), F.col("o_orderpriority").alias("scene"), "o_orderkey")


_DEC = """d AS (SELECT o_custkey AS decision_id, min(o_orderdate) AS event_time, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS reviewed_at,
   arg_min(o_orderpriority, row(o_orderdate, o_orderkey)) AS scene FROM orders GROUP BY 1),
   e AS (SELECT decision_id, scene, CAST(event_time AS DATE) + 90 AS review_date, reviewed_at IS NOT NULL AS reviewed FROM d)"""


@query("decision_states", f"WITH {_DEC} SELECT decision_id, scene, CAST(review_date AS DATE) AS review_date, reviewed FROM e")
def decision_states(spark, sf):
    return ql.fold_decisions(_decisions(spark, sf), ties=["o_orderkey"]).select("decision_id", "scene", "review_date", "reviewed")


@query("decision_stats", f"WITH {_DEC} SELECT count(*) AS total, count(*) FILTER (NOT reviewed AND review_date <= DATE '1996-01-01') AS due, count(*) FILTER (reviewed) AS reviewed FROM e")
def decision_stats(spark, sf):
    return ql.decision_stats(ql.fold_decisions(_decisions(spark, sf), ties=["o_orderkey"]), "1996-01-01")


@query("due_decisions", f"WITH {_DEC} SELECT decision_id, scene FROM e WHERE NOT reviewed AND review_date <= DATE '1998-01-01'")
def due_decisions(spark, sf):
    return ql.due_decisions(ql.fold_decisions(_decisions(spark, sf), ties=["o_orderkey"]), "1998-01-01").select("decision_id", "scene")


@query("publication_order", "SELECT sku, category, sales, comments, unit_price IS NOT NULL AS priced_by_weight FROM catalog", ["catalog"])
def publication_order(spark, sf):
    ordered = views.catalog(spark, sf).orderBy(*ig.publication_order())
    return ordered.select("sku", "category", "sales", "comments", F.col("unit_price").isNotNull().alias("priced_by_weight"))
