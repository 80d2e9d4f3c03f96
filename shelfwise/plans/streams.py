"""The streaming feeds run over the sample files until they are exhausted."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.plans.markets import rounded
from shelfwise.plans.registry import query
from shelfwise.plans.sqlviews import rnd
from shelfwise.sources import views
from shelfwise.sources.sinks import KeyedTable
from shelfwise.sources.staging import shared_folder
from shelfwise.streaming import feeds


def workdir(spark) -> str:
    """Folder for checkpoints and results: the cluster's shared folder, a temporary one only without it."""
    return f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"


def feed_stream(spark, sf):
    raw = feeds.event_time(feeds.table_stream(spark, f"{sf}/events.parquet"), "ts")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "access_blocked").when(F.col("event_type") == "view", "no_result").otherwise("success")
    return raw.select("event_id", "ts", F.col("user_id").alias("item_id"), status.alias("status"), "value")


@query(
    "stream_quota_windows",
    """WITH w AS (SELECT CASE WHEN hour(ts) >= 23 OR hour(ts) < 6 THEN 'night_window' ELSE 'calendar_day' END AS scope, date_trunc('day', ts + INTERVAL 1 HOUR) - INTERVAL 1 HOUR AS opened, count(*) AS n FROM feed GROUP BY 1, 2)
       SELECT scope, CASE WHEN scope = 'night_window' THEN opened ELSE opened + INTERVAL 1 HOUR END AS window_start, n, greatest(300 - n, 0) AS remaining FROM w WHERE opened + INTERVAL 24 HOUR <= (SELECT max(ts) FROM feed) - INTERVAL 7 HOUR""",
    ["feed"],
)
def stream_quota_windows(spark, sf):
    d = workdir(spark)
    feeds.run_available(feeds.quota_windows(feed_stream(spark, sf), "ts", 300), f"{d}/cp", f"{d}/out")
    return spark.read.parquet(f"{d}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_feed_alerts",
    f"""WITH m AS (SELECT date_trunc('day', ts) AS window_start, count(*) FILTER (status = 'access_blocked') / count(*) AS b, count(*) FILTER (status = 'error') / count(*) AS e,
            count(*) FILTER (status = 'success') AS s, count(*) FILTER (status = 'success' AND value > 0) / nullif(count(*) FILTER (status = 'success'), 0) AS p FROM feed GROUP BY 1
          HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM feed) - INTERVAL 1 HOUR)
        SELECT CAST(window_start AS TIMESTAMP) AS window_start, 'blocked_ratio' AS metric, {rnd('b')} AS value FROM m WHERE b > 0.2 UNION ALL SELECT CAST(window_start AS TIMESTAMP), 'error_ratio', {rnd('e')} FROM m WHERE e > 0.2
        UNION ALL SELECT CAST(window_start AS TIMESTAMP), 'low_price_ratio', {rnd('p')} FROM m WHERE p < 0.8 UNION ALL SELECT CAST(window_start AS TIMESTAMP), 'success_count', s FROM m WHERE s <= 0""",
    ["feed"],
)
def stream_feed_alerts(spark, sf):
    d = workdir(spark)
    feeds.run_available(feeds.feed_alerts(feed_stream(spark, sf)), f"{d}/cp", f"{d}/out")
    out = spark.read.parquet(f"{d}/out")
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "metric", "value"), "value")


@query(
    "stream_latest_status",
    "SELECT item_id, event_id, status FROM feed QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1",
    ["feed"],
)
def stream_latest_status(spark, sf):
    d = workdir(spark)
    t = KeyedTable(spark, f"{d}/table", ["item_id"], ["ts", "event_id"])
    feeds.run_available(feed_stream(spark, sf), f"{d}/cp", each=feeds.upsert_into(t))
    return t.read().select("item_id", "event_id", "status")


@query(
    "stream_distinct_reviews",
    "SELECT DISTINCT source AS item_id, sha256(text) AS review_key FROM documents",
)
def stream_distinct_reviews(spark, sf):
    d = workdir(spark)
    docs = feeds.table_stream(spark, f"{sf}/documents.parquet").select(F.col("source").alias("item_id"), "text", F.timestamp_seconds(F.col("doc_id") + 1_000_000_000).alias("ts"))
    seen = KeyedTable(spark, f"{d}/seen", ["item_id", "review_key"])
    feeds.run_available(docs, f"{d}/cp", each=feeds.distinct_ever(seen, f"{d}/out", "text", "ts"))
    return spark.read.parquet(f"{d}/out").select("item_id", "review_key")


@query(
    "stream_price_changes",
    f"""WITH o AS (SELECT sku, arg_max(price, row(ship_date, l_orderkey, price)) AS p FROM offers WHERE year(ship_date) = (SELECT min(year(ship_date)) FROM offers) GROUP BY 1), n AS (SELECT sku, arg_max(price, row(ship_date, l_orderkey, price)) AS p FROM offers WHERE year(ship_date) > (SELECT min(year(ship_date)) FROM offers) GROUP BY 1)
        SELECT sku, CASE WHEN n.p > o.p THEN 'up' ELSE 'down' END AS change_type, {rnd('n.p - o.p')} AS change_amount FROM o JOIN n USING (sku) WHERE abs(n.p - o.p) > 1e-4""",
    ["offers"],
)
def stream_price_changes(spark, sf):
    d = workdir(spark)
    order = ["ship_date", "l_orderkey", "price"]
    t = KeyedTable(spark, f"{d}/table", ["sku"], order)
    first = views.offers(spark, sf).agg(F.min(F.year("ship_date"))).first()[0]
    base = views.offers(spark, sf).where(F.year("ship_date") == first).select("sku", "price", "ship_date", "l_orderkey", F.lit(0.0).alias("comments"), F.lit("").alias("sales_text"))
    t.upsert(base)
    li = feeds.table_stream(spark, f"{sf}/lineitem.parquet").where(F.year("l_shipdate") > first)
    new = li.select(
        F.col("l_partkey").cast("string").alias("sku"), views.cents(F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("price"), F.to_date("l_shipdate").alias("ship_date"), "l_orderkey",
        F.lit(0.0).alias("comments"), F.lit("").alias("sales_text"),
    )
    feeds.run_available(new, f"{d}/cp", each=feeds.capture_changes(t, f"{d}/log", "sku", order, texts=()))
    return rounded(spark.read.parquet(f"{d}/log").select("sku", "change_type", "change_amount"), "change_amount")
