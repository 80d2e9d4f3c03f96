"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from shelfwise.plans import registry
from shelfwise.session import local_session

HEADLINE = [
    "category_baseline", "category_summary", "brand_concentration", "promotion_effect", "opportunity_scores_balanced", "store_type_summary", "market_kpis", "band_cross_table",
    "competition_index", "price_gap_report", "price_percent_ranks", "value_scores", "selection_top3", "similar_products", "store_price_extremes", "offer_price_quantiles",
    "prepared_listing", "snapshot_merge", "change_log", "integrated_catalog", "quality_report", "brands_from_titles", "structured_titles", "review_reason_counts", "question_parameters",
    "rolling_lows", "as_of_prices", "rank_products", "feed_metrics_daily", "distinct_reviews",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    for t in ("lineitem", "part", "documents", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
