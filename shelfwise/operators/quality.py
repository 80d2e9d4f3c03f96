"""Coverage, quality reports, feed health and alerts, freshness, layer audit, decision log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.functions import words
from shelfwise.operators.dedupe import duplicate_count, keep_one


def metric_rows(wide: DataFrame, section: str) -> DataFrame:
    """One wide aggregate row to ``(section, metric, value)`` rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns])
    return wide.select(F.lit(section).alias("section"), F.inline(cells))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-empty count and share per column, one scan."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(tx.nonempty(c)).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nonempty"), F.try_divide(F.col(c), F.col("_n")).alias("coverage")) for c in columns])
    return wide.select(F.inline(cells))


QUALITY_FLAGS = {
    "missing_sku": lambda: ~tx.nonempty("sku"),
    "missing_title": lambda: ~tx.nonempty("title"),
    "missing_category": lambda: F.coalesce(F.col("category"), F.lit("")).isin("", words.UNKNOWN_CATEGORY),
    "invalid_price": lambda: F.col("price").isNull() | (F.col("price") <= 0),
    "invalid_weight": lambda: F.col("weight_g").isNull() | (F.col("weight_g") <= 0),
    "price_over_1000": lambda: F.col("price") > 1000,
    "weight_over_10kg": lambda: F.col("weight_g") > 10000,
}


def quality_report(df: DataFrame, columns: Sequence[str] = ("title", "brand", "category", "price", "weight_g", "unit_price", "flavor", "package_type"), status: str | None = None) -> DataFrame:
    """Rows, distinct keys, duplicates, coverage, flags and status counts as ``(section, metric, value)``."""
    totals = metric_rows(df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("sku").alias("distinct_sku")), "totals")
    dup_sku = metric_rows(duplicate_count(df.where(F.col("sku").isNotNull()), ["sku"], "duplicate_sku"), "totals")
    cov = coverage(df, columns).select(F.lit("coverage").alias("section"), F.col("column").alias("metric"), F.col("coverage").alias("value"))
    flags = metric_rows(df.agg(*[F.count_if(c()).alias(n) for n, c in QUALITY_FLAGS.items()]), "flags")
    dup = metric_rows(duplicate_count(df, ["title", "price", "weight_g"], "duplicate_title_price_weight"), "flags")
    out = totals.unionByName(dup_sku).unionByName(cov).unionByName(flags).unionByName(dup)
    if status:
        counts = df.where(tx.nonempty(status)).groupBy(status).agg(F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(counts.select(F.lit("status").alias("section"), F.col(status).alias("metric"), "value"))
    return out


# --- feeds --------------------------------------------------------------------
def text_uniqueness(df: DataFrame, column: str) -> DataFrame:
    """Non-empty, unique and duplicate ratio of a text column, one row. Texts are grouped first, then counted."""
    groups = df.where(tx.nonempty(column)).groupBy(tx.strip(column).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("nonempty"), F.count(F.lit(1)).alias("unique")).withColumn(
        "duplicate_ratio", 1 - F.try_divide(F.col("unique"), F.col("nonempty"))
    )


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


# (metric, comparison, threshold, message)
FEED_RULES = [
    ("blocked_ratio", ">", 0.2, "access blocked above 20 %, pause or slow down"),
    ("error_ratio", ">", 0.2, "error rate above 20 %, do not enlarge batches"),
    ("full_score_ratio", ">", 0.8, "share of 100 % good rates suspiciously high, check the detail parser"),
    ("low_price_ratio", "<", 0.8, "lowest price missing from successful rows, check the page parser"),
    ("success_count", "<=", 0.0, "no successful row, the source may ask for verification"),
    ("negative_rows", "<=", 0.0, "no negative review, check the review filter"),
]


def feed_metrics(feed: DataFrame, keys: Sequence[str] = (), status: str = "status", price: str = "value") -> DataFrame:
    """Counts and ratios of a feed, in one row per group."""
    n = F.count(F.lit(1))
    ok = F.count_if(F.col(status) == "success")
    return feed.groupBy(*keys).agg(
        n.alias("rows"),
        ok.alias("success_count"),
        (ok / n).alias("success_ratio"),
        (F.count_if(F.col(status) == "error") / n).alias("error_ratio"),
        (F.count_if(F.col(status) == "no_result") / n).alias("no_result_ratio"),
        (F.count_if(F.col(status) == "access_blocked") / n).alias("blocked_ratio"),
        F.try_divide(F.count_if((F.col(status) == "success") & (F.col(price) > 0)), ok).alias("low_price_ratio"),
    )


def alerts(metrics: DataFrame, keys: Sequence[str] = (), rules=tuple(FEED_RULES)) -> DataFrame:
    """Rules that fire, as rows; rules over absent metrics are skipped."""
    fired = []
    for metric, op, limit, message in rules:
        if metric not in metrics.columns:
            continue
        c = F.col(metric).cast("double")
        hit = {">": c > limit, "<": c < limit, "<=": c <= limit}[op]
        fired.append(F.when(hit, F.struct(F.lit(metric).alias("metric"), c.alias("value"), F.lit(limit).alias("threshold"), F.lit(message).alias("message"))))
    return metrics.select(*keys, F.inline(F.array_compact(F.array(*fired))))


def freshness(tables: Mapping[str, tuple[DataFrame, str]], as_of: str) -> DataFrame:
    """Newest record per table and its age in days."""
    out = None
    for name, (df, time) in tables.items():
        row = df.agg(F.max(F.to_date(time)).alias("newest")).select(F.lit(name).alias("table"), "newest")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("days_ago", F.datediff(F.lit(as_of).cast("date"), "newest"))


def structure_quality(df: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Match rates in one row, and the most frequent notes of failing rows."""
    ok = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*words.OK_STATUSES)
    b, w = ok("brand_match_status"), ok("weight_match_status")
    rates = df.agg(F.count(F.lit(1)).alias("n"), F.avg(b.cast("double")).alias("brand_rate"), F.avg(w.cast("double")).alias("weight_rate"))
    note = F.when(F.coalesce(F.col("extraction_notes"), F.lit("")) == "", "无备注").otherwise(F.col("extraction_notes"))
    patterns = df.where(~b | ~w).groupBy(note.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return rates, patterns.orderBy(F.col("n").desc(), F.col("pattern").asc()).limit(k)


def failed_rows(df: DataFrame) -> DataFrame:
    ok = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*words.OK_STATUSES)
    return df.where(~ok("brand_match_status") | ~ok("weight_match_status"))


def layer_audit(catalog: DataFrame, reviews: DataFrame, negatives: DataFrame, feed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Progress of the data layers L0-L5 as ``(layer, metric, value)``."""
    l0 = metric_rows(catalog.agg(F.count(F.lit(1)).alias("sku"), F.countDistinct("brand").alias("brands"), F.countDistinct("category").alias("categories")), "L0")
    cov = coverage(catalog, ["title", "brand", "category", "price"]).select(F.lit("L1").alias("section"), F.col("column").alias("metric"), F.col("coverage").alias("value"))
    l2 = coverage(catalog, ["weight_g", "unit_price"]).select(F.lit("L2").alias("section"), F.col("column").alias("metric"), F.col("coverage").alias("value"))
    l3 = metric_rows(reviews.agg(F.count(F.lit(1)).alias("reviews")), "L3").unionByName(metric_rows(negatives.agg(F.count(F.lit(1)).alias("negatives")), "L3"))
    l4 = feed.groupBy("status").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("L4").alias("section"), F.col("status").alias("metric"), "value")
    l5 = metric_rows(snapshots.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("snapshot_date").alias("snapshots")), "L5")
    return l0.unionByName(cov).unionByName(l2).unionByName(l3).unionByName(l4).unionByName(l5).withColumnRenamed("section", "layer")


# --- decisions ----------------------------------------------------------------
def fold_decisions(log: DataFrame, key: str = "decision_id", time: str = "event_time", ties: Sequence[str] = (), days: int = 90) -> DataFrame:
    """Current state of every decision out of its append-only events.

    The decision keeps its first time and scene, its newest outcome, and is due ``days`` after it was made.
    """
    first = keep_one(log, [key], [F.col(time).asc(), *[F.col(t).asc() for t in ties]])
    last = log.groupBy(key).agg(F.max(F.when(F.col("action") == "reviewed", F.col(time))).alias("reviewed_at"))
    out = first.join(last, key)
    return out.withColumn("review_date", F.date_add(F.to_date(time), days)).withColumn("reviewed", F.col("reviewed_at").isNotNull())


def decision_stats(decisions: DataFrame, as_of: str) -> DataFrame:
    due = ~F.col("reviewed") & (F.col("review_date") <= F.lit(as_of).cast("date"))
    return decisions.agg(F.count(F.lit(1)).alias("total"), F.count_if(due).alias("due"), F.count_if(F.col("reviewed")).alias("reviewed"))


def due_decisions(decisions: DataFrame, as_of: str) -> DataFrame:
    return decisions.where(~F.col("reviewed") & (F.col("review_date") <= F.lit(as_of).cast("date")))


def findings(metrics: DataFrame, source: str, thin: float = 0.10, coverage: Column | None = None) -> DataFrame:
    """Metric rows as findings with their source and a caveat where coverage is thin."""
    caveat = F.when((coverage if coverage is not None else F.col("value")) < thin, F.lit("thin coverage")).otherwise("")
    return metrics.select("section", "metric", "value", F.lit(source).alias("source"), caveat.alias("caveat"))
