"""Two-source reconciliation, supplement joins, final derivations of the unified catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.functions import urls, words
from shelfwise.functions.weight import weight_multi
from shelfwise.operators.dedupe import best_per_key, latest_per_key


def key_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def attach_counts(products: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per key onto products, 0 where there are none."""
    return products.drop(name).join(key_counts(rows, key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def review_counts(reviews: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """Rows, non-empty texts and distinct non-empty texts per key."""
    full = F.when(tx.nonempty(text), tx.clean_text(text))
    return reviews.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"), F.count(full).alias(f"{prefix}_nonempty"), F.countDistinct(full).alias(f"{prefix}_unique")
    )


def attach_latest(products: DataFrame, details: DataFrame, key: str, time: str, columns: Mapping[str, str], ties: Sequence[str] = ()) -> DataFrame:
    """Newest detail row per key under new column names, replacing columns of the same name."""
    newest = latest_per_key(details, [key], time, ties).select(key, *[F.col(c).alias(n) for c, n in columns.items()])
    return products.drop(*columns.values()).join(newest, key, "left")


PREFER_RIGHT = ("brand", "level1", "level2", "category", "weight_g", "flavor", "package_type", "specification", "is_gift", "keywords", "brand_match_status", "weight_match_status")


def reconcile(listing: DataFrame, structured: DataFrame, key: str = "sku", prefer_right: Sequence[str] = PREFER_RIGHT) -> DataFrame:
    """Full outer join of two product sources with per-column precedence and a source trail.

    Columns in ``prefer_right`` take the structured value unless blank, the others keep the listing value
    unless blank.
    """
    cols = [c for c in dict.fromkeys([*listing.columns, *structured.columns]) if c != key]
    a = listing.select(F.col(key).alias("_ka"), *[F.col(c).alias(f"a_{c}") for c in listing.columns if c != key])
    b = structured.select(F.col(key).alias("_kb"), *[F.col(c).alias(f"b_{c}") for c in structured.columns if c != key])
    j = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    out: list[Column] = [F.coalesce("_ka", "_kb").alias(key)]
    for c in cols:
        if c not in structured.columns:
            out.append(F.col(f"a_{c}").alias(c))
        elif c not in listing.columns:
            out.append(F.col(f"b_{c}").alias(c))
        else:
            merge = tx.merge_prefer_right if c in prefer_right else tx.merge_first
            out.append(merge(f"a_{c}", f"b_{c}").alias(c))
    flags = F.concat_ws("+", F.when(F.col("_ka").isNotNull(), "merged"), F.when(F.col("_kb").isNotNull(), "structured"))
    return j.select(*out, flags.alias("source_flags"))


def attach_supplements(products: DataFrame, key: str = "sku", details: DataFrame | None = None, reviews: DataFrame | None = None, negatives: DataFrame | None = None, checkpoint: DataFrame | None = None, price_history: DataFrame | None = None) -> DataFrame:
    """Left joins of every supplement, each reduced to one row per key before its join."""
    out = products
    if details is not None:
        out = attach_latest(out, details, key, "crawl_time", {"review_count": "detail_reviews", "good_rate": "good_rate", "specification": "detail_specification"})
        out = out.withColumn("comments", F.greatest(F.coalesce("comments", F.lit(0.0)), F.coalesce(F.col("detail_reviews").cast("double"), F.lit(0.0))))
        if "specification" in out.columns:
            out = out.withColumn("specification", tx.merge_first("specification", "detail_specification"))
    if reviews is not None:
        out = out.join(review_counts(reviews, key, "content", "review"), key, "left")
    if negatives is not None:
        out = out.join(review_counts(negatives, key, "content", "negative"), key, "left")
    if checkpoint is not None:
        out = attach_latest(out, checkpoint, key, "crawl_time", {"status": "crawl_status", "crawl_time": "checkpoint_time"})
    if price_history is not None:
        best = best_per_key(price_history, [key], F.col("status") == "success", "query_time")
        best = best.select(
            key, F.col("current_price").alias("history_current"), F.col("lowest_price").alias("history_low"), F.col("highest_price").alias("history_high"),
            F.coalesce(F.json_array_length("price_trend"), F.lit(0)).alias("trend_points"), F.col("status").alias("history_status"),
        )
        out = out.join(best, key, "left")
    return out


def finalize_products(df: DataFrame) -> DataFrame:
    """Brand, category and weight fallbacks, numeric defaults and the masked unit price."""
    brand = tx.merge_first("brand", "brand_from_name") if "brand_from_name" in df.columns else F.col("brand")
    text_weight = F.col("weight_from_text").cast("double") if "weight_from_text" in df.columns else F.lit(None).cast("double")
    out = (
        df.withColumn("brand", F.when(tx.nonempty(brand), brand).otherwise(words.UNKNOWN_BRAND))
        .withColumn("category", F.when(tx.nonempty("category"), F.col("category")).otherwise(words.UNKNOWN_CATEGORY))
        .withColumn("weight_g", F.coalesce(F.col("weight_g").cast("double"), text_weight, weight_multi("title")))
        .withColumn("sales", F.coalesce("sales", F.lit(0.0)))
        .withColumn("comments", F.coalesce("comments", F.lit(0.0)))
    )
    return out.withColumn("unit_price", tx.unit_price("price", "weight_g"))


def publication_order() -> list[Column]:
    """Sink order of the unified catalog: priced by weight first, then category, sales, reviews."""
    return [F.col("unit_price").isNotNull().desc(), F.col("category").asc(), F.col("sales").desc(), F.col("comments").desc(), F.col("sku").asc()]


def integrate(listing: DataFrame, structured: DataFrame, **supplements) -> DataFrame:
    """Reconcile, supplement and finalise: the unified catalog."""
    return finalize_products(attach_supplements(reconcile(listing, structured), **supplements))


def lookup_urls(requests: DataFrame, catalog: DataFrame, url: str = "url", key: str = "sku", columns: Sequence[str] = ("title", "price")) -> DataFrame:
    """Catalog rows of a batch of product addresses or share texts: one equi-join on the product number.

    ``source`` says how a request was answered: from the catalog, not there, or without a product number.
    """
    named = requests.withColumn("_id", urls.product_id(url))
    known = catalog.select(F.col(key).alias("_id"), *columns, F.lit(True).alias("_hit"))
    source = F.when(F.col("_hit"), "sku_matched_structured_corpus").when(F.col("_id") != "", "sku_not_in_corpus").otherwise("no_sku")
    out = named.join(known, "_id", "left")
    return out.select(*requests.columns, F.nullif(F.col("_id"), F.lit("")).alias(key), *columns, source.alias("source"))


def review_coverage(catalog: DataFrame, reviews: DataFrame, key: str = "sku") -> DataFrame:
    """Products, reviewed products, reviews, and the percentage of products with a review."""
    per_item = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    j = catalog.select(key).distinct().join(per_item, key, "left")
    return j.agg(
        F.count(F.lit(1)).alias("products"), F.count("_n").alias("reviewed"), F.coalesce(F.sum("_n"), F.lit(0)).alias("reviews"),
        F.coalesce(F.try_divide(F.count("_n") * 100, F.count(F.lit(1))), F.lit(0.0)).alias("coverage_pct"),
    )
