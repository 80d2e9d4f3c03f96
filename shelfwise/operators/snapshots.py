"""Listing preparation, snapshot merge, change capture, coverage and day-to-day deltas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.operators.dedupe import keep_one, priority_union
from shelfwise.sources.readers import conform

LISTING_SPEC = {
    "item_id": {"aliases": ["sku", "product_id"], "required": True},
    "title": {"default": ""},
    "price": {"default": ""},
    "original_price": {"default": ""},
    "promotion_tag": {"default": ""},
    "review_count": {"default": ""},
    "sales_text": {"default": ""},
    "shop_name": {"default": ""},
    "category_breadcrumb": {"aliases": ["category_path"], "default": ""},
    "detail_url": {"default": ""},
    "listing_time": {"default": ""},
    "crawl_time": {"default": ""},
}


def prepare_listing(raw: DataFrame, ties: Sequence[str] = (), mode: str = "reference") -> DataFrame:
    """Raw crawl rows to one clean row per product.

    Best selling row first, then the newest; ``ties`` name further columns that make the choice total.
    """
    spec = {**LISTING_SPEC, **{t: {"type": dict(raw.dtypes)[t]} for t in ties}}
    df = conform(raw, spec).withColumn("_s", tx.sales_range("sales_text", mode))
    df = df.select(
        tx.normalize_key("item_id", url="detail_url").alias("product_id"),
        tx.clean_text("title").alias("product_title"),
        tx.first_number("price").alias("current_price"),
        tx.first_number("original_price").alias("original_price"),
        F.array_join(tx.promo_tokens("promotion_tag"), "|").alias("promotion_tags"),
        "review_count",
        F.col("sales_text").alias("sales_text_raw"),
        F.col("_s.lower").alias("sales_lower"),
        F.col("_s.upper").alias("sales_upper"),
        F.col("_s.confidence").alias("sales_confidence"),
        F.coalesce("_s.lower", F.lit(0.0)).alias("sales_sort"),
        tx.clean_text("shop_name").alias("shop_name"),
        F.col("category_breadcrumb").alias("category_path"),
        "detail_url",
        F.col("listing_time").alias("listing_date"),
        F.try_to_timestamp("crawl_time").alias("crawl_timestamp"),
        *[F.col(t).alias(f"_t_{t}") for t in ties],
    ).where(F.col("product_id") != "")
    order = [F.col("sales_sort").desc(), F.col("crawl_timestamp").desc_nulls_last(), *[F.col(f"_t_{t}").desc_nulls_last() for t in ties]]
    return keep_one(df, ["product_id"], order).drop(*[f"_t_{t}" for t in ties])


def append_existing(cleaned: DataFrame, existing: DataFrame) -> DataFrame:
    """Cleaned rows on top of an earlier cleaned table, best selling row per product kept, new before old."""
    both = cleaned.withColumn("_side", F.lit(0)).unionByName(existing.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, ["product_id"], [F.col("sales_sort").desc_nulls_last(), F.col("_side").asc()]).drop("_side")


def historical_to_unified(df: DataFrame, source: str = "historical_dataset") -> DataFrame:
    """Long-kept product table in the layout of a cleaned listing."""
    s = tx.sales_range("sales_text")
    return df.select(
        tx.normalize_key("sku").alias("product_id"),
        F.col("title").alias("product_title"),
        tx.first_number("price").alias("current_price"),
        tx.first_number("original_price").alias("original_price"),
        F.array_join(tx.promo_tokens("promotion"), "|").alias("promotion_tags"),
        F.col("comments").cast("string").alias("review_count"),
        F.col("sales_text").alias("sales_text_raw"),
        s["lower"].alias("sales_lower"),
        s["upper"].alias("sales_upper"),
        s["confidence"].alias("sales_confidence"),
        F.coalesce(s["lower"], F.lit(0.0)).alias("sales_sort"),
        F.col("shop").alias("shop_name"),
        F.concat_ws(" > ", "level1", "level2", "category").alias("category_path"),
        F.lit(source).alias("source_type"),
    )


def with_history(cleaned: DataFrame, historical: DataFrame) -> DataFrame:
    """New crawl over history: a product of the new crawl replaces its historical row."""
    new = cleaned.withColumn("is_new_crawl", F.lit(True))
    old = historical.withColumn("is_new_crawl", F.lit(False))
    return priority_union([new, old], ["product_id"], [F.col("sales_sort").desc_nulls_last()])


# --- merge --------------------------------------------------------------------
def _changed(old: Column, new: Column) -> Column:
    """A non-blank new value that differs; blank new values never count."""
    return tx.nonempty(new) & (old.isNull() | (tx.strip(old.cast("string")) != tx.strip(new.cast("string"))))


def merge_snapshots(old: DataFrame, new: DataFrame, key: str = "sku", texts: Sequence[str] = ("title", "shop", "promotion"), price: str = "price", original: str = "original_price", reviews: str = "comments", sales: str = "sales_text", tolerance: float = 1e-4) -> DataFrame:
    """Full outer merge of two snapshots with one row per key.

    Texts take a changed non-blank value, the price a change above ``tolerance``, reviews only growth,
    and each keeps its previous value in ``*_history``.  ``state`` is matched, new or not_seen.
    """
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    j = o.join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")
    has_o, has_n = F.col(f"o_{key}").isNotNull(), F.col(f"n_{key}").isNotNull()
    both = has_o & has_n
    state = F.when(both, "matched").when(has_n, "new").otherwise("not_seen")

    def pick(c: str, take_new: Column) -> list[Column]:
        ov, nv = F.col(f"o_{c}"), F.col(f"n_{c}")
        moved = both & F.coalesce(take_new, F.lit(False))
        return [F.when(~has_o | moved, nv).otherwise(ov).alias(c), F.when(moved, ov).alias(f"{c}_history")]

    out = [F.coalesce(f"o_{key}", f"n_{key}").alias(key)]
    handled = {key, price, original, reviews, sales, *texts}
    for c in texts:
        out += pick(c, _changed(F.col(f"o_{c}"), F.col(f"n_{c}")))
    op, np_ = F.col(f"o_{price}"), F.col(f"n_{price}")
    price_moved = F.abs(np_ - op) > tolerance
    out += [
        F.when(~has_o | price_moved | op.isNull(), F.coalesce(np_, op)).otherwise(op).alias(price),
        F.when(both & price_moved, op).alias(f"{price}_history"),
        F.coalesce(both & price_moved, F.lit(False)).alias("price_changed"),
        F.coalesce(f"n_{original}", f"o_{original}").alias(original),
    ]
    out += pick(reviews, F.coalesce(F.col(f"n_{reviews}"), F.lit(0.0)) > F.coalesce(F.col(f"o_{reviews}"), F.lit(0.0)))
    out.append(F.when(both, F.greatest(F.coalesce(f"n_{reviews}", F.lit(0.0)) - F.coalesce(f"o_{reviews}", F.lit(0.0)), F.lit(0.0))).alias("review_growth"))
    out += pick(sales, _changed(F.col(f"o_{sales}"), F.col(f"n_{sales}")))
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in handled]
    for c in rest:
        sides = ([f"n_{c}"] if c in new.columns else []) + ([f"o_{c}"] if c in old.columns else [])
        out.append(F.coalesce(*[F.col(s) for s in sides]).alias(c))
    return j.select(*out, state.alias("state"), (state == "new").alias("is_new_product"), (state == "not_seen").alias("not_crawled_this_round"))


def change_log(old: DataFrame, new: DataFrame, key: str = "sku", texts: Sequence[str] = ("title", "shop", "promotion"), price: str = "price", reviews: str = "comments", sales: str = "sales_text", tolerance: float = 1e-4) -> DataFrame:
    """One row per changed field of the products in both snapshots."""
    cols = [*texts, price, reviews, sales]
    o = old.select(F.col(key), *[F.col(c).alias(f"o_{c}") for c in cols])
    n = new.select(F.col(key), *[F.col(c).alias(f"n_{c}") for c in cols])
    j = o.join(n, key)

    def entry(field: str, old_v: Column, new_v: Column, kind: Column, amount: Column) -> Column:
        return F.struct(
            F.lit(field).alias("field"), old_v.cast("string").alias("old_value"), new_v.cast("string").alias("new_value"),
            kind.alias("change_type"), amount.cast("double").alias("change_amount"),
        )

    none = F.lit(None)
    entries = [F.when(_changed(F.col(f"o_{c}"), F.col(f"n_{c}")), entry(c, F.col(f"o_{c}"), F.col(f"n_{c}"), F.lit("updated"), none)) for c in texts]
    op, np_ = F.col(f"o_{price}"), F.col(f"n_{price}")
    entries.append(F.when(F.abs(np_ - op) > tolerance, entry("price", op, np_, F.when(np_ > op, "up").otherwise("down"), np_ - op)))
    orv, nrv = F.coalesce(f"o_{reviews}", F.lit(0.0)), F.coalesce(f"n_{reviews}", F.lit(0.0))
    entries.append(F.when(nrv > orv, entry("reviews", orv, nrv, F.lit("growth"), nrv - orv)))
    entries.append(F.when(_changed(F.col(f"o_{sales}"), F.col(f"n_{sales}")), entry("sales_text", F.col(f"o_{sales}"), F.col(f"n_{sales}"), F.lit("updated"), none)))
    out = j.select(key, F.inline(F.array_compact(F.array(*entries))))
    return out.withColumn("change_desc", tx.change_text("field", "old_value", "new_value", "change_type", "change_amount"))


def coverage(old: DataFrame, new: DataFrame, key: str = "sku") -> DataFrame:
    """Matched, new-only and not-seen key counts with their shares, one row."""
    o = old.select(key).where(F.col(key) != "").distinct().withColumn("_o", F.lit(1))
    n = new.select(key).where(F.col(key) != "").distinct().withColumn("_n", F.lit(1))
    j = o.join(n, key, "full_outer")
    total = F.count(F.lit(1))
    both, only_n, only_o = F.col("_o").isNotNull() & F.col("_n").isNotNull(), F.col("_o").isNull(), F.col("_n").isNull()
    return j.agg(
        total.alias("total"), F.count_if(both).alias("matched"), F.count_if(only_n).alias("new_only"), F.count_if(only_o).alias("not_seen"),
        F.try_divide(F.count_if(both) * 100, total).alias("matched_pct"), F.try_divide(F.count_if(only_n) * 100, total).alias("new_pct"),
        F.try_divide(F.count_if(only_o) * 100, total).alias("not_seen_pct"),
    )


def change_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("field", "change_type").agg(F.count(F.lit(1)).alias("n"))


def snapshot_deltas(snapshots: DataFrame, key: str = "sku", date: str = "snapshot_date", values: Mapping[str, str] | None = None) -> DataFrame:
    """Difference to the previous snapshot of the same key, 0 for its first one.

    Snapshots hold one row per key and date, so a key's window is bounded by the number of dates.
    """
    w = Window.partitionBy(key).orderBy(date)
    out = snapshots
    for source, name in (values or {"price": "price_change", "comments": "review_change"}).items():
        out = out.withColumn(name, F.coalesce(F.col(source) - F.lag(source).over(w), F.lit(0.0)))
    return out


def trend(snapshots: DataFrame, date: str = "snapshot_date") -> DataFrame:
    return snapshots.groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price_mean"), F.avg("comments").alias("comments_mean"))


def search_keywords(df: DataFrame) -> DataFrame:
    """Distinct brands, categories and brand-category pairs as ``(kind, brand, category)``."""
    brand, cat = tx.split_pair("brand_raw")
    pairs = df.select(brand.alias("brand"), cat.alias("category"))
    brands = pairs.where(F.col("brand") != "").select(F.lit("brand").alias("kind"), "brand", F.lit("").alias("category"))
    names = pairs.select("category").unionByName(df.select(F.explode(F.array(F.trim("level2"), F.trim("category"))).alias("category")))
    cats = names.where(F.col("category") != "").select(F.lit("category").alias("kind"), F.lit("").alias("brand"), "category")
    both = pairs.where((F.col("brand") != "") & (F.col("category") != "")).select(F.lit("pair").alias("kind"), "brand", "category")
    return brands.unionByName(cats).unionByName(both).distinct()
