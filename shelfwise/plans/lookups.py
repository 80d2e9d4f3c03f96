"""Look-ups, coverage, and tables that are written as files and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import tags
from shelfwise.functions import text as tx
from shelfwise.operators import dedupe as dd
from shelfwise.operators import history as hs
from shelfwise.operators import integration as ig
from shelfwise.operators import quality as ql
from shelfwise.operators import scoring as sc
from shelfwise.plans.markets import rounded
from shelfwise.plans.registry import query
from shelfwise.plans.sqlviews import rnd
from shelfwise.sources import readers, sinks, views
from shelfwise.sources.staging import new_path


@query(
    "catalog_lookup",
    """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(1000000 + o_orderkey AS VARCHAR) END AS id FROM orders)
       SELECT o_orderkey, id AS sku, title, price, CASE WHEN c.sku IS NOT NULL THEN 'sku_matched_structured_corpus' WHEN id IS NOT NULL THEN 'sku_not_in_corpus' ELSE 'no_sku' END AS source
       FROM a LEFT JOIN catalog c ON a.id = CAST(1000000 + CAST(c.sku AS BIGINT) AS VARCHAR)""",
    ["catalog"],
)
def catalog_lookup(spark, sf):
    number = (F.col("o_orderkey") + 1_000_000).cast("string")
    forms = [F.lit("看看这个 //3.cn/x 好吃"), F.concat(F.lit("https://item.jd.com/"), number, F.lit(".html?from=1")), F.concat(F.lit("http://item.m.jd.com/product/"), number), F.concat(F.lit("//item.jd.com/"), number, F.lit(".html")), number]
    url = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    asked = views.table(spark, sf, "orders").select("o_orderkey", url.alias("url"))
    known = views.catalog(spark, sf).withColumn("sku", (F.col("sku").cast("bigint") + 1_000_000).cast("string"))
    return ig.lookup_urls(asked, known).drop("url")


@query(
    "review_coverage",
    f"""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS sku, count(*) AS n FROM documents GROUP BY 1)
        SELECT count(*) AS products, count(n) AS reviewed, CAST(coalesce(sum(n), 0) AS BIGINT) AS reviews, {rnd('count(n) * 100.0 / count(*)')} AS coverage_pct FROM catalog LEFT JOIN r USING (sku)""",
    ["catalog"],
)
def review_coverage(spark, sf):
    reviews = views.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sku"))
    return rounded(ig.review_coverage(views.catalog(spark, sf), reviews), "coverage_pct")


@query(
    "last_rank_rows",
    "SELECT sku, promotion AS rank_tab, l_orderkey, l_linenumber, price FROM offers QUALIFY row_number() OVER (PARTITION BY sku, promotion ORDER BY ship_date DESC, l_orderkey DESC, l_linenumber DESC) = 1",
    ["offers"],
)
def last_rank_rows(spark, sf):
    """The last row of every product and ranking tab; the promotion stands for the tab."""
    o = views.offers(spark, sf).withColumnRenamed("promotion", "rank_tab")
    return dd.keep_one(o, ["sku", "rank_tab"], [F.col(c).desc() for c in ("ship_date", "l_orderkey", "l_linenumber")]).select("sku", "rank_tab", "l_orderkey", "l_linenumber", "price")


@query(
    "unit_price_compare",
    f"SELECT sku, price, {rnd('unit_price', 6)} AS unit_price FROM catalog WHERE contains(brand, 'Brand#1') AND contains(category, 'gear') ORDER BY unit_price, sku LIMIT 30",
    ["catalog"],
)
def unit_price_compare(spark, sf):
    hit = sc.keyword_filter(sc.keyword_filter(views.catalog(spark, sf), "gear", ["category"]), "Brand#1", ["brand"])
    top = hit.select("sku", "price", "unit_price").orderBy("unit_price", "sku").limit(30)
    return rounded(top, "unit_price", digits=6)


def chinese_numeral(n: str):
    """A whole number of zero or more in Chinese numerals: groups of four digits that 万 and 亿 close."""
    digits = F.split(F.lit("零,一,二,三,四,五,六,七,八,九"), ",")
    over = lambda k: F.expr(f"`{n}` div {10**k}L")
    parts = []
    for k in range(18, -1, -1):
        digit = over(k) % 10
        unit = ("", "十", "百", "千")[k % 4]
        parts.append(F.when(digit > 0, F.concat(F.get(digits, digit.cast("int")), F.lit(unit))).when((over(k) > 0) & (F.col(n) % 10**k > 0), "零").otherwise(""))
        if k in (4, 12):
            parts.append(F.when(over(k) % 10000 > 0, "万").otherwise(""))
        elif k in (8, 16):
            parts.append(F.when(over(k) > 0, "亿").otherwise(""))
    text = F.regexp_replace(F.concat(*parts), "零+(?=[万亿]|$)", "")
    return F.when(F.col(n) == 0, "零").otherwise(F.regexp_replace(text, "零+", "零"))


@query("numeral_values", "SELECT l_orderkey, l_linenumber, l_partkey + 1 AS value, CAST(l_quantity AS BIGINT) AS arabic FROM lineitem")
def numeral_values(spark, sf):
    """Numbers of any size in Chinese numerals and in Arabic digits, read back."""
    li = views.table(spark, sf, "lineitem").withColumn("n", F.col("l_partkey").cast("bigint") + 1)
    text = chinese_numeral("n")
    return li.select("l_orderkey", "l_linenumber", tags.numeral_value(text).alias("value"), tags.numeral_value(F.col("l_quantity").cast("bigint").cast("string")).alias("arabic"))


@query("compatibility_text", "SELECT l_orderkey, l_linenumber, '净重,' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'kg x' || CAST(l_linenumber AS VARCHAR) || ' fi' AS text FROM lineitem")
def compatibility_text(spark, sf):
    """Width forms, a unit sign, circled numbers and a ligature fold to plain text."""
    wide = F.translate(F.col("l_quantity").cast("bigint").cast("string"), "0123456789", "０１２３４５６７８９")
    circled = F.translate(F.col("l_linenumber").cast("string"), "123456789", "①②③④⑤⑥⑦⑧⑨")
    text = F.concat(F.lit("净重，"), wide, F.lit("㎏　×"), circled, F.lit("；ﬁ"))
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.normalize_text(text).alias("text"))


@query(
    "detail_points",
    "SELECT sku, l_orderkey, l_linenumber, CAST(ship_date AS TIMESTAMP) AS ts, price, '页面价 ' || CAST(CAST(floor(sales) AS BIGINT) AS VARCHAR) || '.5' || CASE WHEN promotion = '' THEN '' ELSE ' ' || promotion END AS promo FROM offers",
    ["offers"],
)
def detail_points(spark, sf):
    o = views.offers(spark, sf).select(F.struct("sku", "l_orderkey", "l_linenumber").alias("k"), F.col("ship_date").alias("date"), F.col("price").alias("final_price"), (F.floor("sales") + 0.5).alias("page_price"), F.concat(F.lit(""), "promotion").alias("coupon"))
    return hs.details_to_points(o, "k").select("k.*", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("ts"), "price", F.col("promo").alias("promo"))


def _checked(spark, sf):
    li = views.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "mismatch").otherwise("consistent").alias("brand_match_status"), F.when(F.col("l_tax") > 0.05, "MISMATCH").otherwise("True").alias("weight_match_status"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("note "), F.col("l_linenumber").cast("string"))).alias("extraction_notes"))


_CHECKED = """checked AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS b, l_tax > 0.05 AS w, CASE WHEN l_linestatus = 'F' THEN 'note ' || CAST(l_linenumber AS VARCHAR) ELSE '无备注' END AS pattern FROM lineitem)"""


@query("structure_rates", f"WITH {_CHECKED} SELECT count(*) AS n, {rnd('avg(CAST(NOT b AS INT))', 6)} AS brand_rate, {rnd('avg(CAST(NOT w AS INT))', 6)} AS weight_rate FROM checked")
def structure_rates(spark, sf):
    return rounded(ql.structure_quality(_checked(spark, sf))[0], "brand_rate", "weight_rate", digits=6)


@query("structure_note_patterns", f"WITH {_CHECKED} SELECT pattern, count(*) AS n FROM checked WHERE b OR w GROUP BY 1 ORDER BY n DESC, pattern LIMIT 20")
def structure_note_patterns(spark, sf):
    return ql.structure_quality(_checked(spark, sf))[1]


@query("structure_failures", f"WITH {_CHECKED} SELECT l_orderkey, l_linenumber FROM checked WHERE b OR w")
def structure_failures(spark, sf):
    return ql.failed_rows(_checked(spark, sf)).select("l_orderkey", "l_linenumber")


# --- files ----------------------------------------------------------------------
@query("csv_round_trip", "SELECT sku, title, '\"' || brand || '\", 1' AS brand, CAST(price AS VARCHAR) IS NOT NULL AS priced, '' AS note FROM catalog", ["catalog"])
def csv_round_trip(spark, sf):
    """Quotes, commas and blanks survive a CSV folder with a byte order mark; every column comes back as text."""
    path = new_path(spark, "csv")
    c = views.catalog(spark, sf).select("sku", "title", F.concat(F.lit('"'), "brand", F.lit('", 1')).alias("brand"), "price", F.lit(None).cast("string").alias("note"))
    sinks.write_csv(c, path)
    back = readers.read_csv_strings(spark, path, ["sku", "title", "brand", "price", "note"])
    return back.select("sku", "title", "brand", (F.col("price") != "").alias("priced"), "note")


@query("typed_csv_round_trip", "SELECT CAST(sku AS BIGINT) AS sku, price, CASE WHEN CAST(sku AS BIGINT) % 7 = 0 THEN NULL ELSE CAST(sales AS BIGINT) END AS sales FROM catalog", ["catalog"])
def typed_csv_round_trip(spark, sf):
    """A CSV read with a schema; cells that don't fit are NULL."""
    path = new_path(spark, "csv")
    c = views.catalog(spark, sf).select("sku", "price", F.when(F.col("sku").cast("bigint") % 7 == 0, "dirty").otherwise(F.col("sales").cast("bigint").cast("string")).alias("sales"))
    sinks.write_csv(c, path, bom=False)
    schema = T.StructType([T.StructField("sku", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("sales", T.LongType())])
    return readers.read_csv_typed(spark, path, schema)


@query(
    "charset_routed_files",
    """SELECT sku, CASE WHEN is_gift THEN '礼盒, "é"' || chr(10) || promotion || '。' ELSE promotion || '包装' END AS note, title FROM catalog""",
    ["catalog"],
)
def charset_routed_files(spark, sf):
    """One folder of files in UTF-8 with and without a mark, GB18030 and GBK, read in one call; some cells hold quoted line breaks."""
    path = new_path(spark, "charsets")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    note = F.when(F.col("is_gift"), F.concat(F.lit('礼盒, "é"\n'), "promotion", F.lit("。"))).otherwise(F.concat("promotion", F.lit("包装")))
    c = views.catalog(spark, sf).select("sku", note.alias("note"), "title", F.pmod(F.xxhash64("sku"), F.lit(4)).alias("k"))
    sinks.write_csv(c.where("k = 0").drop("k"), f"{path}/part=0")
    for k, charset in ((1, "UTF-8"), (2, "GB18030"), (3, "GBK")):
        c.where(F.col("k") == k).drop("k").write.option("header", True).option("encoding", charset).option("escape", '"').csv(f"{path}/part={k}")
    return readers.read_csv_routed(spark, f"{path}/part=*", ["sku", "note", "title"])


@query("snapshot_files", "SELECT make_date(2024, 1, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END) AS snapshot_date, count(*) AS n, sum(l_orderkey) AS keys FROM lineitem GROUP BY 1")
def snapshot_files(spark, sf):
    """Two dated snapshots, odd and even lines; the first is written twice, and the rerun replaces just its own day."""
    path = new_path(spark, "snapshots")
    li = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    sinks.write_snapshot(li, path, "2024-01-01")
    sinks.write_snapshot(li.where("l_linenumber % 2 = 0"), path, "2024-01-02")
    sinks.write_snapshot(li.where("l_linenumber % 2 = 1"), path, "2024-01-01")
    return spark.read.parquet(path).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").cast("decimal(38,0)").alias("keys"))


@query("report_file", "SELECT '- ' || l_returnflag || ': ' || CAST(count(*) AS VARCHAR) AS line FROM lineitem GROUP BY l_returnflag UNION ALL SELECT '## modes'")
def report_file(spark, sf):
    path = new_path(spark, "report")
    m = views.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.count(F.lit(1)).alias("value")).withColumn("section", F.lit("modes"))
    sinks.write_report(sinks.report_lines(m), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("keyword_files", "SELECT DISTINCT category AS keyword FROM catalog", ["catalog"])
def keyword_files(spark, sf):
    path = new_path(spark, "keywords")
    sinks.write_keywords(views.catalog(spark, sf), path, "category")
    return readers.read_csv_strings(spark, path, ["category"]).withColumnRenamed("category", "keyword")
