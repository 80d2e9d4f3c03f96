"""Entity extraction queries: brands, categories, tags and the structuring job."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import tags, words
from shelfwise.functions import text as tx
from shelfwise.operators import extraction as ex
from shelfwise.operators import market as mk
from shelfwise.operators import segmentation as sg
from shelfwise.plans.markets import rounded
from shelfwise.plans.registry import query
from shelfwise.plans.sqlviews import rnd
from shelfwise.sources import views
from shelfwise.sources.staging import stage

KEYS = ["l_orderkey", "l_linenumber", "l_suppkey", "amount"]
KEY_SQL = "l_orderkey, l_linenumber, l_suppkey, amount"


def listing(spark, sf):
    """Raw listing with the brand column blank on a third of the rows."""
    raw = views.raw_listing(spark, sf)
    o = views.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("pk"), F.col("p_brand").alias("p_brand"), (F.col("p_size") * 10).cast("string").alias("weight_g"))
    j = raw.join(o, tx.normalize_key("item_id") == F.col("pk"))
    blank = F.startswith("item_id", F.lit(" "))
    brand = F.when(blank, "").otherwise(F.concat("p_brand", F.lit(" - "), "category_breadcrumb"))
    # extraction reads its input in several branches; a crawl is a stored table of the columns that it reads
    return stage(j.select(*KEYS, "item_id", "title", brand.alias("brand"), "weight_g"))


@query("brand_dictionary", "SELECT DISTINCT brand AS alias FROM catalog", ["catalog"])
def brand_dictionary(spark, sf):
    return ex.brand_dictionary(views.catalog(spark, sf).withColumn("brand", F.concat("brand", F.lit(" | 旗舰店"))))


@query("brands_from_titles", f"SELECT {KEY_SQL}, brand AS brand_from_name FROM listing", ["listing"])
def brands_from_titles(spark, sf):
    return ex.brand_from_titles(listing(spark, sf), key="item_id").select(*KEYS, "brand_from_name")


@query(
    "contained_vocabulary",
    """WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS w FROM benchmark) WHERE w <> '')
       SELECT question_id, count(*) AS terms, arg_max(w, row(length(w), w)) AS longest FROM questions JOIN v ON contains(text, w) GROUP BY 1""",
    ["questions"],
)
def contained_vocabulary(spark, sf):
    v = _vocabulary(spark, sf)
    pairs = ex.contained_pairs(views.questions(spark, sf), "question_id", "text", v, "w")
    return pairs.groupBy("question_id").agg(F.count(F.lit(1)).alias("terms"), F.max_by("w", F.struct(F.length("w"), F.col("w"))).alias("longest"))


def _vocabulary(spark, sf):
    w = views.table(spark, sf, "benchmark").select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("w"))
    return w.select(F.lower("w").alias("w")).where(F.col("w") != "").distinct()


@query(
    "document_vocabulary",
    """WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS w FROM benchmark) WHERE w <> ''),
       t AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM documents))
       SELECT doc_id, count(*) AS terms FROM t JOIN v USING (w) GROUP BY 1""",
)
def document_vocabulary(spark, sf):
    pairs = ex.contained_words(views.table(spark, sf, "documents"), "doc_id", "text", _vocabulary(spark, sf), "w")
    return pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"))


@query(
    "canonical_brands",
    f"""SELECT {KEY_SQL}, CASE WHEN level2 = 'PROMO' THEN '乐事' ELSE 'Brand' END AS brand, CASE WHEN level2 = 'PROMO' THEN 'brand_dictionary' ELSE 'leading_token' END AS method FROM listing""",
    ["listing"],
)
def canonical_brands(spark, sf):
    t = F.regexp_replace(F.regexp_replace("title", "^【PROMO】", "【京东超市】lay's "), "^【[A-Z]+】", "")
    out = views.raw_listing(spark, sf).withColumn("b", ex.canonical_brand(t))
    return out.select(*KEYS, F.col("b.brand").alias("brand"), F.col("b.method").alias("method"))


@query(
    "quoted_or_known_brands",
    f"""SELECT {KEY_SQL}, CASE level2 WHEN 'PROMO' THEN 'PROMO' WHEN 'SMALL' THEN 'SMALL' WHEN 'LARGE' THEN '洽洽' END AS brand FROM listing""",
    ["listing"],
)
def quoted_or_known_brands(spark, sf):
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("title", "【PROMO】", "「PROMO」"), "【SMALL】", "（SMALL）"), "【LARGE】", "xx 洽洽 ")
    return views.raw_listing(spark, sf).select(*KEYS, ex.quoted_or_known_brand(t).alias("brand"))


@query(
    "ranked_brand_matches",
    """SELECT t.title, arg_max(b.brand, row(p, length(b.brand), b.brand)) AS brand_match, max(p) AS priority FROM (
         SELECT t.title, b.brand, CASE WHEN starts_with(t.title, b.brand) THEN 3 WHEN contains(substr(t.title, 1, 20), b.brand) THEN 2 ELSE 1 END AS p
         FROM (SELECT DISTINCT category || ' ' || title || ' ' || brand AS title FROM catalog) t JOIN (SELECT DISTINCT flavor AS brand FROM catalog UNION SELECT DISTINCT brand FROM catalog) b ON contains(t.title, b.brand)) x
         JOIN (SELECT '' AS k) ON true, LATERAL (SELECT x.title, x.brand) t, LATERAL (SELECT x.brand) b GROUP BY t.title""",
    ["catalog"],
)
def ranked_brand_matches(spark, sf):
    c = views.catalog(spark, sf)
    t = c.select(F.concat_ws(" ", "category", "title", "brand").alias("title")).distinct().withColumn("k", F.col("title"))
    d = c.select(F.explode(F.array("flavor", "brand")).alias("brand")).distinct()
    return ex.ranked_brand_match(t, "k", "title", d, "brand").withColumnRenamed("k", "title")


_HEAD = "regexp_extract(title, '^([a-z]{2,8})', 1)"


@query(
    "mined_brands",
    f"SELECT token, count(*) AS support FROM (SELECT {_HEAD} AS token FROM catalog) WHERE token <> '' AND token NOT IN ('small', 'large') GROUP BY 1 HAVING count(*) >= 3",
    ["catalog"],
)
def mined_brands(spark, sf):
    return ex.mine_brands(views.catalog(spark, sf), generic=["small", "large"])


@query(
    "prefix_brands",
    f"""WITH m AS (SELECT token FROM (SELECT {_HEAD} AS token FROM catalog) WHERE token <> '' AND token NOT IN ('small', 'large') GROUP BY 1 HAVING count(*) >= 3)
        SELECT sku, (SELECT max(token) FROM m WHERE starts_with(c.title, token) AND length(token) = (SELECT max(length(token)) FROM m WHERE starts_with(c.title, token))) AS brand_from_prefix FROM catalog c""".replace("(SELECT max(token) FROM m WHERE starts_with(c.title, token) AND length(token) = (SELECT max(length(token)) FROM m WHERE starts_with(c.title, token)))", "m.token").replace("FROM catalog c", "FROM catalog c LEFT JOIN m ON split_part(c.title, ' ', 1) = m.token"),
    ["catalog"],
)
def prefix_brands(spark, sf):
    c = views.catalog(spark, sf)
    return ex.apply_prefix_brands(c, ex.mine_brands(c, generic=["small", "large"])).select("sku", "brand_from_prefix")


@query(
    "known_or_head_brands",
    """SELECT sku, CASE WHEN level2 = 'PROMO' THEN '卫龙' WHEN level2 = 'LARGE' THEN NULL ELSE split_part(title, ' ', 1) END AS brand FROM catalog""",
    ["catalog"],
)
def known_or_head_brands(spark, sf):
    t = F.when(F.col("level2") == "PROMO", F.concat("title", F.lit(" 卫龙"))).when(F.col("level2") == "LARGE", F.concat(F.lit("2024"), "title")).otherwise(F.col("title"))
    return views.catalog(spark, sf).select("sku", ex.known_or_head_brand(t).alias("brand"))


@query(
    "brand_fill_audit",
    """SELECT sku, CASE level2 WHEN 'PROMO' THEN 'updated_alias' WHEN 'LARGE' THEN 'skip_generic' WHEN 'SMALL' THEN 'skip_empty' ELSE 'updated_prefix' END AS action,
       CASE level2 WHEN 'PROMO' THEN '卡乐比' WHEN 'SMALL' THEN '' ELSE split_part(title, ' ', 1) END AS filled_brand FROM catalog""",
    ["catalog"],
)
def brand_fill_audit(spark, sf):
    t = (
        F.when(F.col("level2") == "PROMO", F.concat(F.lit("calbee "), "title"))
        .when(F.col("level2") == "LARGE", F.concat("title", F.lit(" 零食大礼包")))
        .when(F.col("level2") == "SMALL", F.lit("【仅标签】2024 - "))
        .otherwise(F.concat(F.lit("【新品】【热卖】 2025 代购 "), "title"))
    )
    dirty = F.when(F.col("is_gift"), "版本:1.2").otherwise(words.UNKNOWN_BRAND)
    rows = views.catalog(spark, sf).withColumn("title", t).withColumn("brand", dirty)
    return ex.fill_unknown_brands(rows).select("sku", "action", "filled_brand")


@query(
    "subcategories",
    """SELECT sku, CASE level2 WHEN 'PROMO' THEN '坚果' WHEN 'LARGE' THEN '肉干' WHEN 'SMALL' THEN '糕点' ELSE '' END AS subcategory, CASE level2 WHEN 'PROMO' THEN '麻辣|奶油' ELSE '' END AS flavors FROM catalog""",
    ["catalog"],
)
def subcategories(spark, sf):
    t = F.when(F.col("level2") == "PROMO", "奶油 夏威夷果 麻辣").when(F.col("level2") == "LARGE", "牛肉干").when(F.col("level2") == "SMALL", "蛋黄酥").otherwise(F.col("title"))
    return views.catalog(spark, sf).select("sku", tags.subcategory(t).alias("subcategory"), F.array_join(tags.first_tags(t), "|").alias("flavors"))


@query(
    "inferred_categories",
    """WITH t AS (SELECT sku, CASE WHEN is_gift THEN title || ' ' || category ELSE title || ' ' || brand END AS title, is_gift FROM catalog), v AS (SELECT DISTINCT category, unnest([flavor, brand, category]) AS token FROM catalog),
       s AS (SELECT sku, category, sum(length(token)) AS score FROM t JOIN v ON contains(t.title, v.token) GROUP BY 1, 2),
       b AS (SELECT sku, arg_min(category, row(-score, category)) AS cat FROM s GROUP BY 1),
       d AS (SELECT sku, arg_max(category, row(length(category), category)) AS cat FROM t JOIN (SELECT DISTINCT category FROM catalog) c ON contains(t.title, c.category) GROUP BY 1)
       SELECT t.sku, coalesce(d.cat, b.cat, '') AS category, CASE WHEN d.cat IS NOT NULL THEN 'name' WHEN b.cat IS NOT NULL THEN 'tokens' ELSE 'none' END AS method FROM t LEFT JOIN d USING (sku) LEFT JOIN b USING (sku)""",
    ["catalog"],
)
def inferred_categories(spark, sf):
    c = views.catalog(spark, sf)
    t = c.select("sku", F.when(F.col("is_gift"), F.concat_ws(" ", "title", "category")).otherwise(F.concat_ws(" ", "title", "brand")).alias("title"))
    return ex.infer_category(t, c.select("category", F.array("flavor", "brand").alias("keywords")), "sku", "title")


@query(
    "inferred_tags",
    """WITH v AS (SELECT DISTINCT trim(unnest(string_split(flavor || ';' || split_part(category, ' ', 2) || '; ' || brand, ';'))) AS v FROM catalog)
       SELECT sku, string_agg(v, ';' ORDER BY r) AS tags FROM (SELECT sku, v, row_number() OVER (PARTITION BY sku ORDER BY length(v) DESC, v) AS r FROM (SELECT sku, title || ' ' || brand AS title FROM catalog) c JOIN v ON contains(title, v) WHERE v <> '') WHERE r <= 3 GROUP BY 1""",
    ["catalog"],
)
def inferred_tags(spark, sf):
    c = views.catalog(spark, sf)
    corpus = c.select(F.concat("flavor", F.lit(";"), views.noun(F.col("category")), F.lit("; "), "brand").alias("tags"))
    return ex.infer_tags(c.select("sku", F.concat_ws(" ", "title", "brand").alias("title")), corpus, "sku", "title", "tags")


@query(
    "structured_titles",
    f"""SELECT {KEY_SQL}, brand AS brand_from_name, weight_g * q AS weight_from_text, '' AS flavor, '袋装' AS package_type, CASE WHEN contains(level2, 'G') THEN '' ELSE '系列:' || level2 || ';' END || q::INT || '袋' AS specification, false AS gift,
        concat_ws(';', level2, 'Brand', split_part(title, ' ', 2), split_part(title, ' ', 3), brand, '袋装') AS keywords,
        CASE WHEN l_returnflag = 'R' THEN 'missing_original' ELSE 'consistent' END AS brand_match_status, CASE WHEN wok THEN 'consistent' ELSE 'mismatch' END AS weight_match_status,
        concat_ws(';', CASE WHEN l_returnflag = 'R' THEN '品牌missing_original' ELSE '品牌一致' END, CASE WHEN wok THEN '重量一致' ELSE '重量mismatch' END, '重量来源:倍数重量', '未识别口味') AS extraction_notes
        FROM (SELECT *, CASE WHEN starts_with(item_id, ' ') THEN 'R' ELSE 'N' END AS l_returnflag, abs(weight_g - weight_g * q) <= greatest(1.0, weight_g * 0.02) AS wok FROM listing)""",
    ["listing"],
)
def structured_titles(spark, sf):
    out = ex.structure_titles(listing(spark, sf), key="item_id")
    listed = [F.array_join(f"{c}_tags", ";").alias(n) for c, n in (("flavor", "flavor"), ("package", "package_type"), ("specification", "specification"))]
    return out.select(*KEYS, "brand_from_name", "weight_from_text", *listed, "gift", F.array_join("keywords", ";").alias("keywords"), "brand_match_status", "weight_match_status", "extraction_notes")


@query(
    "extraction_report",
    f"""WITH s AS (SELECT *, abs(weight_g - weight_g * q) <= greatest(1.0, weight_g * 0.02) AS wok FROM listing), t AS (SELECT count(*) AS n FROM s)
        SELECT metric, k AS n, {rnd('k / n', 6)} AS rate FROM t, (SELECT 'brand' AS metric, count(*) AS k FROM s UNION ALL SELECT 'flavor', 0 UNION ALL SELECT 'weight', count(*) FROM s UNION ALL SELECT 'package', count(*) FROM s UNION ALL SELECT 'gift', 0
        UNION ALL SELECT 'brand_mismatch', 0 UNION ALL SELECT 'weight_mismatch', count(*) FILTER (NOT wok) FROM s UNION ALL SELECT 'weight_fillable', 0)""",
    ["listing"],
)
def extraction_report(spark, sf):
    return rounded(ex.extraction_report(ex.structure_titles(listing(spark, sf), key="item_id")), "rate", digits=6)


@query(
    "title_keywords",
    """WITH l AS (SELECT sku, trim(brand) AS b, trim(category) AS c, list_filter(regexp_extract_all(replace(replace(concat_ws(' ', title, brand, promotion), '×', 'x'), 'X', 'x'), '[A-Za-z]{2,}'), lambda w: lower(w) NOT IN ('kg', 'g')) AS latin,
              regexp_extract_all(replace(concat_ws(' ', title, brand, promotion), '，', ' '), '[一-龥]+') AS runs FROM catalog),
       h AS (SELECT *, flatten(list_transform(runs, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))) AS han FROM l),
       k AS (SELECT sku, list_concat(list_concat(latin, han), [b, c]) AS all_words FROM h)
       SELECT sku, array_to_string(list_filter(all_words, lambda w, i: list_position(all_words, w) = i AND w NOT IN ('满减', '包邮', '优惠', '促销', '特价', '京东', '热卖', '自营', 'kg', 'KG')), ';') AS keywords FROM k""",
    ["catalog"],
)
def title_keywords(spark, sf):
    c = views.catalog(spark, sf)
    return c.select("sku", F.array_join(tags.keyword_tags(F.concat_ws(" ", "title", "brand", "promotion"), ["brand", "category"]), ";").alias("keywords"))


_LETTERS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地人山"


@query(
    "segmented_keywords",
    f"""WITH RECURSIVE t AS (SELECT sku, trim(brand) AS b, trim(category) AS c, regexp_extract_all(concat_ws(' ', title, brand, promotion, translate(flavor || split_part(category, ' ', 2), '{_LETTERS}', '{_SIGNS}')), '[一-龥]+|[A-Za-z]{{2,}}') AS l FROM catalog),
       tok AS (SELECT sku, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS w FROM t),
       runs AS (SELECT w AS run, count(*) AS n FROM tok WHERE regexp_matches(w, '^[一-龥]') GROUP BY 1),
       grams AS (SELECT substr(run, i, k) AS g, sum(n) AS n FROM runs, range(1, 40) p(i), range(1, 7) q(k) WHERE i + k - 1 <= length(run) GROUP BY 1),
       total AS (SELECT sum(n) AS s FROM grams WHERE length(g) = 1),
       voc AS (SELECT g, round(1000000 * ln(n / s))::BIGINT AS w FROM grams, total WHERE length(g) = 1 OR n >= greatest(2, ceil(s / 100000))),
       rec(run, i, b, p) AS (
         SELECT run, 0, [0::BIGINT], [[]::VARCHAR[]] FROM runs
         UNION ALL SELECT run, i + 1, list_append(b, max(b[i + 2 - k] + voc.w)), list_append(p, arg_max(list_append(p[i + 2 - k], g), row(b[i + 2 - k] + voc.w, k)))
         FROM rec, range(1, 7) q(k), voc WHERE i < length(run) AND k <= i + 1 AND g = substr(run, i + 2 - k, k) GROUP BY run, i, b, p),
       best AS (SELECT run, p[length(run) + 1] AS own FROM rec WHERE i = length(run)),
       found AS (SELECT sku, flatten(list(coalesce(own, [w]) ORDER BY i)) AS ws FROM tok LEFT JOIN best ON w = run GROUP BY 1),
       k AS (SELECT sku, list_concat(list_filter(ws, lambda w: length(w) > 1 AND NOT regexp_matches(lower(w), '^(kg|g|公斤|千克)$')), [b, c]) AS ws FROM found JOIN t USING (sku))
       SELECT sku, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i AND w NOT IN ('满减', '包邮', '优惠', '促销', '特价', '京东', '热卖', '自营', 'kg', 'KG')), ';') AS keywords FROM k""",
    ["catalog"],
)
def segmented_keywords(spark, sf):
    c = views.catalog(spark, sf)
    unspaced = F.translate(F.concat("flavor", views.noun(F.col("category"))), _LETTERS, _SIGNS)
    c = c.withColumn("t", F.concat_ws(" ", "title", "brand", "promotion", unspaced))
    counts = sg.word_counts(c, "t", max_length=6)
    return c.select("sku", F.array_join(sg.keywords(F.col("t"), counts, ["brand", "category"]), ";").alias("keywords"))


@query(
    "nonstandard_top_words",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(title, ' ')) AS word FROM offers WHERE weight_g < 200) WHERE word NOT IN ('ring', 'old') GROUP BY 1 ORDER BY n DESC, word LIMIT 10",
    ["offers"],
)
def nonstandard_top_words(spark, sf):
    o = views.offers(spark, sf).withColumn("weight_g", F.when(F.col("weight_g") >= 200, F.col("weight_g")))
    # keywords per distinct title, then weighted by how many offers carry it
    titles = mk.non_standard(o).groupBy("title").agg(F.count(F.lit(1)).alias("c"))
    w = titles.select("c", F.explode(tags.keyword_tags("title", stop=["ring", "old"], vocabulary=[])).alias("word"))
    return w.groupBy("word").agg(F.sum("c").alias("n")).orderBy(F.col("n").desc(), F.col("word").asc()).limit(10)
