"""Review attribution, review uniqueness and question routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import market as mk
from shelfwise.operators import quality as ql
from shelfwise.operators import questions as qs
from shelfwise.operators import reviews as rv
from shelfwise.operators import scoring as sc
from shelfwise.plans.markets import rounded
from shelfwise.plans.pricing import _SEL
from shelfwise.plans.registry import query
from shelfwise.plans.sqlviews import rnd
from shelfwise.sources import views

# rules over words of the sample texts; the Chinese rules are the defaults of the operators
REASONS = [("links", ["http", "www"]), ("license", ["License", "license", "Copyright"]), ("contact", ["@"]), ("french", ["é", "è"]), ("german", ["ß", "ü"])]
_REASON_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(text, '{t}')" for t in ts) + f" THEN '{n}'" for n, ts in REASONS) + " ELSE 'other' END"

SCENES = [("pick", ["the", "erth"]), ("promo", ["of", "tion", "ing"]), ("review", ["que", "éau"]), ("source", ["und", "sch"])]
INTENTS = [("promotion", ["éau", "ß"]), ("brand", ["erthe"]), ("compare", ["tion"])]


@query("review_reasons", f"SELECT doc_id, {_REASON_SQL} AS reason FROM reviews", ["reviews"])
def review_reasons(spark, sf):
    return rv.with_reason(views.reviews(spark, sf), "text", REASONS, "other").select("doc_id", "reason")


@query(
    "review_reason_counts",
    f"SELECT reason, item_id, count(*) AS n FROM (SELECT *, {_REASON_SQL} AS reason FROM reviews WHERE negative) GROUP BY ROLLUP (reason, item_id) HAVING reason IS NOT NULL",
    ["reviews"],
)
def review_reason_counts(spark, sf):
    return rv.reason_counts(rv.with_reason(views.reviews(spark, sf).where("negative"), "text", REASONS, "other"))


@query(
    "negative_keyword_hits",
    """SELECT term, CAST(sum((length(text) - length(replace(text, term, ''))) // length(term)) AS BIGINT) AS hits FROM reviews, (SELECT unnest(['the', 'tion', 'que', '###', '@']) AS term) WHERE negative GROUP BY 1""",
    ["reviews"],
)
def negative_keyword_hits(spark, sf):
    return mk.keyword_hits(views.reviews(spark, sf).where("negative"), "text", ["the", "tion", "que", "###", "@"]).withColumn("hits", F.col("hits").cast("bigint"))


@query(
    "distinct_reviews",
    "SELECT item_id, min(doc_id) AS doc_id FROM reviews GROUP BY item_id, text",
    ["reviews"],
)
def distinct_reviews(spark, sf):
    return rv.distinct_reviews(views.reviews(spark, sf), ["item_id"], "text", order=[F.col("doc_id").asc()]).select("item_id", "doc_id")


@query(
    "review_uniqueness",
    f"SELECT count(*) AS nonempty, count(DISTINCT t) AS \"unique\", {rnd('1 - count(DISTINCT t) / count(*)', 6)} AS duplicate_ratio FROM (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM reviews) WHERE t <> ''",
    ["reviews"],
)
def review_uniqueness(spark, sf):
    return rounded(ql.text_uniqueness(views.reviews(spark, sf), "text"), "duplicate_ratio", digits=6)


_HITS = {n: " + ".join(f"CAST(contains(text, '{w}') AS INT)" for w in ws) for n, ws in SCENES}
_TOTAL = " + ".join(f"s{i}" for i in range(len(SCENES)))
_BEST = "greatest(" + ", ".join(f"s{i}" for i in range(len(SCENES))) + ")"


@query(
    "question_routes",
    f"""WITH h AS (SELECT question_id, text, {', '.join(f'{e} AS s{i}' for i, e in enumerate(_HITS.values()))} FROM questions)
        SELECT question_id, CASE WHEN {_TOTAL} = 0 THEN 'pick' {' '.join(f"WHEN s{i} = {_BEST} THEN '{n}'" for i, (n, _) in enumerate(SCENES))} END AS scene,
          {rnd(f"CASE WHEN {_TOTAL} = 0 THEN 0.3 ELSE {_BEST} / ({_TOTAL}) END")} AS confidence,
          CASE {' '.join("WHEN " + ' OR '.join(f"contains(text, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in INTENTS)} ELSE 'smart_selection' END AS intent FROM h""",
    ["questions"],
)
def question_routes(spark, sf):
    return rounded(qs.route(views.questions(spark, sf), "text", SCENES, INTENTS).drop("text"), "confidence")


def _asked(spark, sf):
    """Questions that end in a wish, so that every parameter occurs: ``… 300元以内 Brand#3 PROMO bolt``."""
    q = views.questions(spark, sf)
    c = views.catalog(spark, sf).select("brand", "category", F.col("sku").alias("k"))
    n = F.length("text")
    parts = views.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    j = q.withColumn("k", (n % parts).cast("string")).join(c, "k")
    wish = F.concat("text", F.lit(" "), (n % 900 + 20).cast("string"), F.lit(" 元以内 "), "brand", F.lit(" "), F.col("category"))
    return j.select("question_id", wish.alias("text"))


_ASKED = """a AS (SELECT question_id, text || ' ' || CAST(length(text) % 900 + 20 AS VARCHAR) || ' 元以内 ' || brand || ' ' || category AS text, CAST(length(text) % 900 + 20 AS DOUBLE) AS max_price
   FROM questions JOIN catalog ON sku = CAST(length(text) % (SELECT count(*) FROM part) AS VARCHAR)),
   pa AS (SELECT question_id, any_value(max_price) AS max_price, arg_max(brand, row(length(brand), brand)) AS brand FROM a JOIN (SELECT DISTINCT brand FROM catalog) b ON contains(text, b.brand) GROUP BY 1),
   pc AS (SELECT question_id, arg_max(category, row(length(category), category)) AS category FROM a JOIN (SELECT DISTINCT category FROM catalog UNION SELECT DISTINCT level2 FROM catalog) c ON contains(text, c.category) GROUP BY 1),
   p AS (SELECT * FROM pa JOIN pc USING (question_id))"""


def _params(spark, sf):
    c = views.catalog(spark, sf)
    cats = c.select(F.explode(F.array("category", "level2")).alias("category")).distinct()
    return qs.question_parameters(_asked(spark, sf), c.select("brand").distinct(), cats)


@query("question_parameters", f"WITH {_ASKED} SELECT question_id, max_price, brand, category, category AS keyword FROM p", ["questions", "catalog"])
def question_parameters(spark, sf):
    return _params(spark, sf)


@query(
    "question_answers",
    f"""WITH {_ASKED}, {_SEL}, r AS (SELECT question_id, p.category, p.max_price AS cap, sku, price, final_score, row_number() OVER (PARTITION BY question_id ORDER BY {rnd('final_score', 6)} DESC, sku) AS k
          FROM p JOIN f ON f.category = p.category AND f.price <= p.max_price)
        SELECT question_id, category, cap, CAST(k AS INT) AS rank, sku, price, {rnd('final_score')} AS final_score FROM r WHERE k <= 3""",
    ["questions", "catalog"],
)
def question_answers(spark, sf):
    scored = sc.selection_score(views.catalog(spark, sf)).select("category", "sku", "price", "final_score")
    return rounded(qs.answer_selection(_params(spark, sf), scored), "final_score").select("question_id", "category", "cap", "rank", "sku", "price", "final_score")


@query(
    "question_price_answers",
    f"""WITH {_ASKED} SELECT question_id, p.brand, p.category, arg_min(sku, row(price / weight_g, sku)) AS cheapest, count(*) AS usable FROM p JOIN catalog c ON c.brand = p.brand AND c.category = p.category GROUP BY 1, 2, 3""",
    ["questions", "catalog"],
)
def question_price_answers(spark, sf):
    top, status = sc.price_table(views.catalog(spark, sf), k=1)
    answers = top.select("brand", "category", F.col("sku").alias("cheapest")).join(status.where(F.col("status") == "ok").select("brand", "category", "usable"), ["brand", "category"])
    return _params(spark, sf).join(answers, ["brand", "category"]).select("question_id", "brand", "category", "cheapest", "usable")


@query(
    "question_findings",
    f"""WITH {_ASKED}, c AS (SELECT category, count(*) AS n, {rnd('avg(price)')} AS pm, {rnd('avg(CAST(has_promotion AS DOUBLE))')} AS ps FROM catalog GROUP BY 1)
        SELECT question_id, CASE WHEN n IS NULL THEN '' ELSE 'items=' || CAST(n AS VARCHAR) || ';thin=' || CAST(ps < 0.1 AS VARCHAR) END AS findings FROM p LEFT JOIN c USING (category)""",
    ["questions", "catalog"],
)
def question_findings(spark, sf):
    c = views.catalog(spark, sf)
    stats = c.groupBy("category").agg(F.count(F.lit(1)).cast("double").alias("items"), F.avg(F.col("has_promotion").cast("double")).alias("promotion_share"))
    facts = stats.select(
        "category",
        F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit("catalog").alias("source"), F.when(F.col(m) < 0.10, "thin coverage").otherwise("").alias("caveat")) for i, m in enumerate(("items", "promotion_share"))])),
    )
    out = qs.findings_per_question(_params(spark, sf), facts, ["category"])
    first, second = F.get("findings", F.lit(0)), F.get("findings", F.lit(1))
    text = F.concat(F.lit("items="), first["value"].cast("bigint").cast("string"), F.lit(";thin="), (second["caveat"] != "").cast("string"))
    return out.select("question_id", F.coalesce(text, F.lit("")).alias("findings"))
