"""Batches of free-text questions: parameters, scene, intent and the tables that answer them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import tags, words
from shelfwise.functions import text as tx
from shelfwise.operators.dedupe import top_per_group
from shelfwise.operators.extraction import contained_pairs


def price_cap(text, pattern: str = r"(\d+(?:\.\d+)?)\s*元\s*(?:以内|以下|内)?") -> Column:
    return tx.rx_number(text, pattern)


def question_parameters(questions: DataFrame, brands: DataFrame, categories: DataFrame, key: str = "question_id", text: str = "text", fallback: Sequence[str] = tuple(words.FALLBACK_CATEGORIES)) -> DataFrame:
    """Price cap, longest contained brand and category of every question.

    Dictionaries are one-column tables ``brand`` and ``category``.
    """
    def longest(terms: DataFrame, column: str, name: str) -> DataFrame:
        pairs = contained_pairs(questions, key, text, terms, column)
        return pairs.groupBy(key).agg(F.max_by(column, F.struct(F.length(column), F.col(column))).alias(name))

    out = questions.join(longest(brands, "brand", "brand"), key, "left").join(longest(categories, "category", "_cat"), key, "left")
    listed = F.try_element_at(F.filter(tags.string_array(list(fallback)), lambda w: F.contains(F.col(text), w)), F.lit(1))
    category = F.coalesce("_cat", listed)
    return out.select(key, price_cap(text).alias("max_price"), "brand", category.alias("category"), F.coalesce(category, F.lit("")).alias("keyword"))


def scene(text, scenes=tuple(words.SCENE_KEYWORDS), default=words.DEFAULT_SCENE) -> Column:
    """``struct(scene, confidence)``: most keyword hits, first scene on a tie."""
    hits = [sum((F.contains(F.coalesce(tx.col(text), F.lit("")), F.lit(w)).cast("int") for w in kws), F.lit(0)) for _, kws in scenes]
    ranked = F.array_max(F.array(*[F.struct(h.alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("scene")) for i, ((n, _), h) in enumerate(zip(scenes, hits))]))
    total = sum(hits, F.lit(0))
    none = total == 0
    return F.struct(
        F.when(none, F.lit(default[0])).otherwise(ranked["scene"]).alias("scene"),
        F.when(none, F.lit(default[1])).otherwise(ranked["score"] / total).alias("confidence"),
    )


def intent(text, rules=tuple(words.INTENT_RULES), default: str = words.DEFAULT_INTENT) -> Column:
    return tags.first_label(text, rules, default)


def route(questions: DataFrame, text: str = "text", scenes=tuple(words.SCENE_KEYWORDS), rules=tuple(words.INTENT_RULES)) -> DataFrame:
    s = scene(text, scenes)
    return questions.withColumn("_s", s).select("*", F.col("_s.scene").alias("scene"), F.col("_s.confidence").alias("confidence"), intent(text, rules).alias("intent")).drop("_s")


NO_CAP = 1e15


def _price_step(price: Column) -> Column:
    """Monotone price step; square roots are exactly rounded, so every executor agrees."""
    return F.floor(F.sqrt(F.sqrt(F.greatest(price, F.lit(0.0)))) * 8)


def answer_selection(params: DataFrame, ranked: DataFrame, key: str = "question_id", k: int = 3) -> DataFrame:
    """Best products of the asked category under the asked price, ``k`` per question.

    ``ranked`` holds the scored catalog.  Distinct (category, price cap) pairs are answered once.  Price
    steps wholly below a cap contribute only their own best ``k``; single products are compared with the
    cap only inside the step the cap falls in.
    """
    order = [tx.stable_round("final_score", 6).desc(), F.col("sku").asc()]
    asked = params.where(F.col("category").isNotNull()).withColumn("cap", F.coalesce("max_price", F.lit(NO_CAP)))
    wanted = asked.select("category", "cap", _price_step(F.col("cap")).alias("_cap_step")).distinct()
    rows = ranked.select("category", "sku", "price", "final_score", _price_step(F.col("price")).alias("_step"))
    below = top_per_group(rows, ["category", "_step"], order, k).join(wanted, "category").where(F.col("_step") < F.col("_cap_step"))
    inside = rows.join(wanted.withColumn("_step", F.col("_cap_step")), ["category", "_step"]).where(F.col("price") <= F.col("cap"))
    best = top_per_group(below.unionByName(inside.select(below.columns)), ["category", "cap"], order, k, "rank")
    return asked.select(key, "category", "cap").join(best.select("category", "cap", "rank", "sku", "price", "final_score"), ["category", "cap"])


def answer_tables(params: DataFrame, tables: dict[str, DataFrame], on: dict[str, Sequence[str]], key: str = "question_id") -> dict[str, DataFrame]:
    """Per intent, the questions joined to the table that answers them on the extracted parameters."""
    return {name: params.where(F.col("intent") == name).join(t, list(on[name]), "left") for name, t in tables.items()}


def findings_per_question(params: DataFrame, facts: DataFrame, on: Sequence[str], key: str = "question_id") -> DataFrame:
    """One row per question with its findings as an array of structs, in fact order.

    ``facts`` carries a bounded number of facts per parameter value.
    """
    j = params.join(facts, list(on), "left")
    fact = F.struct("ordinal", "metric", "value", "source", "caveat")
    return j.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("metric").isNotNull(), fact))).alias("findings"))
