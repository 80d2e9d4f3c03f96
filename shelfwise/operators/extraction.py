"""Entities out of titles as table jobs: dictionary matches, brand filling and mining, structuring.

A dictionary that is itself a table becomes an automaton that every text passes through once, see :mod:`.automaton`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import tags, words
from shelfwise.functions import text as tx
from shelfwise.functions.weight import weight_structured
from shelfwise.operators.automaton import contained_terms, longest_term


def contained_pairs(df: DataFrame, key: str, text: str, terms: DataFrame, term: str, ignore_case: bool = False) -> DataFrame:
    """``(key, term)`` for every dictionary term that occurs in the text, each pair once; one pass of :mod:`.automaton` over the texts."""
    if not ignore_case:
        return df.select(F.col(key), F.explode(contained_terms(F.col(text), terms, term)).alias(term)).distinct()
    folded = terms.select(F.col(term), F.lower(F.col(term)).alias("_w")).where(F.length("_w") > 0).distinct()
    found = df.select(F.col(key), F.explode(contained_terms(F.lower(F.col(text)), folded, "_w")).alias("_w")).distinct()
    return found.join(folded, "_w").select(key, term)


def contained_words(df: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``(key, term)`` for terms that occur as whole words: one hash join on the distinct words of a text."""
    tokens = df.select(F.col(key), F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"(?U)[^\w]+"))).alias("_w"))
    d = terms.select(F.col(term)).distinct().withColumn("_w", F.lower(F.col(term)))
    return tokens.join(d, "_w").select(key, term)


def longest_contained(df: DataFrame, key: str, text: str, terms: DataFrame, term: str, name: str) -> DataFrame:
    """Longest contained term per key; no row where nothing is contained. Rows of one key count as one text each, none of them is joined."""
    found = df.select(F.col(key), longest_term(F.col(text), terms, term).alias(name)).where(F.col(name).isNotNull())
    return found.groupBy(key).agg(F.max_by(name, F.struct(F.length(name), F.col(name))).alias(name))


# --- brands -------------------------------------------------------------------
def brand_dictionary(df: DataFrame, brand: str = "brand", min_length: int = 2) -> DataFrame:
    """Distinct cleaned brands of a table as a dictionary."""
    # distinct raw values first: the text work then runs once per value, not once per row
    raw = df.select(F.col(brand).alias("_b")).distinct()
    raw = raw.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but much work on each
    d = raw.select(tx.clean_brand(tx.normalize_text("_b"), separators="any", strip_suffix=True).alias("alias")).distinct()
    return d.where(F.length("alias") >= min_length)


def title_head(name, pattern: str = r"^([A-Za-z0-9一-龥]{2,12})") -> Column:
    return F.coalesce(tx.rx(name, pattern), F.lit(""))


def brand_from_titles(df: DataFrame, key: str = "sku", title: str = "title", brand: str = "brand", aliases: DataFrame | None = None) -> DataFrame:
    """``brand_from_name``: own brand if contained, else the longest known brand, else the title head."""
    return _named_brand(df.withColumn("_name", tx.normalize_text(title)), brand, aliases).drop("_name", "_own_brand")


def _named_brand(base: DataFrame, brand: str, aliases: DataFrame | None) -> DataFrame:
    """``brand_from_name`` by the normalised title ``_name``, and the cleaned own brand as ``_own_brand``."""
    base = base.withColumn("_own_brand", tx.clean_brand(tx.normalize_text(brand), separators="any", strip_suffix=True))
    base = base.withColumn("_own", F.when((F.col("_own_brand") != "") & F.contains(F.col("_name"), F.col("_own_brand")), F.col("_own_brand")))
    known = aliases if aliases is not None else brand_dictionary(base, brand)
    # titles with their own brand in them are not looked at
    found = longest_term(F.when(F.col("_own").isNull(), F.col("_name")), known, "alias")
    return base.withColumn("brand_from_name", F.coalesce("_own", found, title_head("_name"))).drop("_own")


def shop_tag_free_title(title) -> Column:
    """Title without a leading platform tag and without leading generic words, each stripped once in list order."""
    t = F.regexp_replace(tx.strip(F.coalesce(tx.col(title), F.lit(""))), r"^[\s【\[]*(京东超市|京东自营|自营|官方旗舰店)[\s】\]]*", "")
    # optional groups in list order strip the same prefixes in one pass
    ordered = "".join(rf"(?:{p}\s*)?" for p in words.GENERIC_TITLE_PREFIXES)
    return tx.strip(F.regexp_replace(t, f"^{ordered}", ""))


def _alias(low: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """Canonical name of the longest contained alias; ``low`` is lower-case text."""
    known = None
    for alias, brand in sorted(aliases, key=lambda a: -len(a[0])):
        hit = F.contains(low, F.lit(alias.lower()))
        known = F.when(hit, F.lit(brand)) if known is None else known.when(hit, F.lit(brand))
    return known


def _leading_feature(han: Column) -> Column:
    """Leading Han run cut before the first listed word that occurs behind its first character; fixed form: 4 characters of it."""
    cut = None
    for s in words.LEADING_TOKEN_CUTS:
        at = F.locate(s, han)
        piece = F.substring(han, F.lit(1), at - 1)
        cut = F.when(at > 1, piece) if cut is None else cut.when(at > 1, piece)
    return tx.let(F.substring(cut.otherwise(han), 1, 4), lambda f: F.when(F.length(f) >= 2, f))


def canonical_brand(title, aliases: Sequence[tuple[str, str]] = tuple(words.BRAND_ALIASES)) -> Column:
    """``struct(brand, method)``: alias dictionary (case-blind, longest first), latin token, Han feature."""

    def found(t: Column) -> Column:
        return F.struct(
            tx.let(F.lower(t), lambda low: _alias(low, aliases)).alias("known"),
            F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9'&.-]{1,18})", 1).alias("latin"),
            tx.let(F.regexp_extract(t, r"^([一-鿿]{2,8})", 1), _leading_feature).alias("feature"),
        )

    def choose(x: Column) -> Column:
        method = (
            F.when(x["known"].isNotNull(), "brand_dictionary").when(x["latin"] != "", "leading_token").when(x["feature"].isNotNull(), "leading_feature").otherwise("")
        )
        return F.struct(F.coalesce(x["known"], F.nullif(x["latin"], F.lit("")), x["feature"], F.lit("")).alias("brand"), method.alias("method"))

    return tx.let(tx.let(shop_tag_free_title(title), found), choose)


def quoted_or_known_brand(title, brands: Sequence[str] = tuple(words.TITLE_BRANDS)) -> Column:
    """Quoted name, short bracketed name, else the longest known brand at the start, in the head, anywhere."""
    arr = tags.string_array(sorted(brands, key=lambda b: -len(b)))

    def known(t: Column) -> Column:
        inside = F.filter(arr, lambda b: F.contains(t, b))
        pick = lambda a, cond: F.try_element_at(F.filter(a, cond), F.lit(1))
        return tx.let(
            inside,
            lambda a: F.when(
                F.size(a) > 0,
                F.coalesce(pick(a, lambda b: F.startswith(t, b)), pick(a, lambda b: F.contains(F.substring(t, 1, 20), b)), F.get(a, F.lit(0))),
            ),
        )

    def rule(t: Column) -> Column:
        quoted = F.regexp_extract(t, "「(.+?)」", 1)
        bracket = F.regexp_extract(t, "[（(](.+?)[）)]", 1)
        short = tx.let(bracket, lambda b: F.when((b != "") & (F.length(b) <= 10) & ~b.rlike(r"\d"), b))
        return F.coalesce(tx.let(quoted, lambda q: F.when(q != "", q)), short, known(t))

    return tx.let(tx.col(title), rule)


def ranked_brand_match(df: DataFrame, key: str, title: str, brands: DataFrame, brand: str, head: int = 20) -> DataFrame:
    """Table-dictionary form of the start / head / anywhere rule: ``(key, brand_match, priority)``."""
    pairs = contained_pairs(df, key, title, brands, brand).join(df.select(key, F.col(title).alias("_title")), key)
    priority = F.when(F.startswith("_title", brand), 3).when(F.contains(F.substring("_title", 1, head), F.col(brand)), 2).otherwise(1)
    best = pairs.withColumn("_prio", priority)
    return best.groupBy(key).agg(
        F.max_by(brand, F.struct("_prio", F.length(brand), F.col(brand))).alias("brand_match"), F.max("_prio").alias("priority")
    )


def mine_brands(df: DataFrame, title: str = "title", token_pattern: str = r"^([一-鿿\w]{2,8})", min_support: int = 3, generic: Sequence[str] = tuple(words.GENERIC_MINED_TOKENS)) -> DataFrame:
    """Leading tokens that recur at least ``min_support`` times and are not generic words."""
    tokens = df.select(tx.rx(title, rf"(?U){token_pattern}").alias("token")).where(F.col("token").isNotNull())
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("support"))
    return counts.where((F.col("support") >= min_support) & ~F.col("token").isin(*generic))


def apply_prefix_brands(df: DataFrame, brands: DataFrame, title: str = "title", brand: str = "token") -> DataFrame:
    """Longest mined brand that starts the title (``brand_from_prefix``, NULL without one).

    A title's prefixes of every length that brands have meet the dictionary in one equi-join.
    """
    d = brands.select(F.col(brand).alias("_b")).where(F.length(brand) > 0).distinct()
    lengths = d.select(F.length("_b").alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("s")).scalar()
    t = df.select(F.col(title).alias("_title")).where(F.col(title).isNotNull()).distinct()
    prefixes = t.withColumn("_n", F.explode(lengths)).where(F.length("_title") >= F.col("_n")).select("_title", F.substring("_title", F.lit(1), F.col("_n")).alias("_b"))
    hits = prefixes.join(d, "_b")
    best = hits.groupBy("_title").agg(F.max_by("_b", F.length("_b")).alias("brand_from_prefix"))
    return df.join(best, df[title] == best["_title"], "left").drop("_title")


def known_or_head_brand(title, brands: Sequence[str] = tuple(words.TITLE_BRANDS), garbage: Sequence[str] = tuple(words.GENERIC_MINED_TOKENS)) -> Column:
    """Known brand anywhere, else a plausible head token (2-15 characters, no year, no hex code, not garbage)."""
    token = tx.rx(title, r"^([一-鿿A-Za-z0-9·]+)")
    ok = F.length(token).between(2, 15) & ~token.rlike(r"^\d{4}") & ~token.rlike(r"^[A-F0-9]{6,}") & ~token.isin(*garbage)
    return F.coalesce(tags.longest_term(title, list(brands)), F.when(ok, token))


def prefix_text(title) -> Column:
    """Title without leading 【…】 tags, year and campaign prefixes."""
    t = F.regexp_replace(tx.strip(F.coalesce(tx.col(title), F.lit(""))), r"^(【[^】]{0,18}】\s*)+", "")
    t = tx.strip(F.regexp_replace(t, r"(?U)\s+", " "))
    t = tx.strip(F.regexp_replace(t, rf"^(?:(?:{'|'.join(words.FILL_STRIP_PREFIXES)})\s*)+", ""))
    return tx.strip(F.regexp_replace(t, "^年", ""))


def fill_brand(title, aliases: Sequence[tuple[str, str]] = tuple(words.REMAINING_ALIASES)) -> Column:
    """Last brand filling with an audit trail: ``struct(action, brand)``."""
    t = F.coalesce(tx.col(title), F.lit(""))

    def candidate(p: Column) -> Column:
        latin = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9&'.-]{1,18})", 1)
        mixed = F.substring(F.regexp_extract(p, r"^([一-鿿A-Za-z0-9]{2,8})", 1), 1, 6)
        return F.struct(p.alias("p"), F.when(latin != "", latin).otherwise(mixed).alias("c"))

    def decide(x: Column) -> Column:
        generic = tx.contains_any(F.concat_ws(" ", x["c"], x["p"]), words.GENERIC_FILL_TERMS)
        return F.struct(
            F.when(x["c"] == "", "skip_empty").when(generic, "skip_generic").otherwise("updated_prefix").alias("action"), x["c"].alias("brand")
        )

    known = tx.let(F.lower(t), lambda low: _alias(low, aliases))
    by_prefix = tx.let(tx.let(prefix_text(t), candidate), decide)
    return tx.let(known, lambda k: F.when(k.isNotNull(), F.struct(F.lit("updated_alias").alias("action"), k.alias("brand"))).otherwise(by_prefix))


def dirty_brand(brand) -> Column:
    return tx.contains_any(brand, words.DIRTY_BRAND_MARKS)


def fill_unknown_brands(df: DataFrame, title: str = "title", brand: str = "brand") -> DataFrame:
    """Audit table of the rows whose brand is unknown."""
    rows = df.where(tx.strip(F.coalesce(F.col(brand), F.lit(""))).isin("", words.UNKNOWN_BRAND) | dirty_brand(brand))
    filled = rows.withColumn("_f", fill_brand(title))
    return filled.select("*", F.col("_f.action").alias("action"), F.col("_f.brand").alias("filled_brand")).drop("_f")


# --- categories and tags ------------------------------------------------------
def infer_category(titles: DataFrame, df: DataFrame, key: str, title: str, tokens: str = "keywords", min_length: int = 2) -> DataFrame:
    """Category of a title: longest contained category name, else best summed length of contained tokens.

    Token lists come from every row of a category, not from a sample of them.
    """
    cats = df.select(F.col("category")).where(F.col("category") != "").distinct()
    direct = longest_contained(titles, key, title, cats, "category", "direct")
    vocab = df.select("category", F.explode(tokens).alias("token")).unionByName(cats.select("category", F.col("category").alias("token")))
    vocab = vocab.where(F.length("token") >= min_length).distinct()
    pairs = contained_pairs(titles, key, title, vocab.select("token").distinct(), "token")
    scores = pairs.join(vocab, "token").groupBy(key, "category").agg(F.sum(F.length("token")).alias("score"))
    scored = scores.groupBy(key).agg(F.min_by("category", F.struct(-F.col("score"), F.col("category"))).alias("scored"))
    out = titles.select(key).join(direct, key, "left").join(scored, key, "left")
    method = F.when(F.col("direct").isNotNull(), "name").when(F.col("scored").isNotNull(), "tokens").otherwise("none")
    return out.select(key, F.coalesce("direct", "scored", F.lit("")).alias("category"), method.alias("method"))


def infer_tags(titles: DataFrame, df: DataFrame, key: str, title: str, column: str, k: int = 3) -> DataFrame:
    """The ``k`` longest contained values of a multi-valued corpus column."""
    from shelfwise.operators.dedupe import top_per_group

    vocab = df.select(F.explode(F.split(column, ";")).alias("v")).select(F.trim("v").alias("v")).where(F.col("v") != "").distinct()
    pairs = contained_pairs(titles, key, title, vocab, "v")
    best = top_per_group(pairs, [key], [F.length("v").desc(), F.col("v").asc()], k, "rank")
    joined = F.transform(F.sort_array(F.collect_list(F.struct("rank", "v"))), lambda x: x["v"])
    return best.groupBy(key).agg(F.array_join(joined, ";").alias("tags"))


# --- the whole structuring job ------------------------------------------------
def structure_titles(df: DataFrame, key: str = "sku", title: str = "title", brand: str = "brand", weight: str | None = "weight_g", extra: Sequence[str] = (), aliases: DataFrame | None = None) -> DataFrame:
    """All title-derived columns and their agreement with the given brand and weight."""
    base = _named_brand(df.withColumn("_name", tx.normalize_text(title)), brand, aliases)
    out = (
        base.withColumn("_w", weight_structured("_name", normalized=True))
        .withColumn("flavor_tags", tags.flavor_tags("_name"))
        .withColumn("package_tags", tags.package_tags("_name"))
        .withColumn("specification_tags", tags.specification("_name"))
        .withColumn("gift", tags.is_gift("_name"))
        .withColumn("weight_from_text", F.col("_w.weight_g"))
        .withColumn("weight_note", F.col("_w.note"))
    )
    # a column of its own: its status asks for it again and again
    out = out.withColumn("_seen", tx.clean_brand(tx.normalize_text("brand_from_name"), separators="any", strip_suffix=True))
    given = F.col(weight).try_cast("double") if weight else F.lit(None).cast("double")
    out = (
        out.withColumn("keywords", tags.keyword_tags("_name", ["brand_from_name", F.array_join("flavor_tags", ";"), F.array_join("package_tags", ";"), *extra], normalized=True))
        .withColumn("brand_match_status", tags.brand_status("_own_brand", "_seen"))
        .withColumn("weight_match_status", tags.weight_status(given, "weight_from_text"))
    )
    return out.withColumn(
        "extraction_notes", tags.structure_notes("brand_match_status", "weight_match_status", "flavor_tags", "package_tags", "weight_note")
    ).drop("_w", "_name", "_own_brand", "_seen")


def extraction_report(df: DataFrame) -> DataFrame:
    """Success rates of a structured table as rows."""
    checks = {
        "brand": F.length("brand_from_name") > 0,
        "flavor": F.size("flavor_tags") > 0,
        "weight": F.col("weight_from_text").isNotNull(),
        "package": F.size("package_tags") > 0,
        "gift": F.col("gift"),
        "brand_mismatch": F.col("brand_match_status") == "mismatch",
        "weight_mismatch": F.col("weight_match_status") == "mismatch",
        "weight_fillable": F.col("weight_match_status") == "filled_from_text",
    }
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n"), F.try_divide(F.col(n), F.col("_n")).alias("rate")) for n in checks])
    return wide.select(F.inline(pairs))
