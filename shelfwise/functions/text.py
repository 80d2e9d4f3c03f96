"""Scalar cleaning of dirty listing text, as Spark column expressions.

Everything here is ``Column -> Column`` and stays in the JVM.  Casts are ``try_cast`` so that a dirty
cell yields NULL under ANSI mode instead of failing a job.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import words

#: All Unicode white space: what ``(?U)\\s`` matches, without its cost per character.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _compatibility_forms() -> dict[str, str]:
    """Characters of the basic plane that NFKC replaces, by themselves, with another text."""
    points = (c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000)
    return {chr(c): form for c in points if (form := unicodedata.normalize("NFKC", chr(c))) != chr(c)}


_FORMS = _compatibility_forms()
SINGLE_FORMS = {c: f for c, f in _FORMS.items() if len(f) == 1}
LONG_FORMS = {c: f for c, f in _FORMS.items() if len(f) > 1}


def _ranges(chars: Sequence[str]) -> str:
    """A character class of code point ranges; a range costs the regex engine as much as a single character."""
    points = sorted(map(ord, chars))
    runs = [[points[0], points[0]]]
    for p in points[1:]:
        if p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


LONG_CLASS = _ranges(list(LONG_FORMS))
_DEAL = 128
_DEALT_FORMS = json.dumps([{c: f for c, f in LONG_FORMS.items() if ord(c) % _DEAL == i} for i in range(_DEAL)])


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_per_id(items, last: bool = False) -> Column:
    """Of an array of structs ``(id, at, ...)``, the one with the smallest (``last``: greatest) ``at`` per ``id``, inside the row."""
    step = 1 if last else -1
    return let(F.sort_array(items), lambda a: F.filter(a, lambda x, i: ~F.coalesce(F.get(a, i + step)["id"].eqNullSafe(x["id"]), F.lit(False))))


# --- regex helpers ------------------------------------------------------------
def rx(c, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; NULL (not ``''``) when there is none."""
    # nullif would scan the text twice wherever Spark writes its argument out: in lambdas and in later branches
    return let(F.regexp_extract(col(c), pattern, group), lambda m: F.when(m != "", m))


def rx_number(c, pattern: str, group: int = 1) -> Column:
    # an absent match is '' and casts to NULL
    return F.regexp_extract(col(c), pattern, group).try_cast("double")


def contains_any(c, terms: Sequence[str]) -> Column:
    """True when any literal term occurs; NULL text counts as false, an empty term never matches."""
    # a term with another one inside adds nothing
    hits = [F.contains(col(c), F.lit(t)) for t in dict.fromkeys(terms) if t and not any(o and o != t and o in t for o in terms)]
    if not hits:
        return F.lit(False)
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


# --- text and blanks ----------------------------------------------------------
def strip(c) -> Column:
    return F.trim(col(c), F.lit(BLANKS))


def clean_text(c, collapse: bool = False) -> Column:
    """Trim all Unicode white space; NULL and the word ``nan`` become ``''``."""
    t = F.regexp_replace(col(c), f"{BLANK}+", " ") if collapse else col(c)
    return let(strip(F.coalesce(t, F.lit(""))), lambda t: F.when(F.lower(t) == "nan", "").otherwise(t))


def nonempty(c) -> Column:
    t = F.lower(strip(F.coalesce(col(c).cast("string"), F.lit(""))))
    return ~t.isin("", *words.NULL_WORDS)


def none_if_blank(c) -> Column:
    return F.when(nonempty(c), col(c))


def merge_first(left, right) -> Column:
    """Keep ``left`` unless blank."""
    return F.when(nonempty(left), col(left)).otherwise(col(right))


def merge_prefer_right(left, right) -> Column:
    """Take ``right`` unless blank."""
    return F.when(nonempty(right), col(right)).otherwise(col(left))


def compatible(c) -> Column:
    """NFKC character by character, inside the JVM: width forms, units, circled numbers, fractions, ligatures.

    Combining marks are not composed with their letters; :func:`.pagetext.nfkc` does that in Arrow batches.
    """
    t = F.translate(col(c), "".join(SINGLE_FORMS), "".join(SINGLE_FORMS.values()))
    # most titles are ASCII but for their brackets, and lengths cost less than a pattern
    bare = F.replace(F.replace(col(c), F.lit("【")), F.lit("】"))
    plain = (F.length(bare) == F.octet_length(bare)) | ~col(c).rlike(r"[^\x00-\x7f\u3001-\u3029\u4e00-\u9fff]")
    # a map of many entries is searched from its start, so it is dealt into small ones by code point
    forms = F.from_json(F.lit(_DEALT_FORMS), "array<map<string,string>>")
    form = lambda x: F.try_element_at(F.get(forms, F.ascii(x) % _DEAL), x)
    pieces = F.regexp_extract_all(t, F.lit(f"{LONG_CLASS}|[^{LONG_CLASS[1:]}+"), F.lit(0))
    spread = F.transform(pieces, lambda x: F.coalesce(F.when(F.length(x) == 1, form(x)), x))
    return F.when(plain, col(c)).when(col(c).rlike(LONG_CLASS), F.array_join(spread, "")).otherwise(t)


#: Texts of printable ASCII, Han and their punctuation only. One range per class: unions of ranges cost several calls a character.
_PLAIN = r"^(?:[ -~]++|[\u4e00-\u9fff]++|[\u3002-\u3029]++)*+\z"


def normalize_text(c) -> Column:
    """Fold compatibility forms, unify the multiplication sign, list punctuation to blanks, collapse blanks."""

    def fold(t: Column) -> Column:
        t = let(F.coalesce(t, F.lit("")), compatible)
        t = _where_any(t, "×X", lambda t: F.translate(t, "×X", "xx"))
        t = _where_any(t, "，、；;", lambda t: F.regexp_replace(t, "[，、；;]+", " "))
        return strip(_where_any(t, ["  ", *BLANKS.replace(" ", "")], lambda t: F.regexp_replace(t, f"{BLANK}+", " ")))

    def of(t: Column) -> Column:
        # most titles need no change; the pattern's depth follows the text, so long ones are not tried
        plain = (F.length(t) < 500) & ~contains_any(t, ["X", ";", "  "]) & t.rlike(_PLAIN)
        return F.when(plain, strip(t)).otherwise(fold(t))

    # a column needs no binding, and outside of a lambda the common way is compiled
    return of(F.col(c)) if isinstance(c, str) else let(c, of)


def _where_any(t: Column, terms: Sequence[str], change) -> Column:
    """``change`` applied to texts that hold one of the terms; looking for them costs less than a pattern."""
    return let(t, lambda x: F.when(contains_any(x, list(terms)), change(x)).otherwise(x))


# --- numbers ------------------------------------------------------------------
def first_number(c, signed: bool = False) -> Column:
    """First decimal number in a text after dropping thousands commas, currency signs and blanks at the edges."""
    t = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"[,¥￥$]", "")
    return rx_number(t, r"([-+]?\d+(?:\.\d+)?)" if signed else r"(\d+(?:\.\d+)?)")


def magnitude(c, null_as: float | None = 0.0, units: Sequence[tuple[str, float]] = (("亿", 1e8), ("[万wW]", 1e4), ("千", 1e3))) -> Column:
    """Count with a magnitude word: ``1.5万+`` is 15000.  The first unit of the list that occurs wins."""
    t = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), ",", "")
    factor = F.lit(1.0)
    for pattern, value in reversed(list(units)):
        factor = F.when(t.rlike(pattern), F.lit(value)).otherwise(factor)
    n = rx_number(t, r"(\d+(?:\.\d+)?)") * factor
    return n if null_as is None else F.coalesce(n, F.lit(float(null_as)))


def sales_range(c, mode: str = "reference") -> Column:
    """Sales wording to ``struct(lower, upper, confidence)``.

    ``mode="monotone"`` lifts the upper bound to the lower one; ``"reference"`` keeps the published
    arithmetic, in which ``600+`` has upper bound 500.
    """
    t = F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), ",", "")

    def bounds(t: Column) -> Column:
        n = rx_number(t, r"^(\d+(?:\.\d+)?)\s*[+万千]*$")
        kind = (
            F.when(t.rlike(r"^\d+$"), "exact")
            .when(t.rlike(r"^\d+\+$"), "plus")
            .when(t.rlike(r"^\d+(?:\.\d+)?\s*万\+?$"), "wan")
            .when(t.rlike(r"^\d+(?:\.\d+)?\s*千\+?$"), "qian")
            .when(t == "", "blank")
            .otherwise("other")
        )
        return let(F.struct(kind.alias("k"), n.alias("n")), _sales_bounds)

    def _sales_bounds(x: Column) -> Column:
        k, n = x["k"], x["n"]
        lower = F.when(k.isin("exact", "plus"), n).when(k == "wan", n * 10000).when(k == "qian", n * 1000)
        upper = (
            F.when(k == "exact", n)
            .when((k == "plus") & (n < 1000), F.least(n * 5, F.lit(500.0)))
            .when((k == "plus") & (n < 10000), n * 2)
            .otherwise(lower * 5)
        )
        if mode == "monotone":
            upper = F.greatest(upper, lower)
        confidence = (
            F.when(k == "exact", F.lit("high"))
            .when(k.isin("wan", "qian") | ((k == "plus") & (n >= 1000)), F.lit("medium"))
            .when(k != "blank", F.lit("low"))
        )
        return F.struct(lower.alias("lower"), upper.alias("upper"), confidence.alias("confidence"))

    return let(t, bounds)


# --- keys ---------------------------------------------------------------------
def normalize_key(c, mode: str = "plain", url=None) -> Column:
    """Product key as text: scientific notation and ``.0`` undone.

    ``plain`` keeps other text, ``longest_run`` keeps its longest digit run; with ``url`` a blank key falls
    back to the number in a product page address.  Blank keys are ``''``.
    """
    def key_of(t: Column) -> Column:
        sci = F.coalesce(t.try_cast("decimal(38,0)").cast("string"), t)
        rest = t
        if mode == "longest_run":
            runs = F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1))
            # longest run, the earliest one on ties
            ranked = F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("at"), r.alias("run")))
            rest = F.coalesce(F.array_max(ranked)["run"], t)
        return (
            F.when(F.lower(t) == "none", F.lit(""))
            .when(t.rlike(r"(?i)\d(\.\d+)?e[+-]?\d+"), sci)
            .when(t.rlike(r"^\d+\.0+$"), F.regexp_replace(t, r"\.0+$", ""))
            .otherwise(rest)
        )

    # digits, with or without their .0, are told by one pattern
    t = strip(col(c).cast("string"))
    key = let(F.regexp_extract(t, r"^(\d+)(?:\.0+)?\z", 1), lambda n: F.when(n != "", n).otherwise(let(clean_text(t), key_of)))
    if url is not None:
        key = let(key, lambda k: F.when(k != "", k).otherwise(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"item\.jd\.com/(\d+)\.html", 1)))
    return key


# --- brands and categories ----------------------------------------------------
#: What stands in front of the first separator; a split would compile its pattern for every row.
_HEADS = {"dash": r"^[^-－—–]*", "any": r"^[^-—–|/]*"}
_SHOP_SUFFIXES = ["旗舰店", "官方", "自营", "专营店", "食品", "零食", "坚果炒货"]


def _without_suffix(t: Column) -> Column:
    out = t
    for s in _SHOP_SUFFIXES:
        out = F.when(F.endswith(t, F.lit(s)), strip(F.substring(t, F.lit(1), F.length(t) - len(s)))).otherwise(out)
    return out


def clean_brand(c, separators: str = "spaced", strip_suffix: bool = False, unknown: str | None = None) -> Column:
    """Brand in front of the separator; optionally without a shop suffix."""
    t = clean_text(c)
    head = strip(F.substring_index(t, " - ", 1) if separators == "spaced" else F.regexp_extract(t, _HEADS[separators], 0))
    if strip_suffix:
        head = let(head, _without_suffix)
    if unknown is not None:
        head = F.when(t == "", F.lit(unknown)).when(head == "", t).otherwise(head)
    return head


def split_pair(c) -> tuple[Column, Column]:
    """``brand - category`` to its two parts; the second is ``''`` when absent."""
    parts = F.split(clean_text(c), " - ", 2)
    return strip(parts[0]), strip(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))


def clean_category(c) -> Column:
    """Blank out labels of ranking pages."""
    t = clean_text(c)
    return F.when(t.rlike("榜|全部|主体-"), F.lit("")).otherwise(t)


def category_levels(path, align: str = "right") -> Column:
    """``A > B > C`` to ``struct(level1, level2, level3)``.

    ``right`` fills from the leaf and drops ranking pages, ``left`` fills from the root.
    """
    p = F.coalesce(col(path), F.lit(""))
    parts = F.filter(F.transform(F.split(p, ">" if align == "left" else "[>/]"), strip), lambda x: x != "")
    spots = (1, 2, 3) if align == "left" else (-3, -2, -1)

    def levels(a: Column) -> Column:
        return F.struct(*[F.coalesce(F.try_element_at(a, F.lit(k)), F.lit("")).alias(f"level{i}") for i, k in enumerate(spots, 1)])

    if align == "left":
        return let(parts, levels)

    def unranked(a: Column) -> Column:
        leaf = F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
        ranking = p.rlike("京东排行榜|主体-热卖榜") | leaf.rlike("榜$") | leaf.isin("全部", "综合", "销量")
        return F.when(ranking, F.array().cast("array<string>")).otherwise(a)

    return let(let(parts, unranked), levels)


def category_leaf(path) -> Column:
    return strip(F.element_at(F.split(F.coalesce(col(path), F.lit("")), ">"), -1))


def brand_backfill(explicit: Sequence, brand_category, shop, title, max_chars: int = 12) -> Column:
    """First usable of: explicit columns, ``brand - category``, shop without suffix, title head, unknown."""
    picks = [none_if_blank(strip(c)) for c in explicit]
    picks.append(none_if_blank(split_pair(brand_category)[0]))
    bare_shop = strip(
        F.regexp_replace(
            strip(F.coalesce(col(shop), F.lit(""))),
            r"(京东自营|自营)?(官方)?(旗舰店|专营店|专卖店|自营店|食品店|店铺|店)$",
            "",
        )
    )
    picks.append(F.nullif(F.substring(bare_shop, 1, max_chars), F.lit("")))
    bare_title = F.regexp_replace(strip(F.coalesce(col(title), F.lit(""))), r"^[【\[][^】\]]+[】\]]", "")
    picks.append(F.substring(rx(bare_title, r"^([一-龥A-Za-z0-9()（）]+)"), 1, max_chars))
    return F.coalesce(*picks, F.lit(words.UNKNOWN_BRAND))


# --- promotions ---------------------------------------------------------------
def promo_tokens(c, distinct: bool = True) -> Column:
    parts = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)[|,，\s]+"), lambda x: x != "")
    return F.array_distinct(parts) if distinct else parts


def matches_flag(c, pattern: str) -> Column:
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def has_promotion(c) -> Column:
    t = strip(F.coalesce(col(c), F.lit("")))
    return ~t.isin("", "[]", "nan", "None")


def promotion_kind(c) -> Column:
    """Single promotion class, first rule that matches."""
    out = F.when(~has_promotion(c), F.lit(words.NO_PROMOTION))
    for label, pattern in words.PROMOTION_KINDS:
        out = out.when(col(c).rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(words.OTHER_PROMOTION))


def promotion_keywords(c) -> Column:
    """Distinct promotion classes of a list-valued or delimited promotion cell, in first-seen order."""
    raw = F.when(has_promotion(c), strip(c)).otherwise(F.lit(""))
    listed = raw.rlike(r"^\[.*\]$")
    quoted = F.regexp_extract_all(raw, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
    items = F.when(listed, F.transform(quoted, lambda q: strip(F.regexp_replace(q, r"^['\"]|['\"]$", "")))).otherwise(
        F.split(raw, r"(?U)[,，;；、\s]+")
    )

    def label(item: Column) -> Column:
        out = None
        for name, pattern in words.PROMOTION_KEYWORDS:
            out = F.when(item.rlike(pattern), F.lit(name)) if out is None else out.when(item.rlike(pattern), F.lit(name))
        return out.otherwise(item)

    return F.array_distinct(F.transform(F.filter(items, lambda x: x != ""), label))


def keyword_list(c) -> Column:
    """Keyword cell to an array: JSON list, Python list literal or delimited text."""
    raw = strip(F.coalesce(col(c), F.lit("")))
    parsed = F.coalesce(
        F.from_json(raw, "array<string>"),
        F.when(raw.rlike(r"^\[.*\]$"), F.from_json(F.translate(raw, "'", '"'), "array<string>")),
        F.split(raw, r"(?U)[;,|，\s]+"),
    )
    return F.filter(F.transform(parsed, strip), lambda x: x != "")


def store_type(c) -> Column:
    return F.when(contains_any(c, words.SELF_OPERATED_WORDS), F.lit(words.SELF_OPERATED)).otherwise(F.lit(words.THIRD_PARTY))


# --- prices -------------------------------------------------------------------
def unit_price(price, weight) -> Column:
    """Price per gram; NULL unless both are positive and the quotient is finite."""
    p, w = col(price), col(weight)
    q = F.try_divide(p, w)
    return F.when((p > 0) & (w > 0) & (q < float("inf")), q)


def discount_rate(price, original) -> Column:
    p, o = col(price), col(original)
    return F.when(o > 0, F.greatest(F.coalesce(F.try_divide(o - p, o), F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def band(c, bounds: Sequence[float], labels: Sequence[str], closed: str = "left", null_label: str = words.UNKNOWN_BAND) -> Column:
    """Label of the interval a value falls in; ``closed="left"`` is ``[low, high)``, ``"right"`` is ``(low, high]``."""
    v = col(c)
    out = F.when(v.isNull(), F.lit(null_label))
    for bound, label in zip(bounds, labels):
        out = out.when(v < bound if closed == "left" else v <= bound, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def confidence_label(n) -> Column:
    c = col(n)
    return F.when(c >= 80, F.lit("高")).when(c >= 30, F.lit("中")).when(c >= 10, F.lit("低")).otherwise(F.lit("不足"))


def change_text(field, old_value, new_value, change_type, amount) -> Column:
    """One-line description of a change-log row; old and new values are texts."""
    f, old, new, a = col(field), col(old_value), col(new_value), col(amount)
    share = F.coalesce(F.try_divide(a, old.try_cast("double")) * 100, F.lit(0.0))
    return (
        F.when((f == "price") & (col(change_type) == "down"), F.format_string("价格下调 %.2f (%.1f%%)", F.abs(a), share))
        .when((f == "price") & (col(change_type) == "up"), F.format_string("价格上涨 %.2f (+%.1f%%)", a, share))
        .when(f == "reviews", F.format_string("评论数增长 %.0f", a))
        .when(f == "sales_text", F.concat(F.lit("销量变更: "), old, F.lit(" -> "), new))
        .otherwise(F.concat(f, F.lit(": "), F.coalesce(old, F.lit("")), F.lit(" -> "), new))
    )


def stable_round(c, digits: int = 4) -> Column:
    """Half-up rounding with a small lift, so that equal sums added in another order round alike."""
    scale = float(10**digits)
    return F.floor((col(c) + 1e-7) * scale + 0.5) / scale
