"""Fields out of page HTML, visible text, listing cards and review blocks."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import words
from shelfwise.functions.text import BLANK, col, contains_any, let, rx, strip


@F.pandas_udf(T.StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    """HTML entities; Spark has no built-in. Arrow batches, one small string per row."""
    return s.map(html.unescape, na_action="ignore")


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")


@F.pandas_udf(T.StringType())
def unescape_terminated(s: pd.Series) -> pd.Series:
    """HTML entities that end with their semicolon; a reference that is cut off stays as it is."""
    own = lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] in html5 else m[0]
    return s.map(lambda x: _REFERENCE.sub(own, x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Full NFKC folding; `text.compatible` does it character by character without leaving the JVM."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


# --- building blocks: every pattern below is made of these and of word lists ----
NUMBER = r"\d+(?:\.\d+)?"
PERCENT = rf"{NUMBER}%"


def either(options) -> str:
    """Literal alternatives, longer ones first."""
    return "(?:" + "|".join(re.escape(o) for o in sorted(options, key=lambda o: (-len(o), o))) + ")"


def labelled(c, labels, value: str, gap: str = r"\s*[:：]?\s*") -> Column:
    """The value that follows one of the labels, or NULL."""
    found = rx(c, rf"(?i){either(labels)}{gap}({value})")
    # looking for words is cheaper than the pattern; letters would need both cases
    return found if re.search("[a-zA-Z]", "".join(labels)) else F.when(contains_any(c, labels), found)


def ended(c, value: str, endings) -> Column:
    """The value that one of the endings follows, or NULL."""
    return F.when(contains_any(c, endings), rx(c, rf"({value})\s*{either(endings)}"))


def tag_attribute(tag, name: str) -> Column:
    """An attribute of an opening tag, in either kind of quotes."""
    return F.coalesce(rx(tag, rf"(?is)\s{name}\s*=\s*\"([^\"]*)\""), rx(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'"))


def meta_content(html, key: str) -> Column:
    """Content of the first ``meta`` tag whose property or name is ``key``, whatever the order of its attributes."""
    metas = F.regexp_extract_all(col(html), F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    own = F.filter(metas, lambda m: F.lower(F.coalesce(tag_attribute(m, "property"), tag_attribute(m, "name"), F.lit(""))) == key)
    return tag_attribute(F.get(own, F.lit(0)), "content")


def json_field(c, key: str, value: str = r'[^"]*') -> Column:
    """A string field of JSON inside a page."""
    return rx(c, rf'"{key}"\s*:\s*"({value})"')


# --- titles and prices --------------------------------------------------------
def shared_title(c) -> Column:
    """Title quoted in a share text."""
    return strip(F.coalesce(rx(c, "「([^」]+)」"), F.lit("")))


def raw_html_title(c) -> Column:
    return F.coalesce(*[meta_content(c, k) for k in words.PAGE_TITLE_KEYS], json_field(c, "skuName"), rx(c, r"(?is)<title\b[^>]*>(.*?)</title\s*>"), F.lit(""))


def clean_page_title(c) -> Column:
    """Collapse blanks, then drop the site suffix and picture marker."""
    t = strip(F.regexp_replace(col(c), f"{BLANK}+", " "))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[-_]\s*京东.*$", ""), "【图片.*?】", ""))


def html_title(c, terminated: bool = False) -> Column:
    """``terminated`` unescapes only the entities that have their semicolon, else those that browsers accept too."""
    return clean_page_title((unescape_terminated if terminated else unescape_entities)(raw_html_title(c)))


def html_price(c) -> Column:
    """First positive price: the known fields in order, then a currency sign."""
    found = [json_field(c, k, NUMBER) for k in words.PAGE_PRICE_FIELDS] + [rx(c, rf"￥\s*({NUMBER})")]
    numbers = [n.try_cast("double") for n in found]
    return F.coalesce(*[F.when(n > 0, n) for n in numbers])


def spoken_price(c) -> Column:
    """Price in visible text: worded, then currency sign, then 元."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), f"{BLANK}+", " ")
    money = r"[1-9]\d*(?:\.\d{1,2})?"
    found = [labelled(t, words.SPOKEN_PRICE_LABELS, money, r"\D{0,8}"), rx(t, rf"[￥¥]\s*({money})"), ended(t, money, ["元"])]
    return F.coalesce(*[n.try_cast("double") for n in found])


# --- listing cards ------------------------------------------------------------
CARD_PROMO_WORDS = ["首购礼金", "官方直降", "券", "包邮", "已补", "折", "满"]
CARD_SHOP_WORDS = ["旗舰店", "自营", "专营店", "专卖店", "店"]
_AD_LINE, _SOLD = "广告", "已售"


def lines(c) -> Column:
    """Trimmed non-blank lines."""
    # a carriage return in front of the line break is trimmed off; a pattern would be compiled for every row
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), strip), lambda x: x != "")


def _lines(c, own: Column | None) -> Column:
    return lines(c) if own is None else own


def card_prices(c, own: Column | None = None) -> Column:
    """Distinct prices of a card in reading order; a price whose digits stand on several lines is joined. ``own``, here and below: the lines if they are known already."""
    flat = F.array_join(_lines(c, own), "\n")
    found = F.regexp_extract_all(flat, F.lit(r"(?m)^[￥¥]\s*((?:\d+|\.)(?:\n(?:\d+|\.)$|\d|\.)*+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.replace(x, F.lit("\n"), F.lit("")).try_cast("double")), lambda x: x > 0))


def card_sales(c) -> Column:
    """Sales wording with the latin magnitude letter as 万."""
    t = F.coalesce(col(c), F.lit(""))
    for blank in " \n\r\t":
        t = F.replace(t, F.lit(blank), F.lit(""))
    n = r"(\d+(?:\.\d+)?[万千wW]?\+?)"

    def found(t: Column) -> Column:
        return F.coalesce(rx(t, rf"已售{n}"), rx(t, rf"{n}已售出"), rx(t, rf"{n}人已买"))

    # the other blanks are rare
    bare = let(t, lambda t: F.when(t.rlike(r"[\x0b\x0c\x85\xa0]") | t.rlike(r"[\u1680-\u3000]"), F.regexp_replace(t, f"{BLANK}+", "")).otherwise(t))
    return F.coalesce(F.replace(F.replace(let(bare, found), F.lit("w"), F.lit("万")), F.lit("W"), F.lit("万")), F.lit(""))


def card_shop(c, own: Column | None = None) -> Column:
    """Last line that names a shop."""
    return F.coalesce(F.try_element_at(F.filter(_lines(c, own), lambda x: contains_any(x, CARD_SHOP_WORDS)), F.lit(-1)), F.lit(""))


def card_promotions(c, own: Column | None = None) -> Column:
    named = F.array_distinct(F.filter(_lines(c, own), lambda x: contains_any(x, CARD_PROMO_WORDS)))
    return F.when(contains_any(c, CARD_PROMO_WORDS), named).otherwise(F.array().cast("array<string>"))


def card_title(c, own: Column | None = None) -> Column:
    """First line above the price that is no advertisement, sales or promotion line."""
    ls = _lines(c, own)
    flat = F.array_join(ls, "\n")
    above = F.split(F.substring_index(F.substring_index(F.concat(F.lit("\n"), flat), "\n￥", 1), "\n¥", 1), "\n")
    # a price may also follow one of the rare line ends inside of a line
    rare = F.split(F.split(flat, r"(?m)^[￥¥]", 2)[0], "\n")
    above = F.when(contains_any(c, ["\r", "\x85", "\u2028", "\u2029"]), rare).otherwise(above)
    good = F.filter(
        above,
        lambda x: (x != "") & (x != _AD_LINE) & ~F.contains(x, F.lit(_SOLD)) & ~F.startswith(x, F.lit("|")) & ~contains_any(x, CARD_PROMO_WORDS),
    )
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


# --- details ------------------------------------------------------------------
ATTRIBUTE_NAMES = {
    "brand": ["品牌", "品 牌"],
    "product_number": ["商品编号", "货号"],
    "origin": ["产地", "原产地", "生产地", "生产地址"],
    "shelf_life": ["保质期", "质保期"],
    "domestic_or_imported": ["国产/进口", "国产或进口", "进口/国产", "是否进口"],
    "flavor": ["口味", "风味"],
    "packing_list": ["包装清单", "包装内容", "规格"],
}


def joined_lines(c) -> Column:
    """Attribute text as one line."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[|;\n\r]+", " | ")


def attribute(c, names: list[str], max_chars: int | None = None, joined: Column | None = None) -> Column:
    """Value after ``name:`` or ``name ``, first alias that occurs; ``max_chars`` cuts it (the published form has 80)."""
    joined = joined_lines(c) if joined is None else joined
    size = f"{{1,{max_chars}}}" if max_chars else "+"
    picks = []
    for n in names:
        forms = [rx(joined, rf"{n}\s*[:：]\s*([^|;；，,]{size})"), rx(joined, rf"{n}\s+([^|;；，,]{size})")]
        picks.append(F.when(F.contains(joined, F.lit(n)), F.coalesce(*forms)))
    return F.coalesce(strip(F.coalesce(*picks)), F.lit(""))


def effective_detail(raw, fields) -> Column:
    """Detail row with at least one usable field and no recorded error."""
    return ~F.startswith(F.coalesce(col(raw), F.lit("")), F.lit("ERROR:")) & F.exists(F.array(*[strip(F.coalesce(col(f), F.lit(""))) for f in fields]), lambda x: x != "")


def good_rate(c) -> Column:
    """Share of good reviews: after its label, before its ending, near a phrase of praise."""
    return F.coalesce(labelled(c, words.RATE_LABELS, PERCENT), ended(c, PERCENT, words.RATE_ENDINGS), labelled(c, words.RATE_PHRASES, PERCENT, r"[^\d%]{0,20}"), F.lit(""))


def review_tags(c, limit: int | None = None) -> Column:
    """Distinct impression tags of a review header: the listed ones, then short lines of judgement; ``limit`` keeps the first."""
    listed = F.split(F.coalesce(labelled(c, words.REVIEW_TAG_LABELS, r"[^\n]+", r"\s*[:：]\s*"), F.lit("")), r"[|/、,，;；\s]+")
    short = F.filter(lines(c), lambda x: (F.length(x) <= 30) & contains_any(x, words.REVIEW_TAG_WORDS))
    bare = F.transform(short, lambda x: strip(F.regexp_replace(x, r"\(\d+\)", "")))
    tags = F.array_distinct(F.filter(F.concat(listed, bare), lambda x: F.length(x).between(2, 30) & ~x.isin(*words.REVIEW_TABS) & ~x.rlike(r"^\d+万?\+?$")))
    return F.slice(tags, 1, limit) if limit else tags


# --- reviews ------------------------------------------------------------------
_DAY = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"


def iso_date(c) -> Column:
    """First day written with dashes, dots, slashes or 年月日."""
    day = F.concat_ws("-", rx(c, _DAY, 1), F.lpad(rx(c, _DAY, 2), 2, "0"), F.lpad(rx(c, _DAY, 3), 2, "0"))
    return F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


def review_score(c) -> Column:
    """Stars 1-5 of a review block, explicit marks before wording."""
    t = F.coalesce(col(c), F.lit(""))
    marks = [labelled(t, words.SCORE_LABELS, "[1-5]"), ended(t, "[1-5]", ["星"]), *(rx(t, rf"(?i){css}([1-5])") for css in (r"star[_-]?(?:level[_-]?)?", r"rate[_-]?"))]
    worded = None
    for stars, terms in words.SCORE_WORDS:
        hit = contains_any(t, terms)
        worded = F.when(hit, stars) if worded is None else worded.when(hit, stars)
    return F.coalesce(*[m.try_cast("int") for m in marks], worded)


def like_count(c) -> Column:
    return F.coalesce(labelled(c, words.LIKE_LABELS, r"\d+").try_cast("int"), ended(c, r"\d+", words.LIKE_ENDINGS).try_cast("int"), F.lit(0))


def review_content(block) -> Column:
    """Longest line of a block that is neither noise nor a date, without its score and like marks."""
    useful = F.filter(lines(block), lambda x: (F.length(x) >= 3) & ~contains_any(x, words.REVIEW_NOISE_WORDS) & ~x.rlike(_DAY) & ~x.rlike(r"^[1-5]\s*星$"))
    bare = F.transform(
        useful,
        lambda x: strip(F.regexp_replace(F.regexp_replace(x, rf"{either(words.SCORE_LABELS[:2])}\s*[:：]?\s*[1-5]", ""), rf"(?i){either(words.LIKE_LABELS)}\s*[:：]?\s*\d+", "")),
    )
    ranked = F.transform(F.filter(bare, lambda x: F.length(x) >= 4), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("line")))
    return F.coalesce(F.array_max(ranked)["line"], F.lit(""))


def strip_jsonp(c) -> Column:
    t = strip(F.coalesce(col(c), F.lit("")))
    return F.coalesce(rx(t, r"(?s)^[\w$]+\((.*)\)\s*;?\s*$"), t)


def is_negative(score, content, min_chars: int = 10) -> Column:
    """At most two stars (or the mark ``1-2``) with a text longer than ``min_chars``."""
    s = col(score).cast("string")
    return F.coalesce(s.isin("1", "2", "1-2"), F.lit(False)) & (F.length(F.coalesce(col(content), F.lit(""))) > min_chars)


def tag_free(html) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(col(html), F.lit("")), "(?s)<[^>]*>", " "), r"\s+", " "))
