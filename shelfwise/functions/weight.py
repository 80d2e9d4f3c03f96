"""Net weight in grams from a product title, in five named modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import words
from shelfwise.functions.text import col, let, normalize_text, rx, rx_number, strip

NUM = r"(\d+(?:\.\d+)?)"
KILO = "公斤|千克|kg"
GRAM = "g|克"
UNIT = f"({KILO}|斤|{GRAM})"


def _factor(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("kg", "公斤", "千克"), 1000.0).when(u == "斤", 500.0).when(u.isNotNull(), 1.0)


def weight_first(title) -> Column:
    """First ``g``/``kg`` quantity."""
    p = rf"(?i){NUM}\s*(kg|千克|公斤|g|克)"
    # one scan finds the phrase, the short phrase gives number and unit
    return let(F.regexp_extract(col(title), p, 0), lambda m: rx_number(m, p, 1) * _factor(rx(m, p, 2)))


def weight_multi(title) -> Column:
    """``g x n`` and ``kg x n`` before single quantities."""
    t = F.lower(strip(title))
    times = r"\s*[*x×]\s*(\d+)"
    grams, kilos = rf"{NUM}\s*(?:g|克)", rf"{NUM}\s*(?:kg|千克|公斤)"
    return F.coalesce(
        rx_number(t, grams + times, 1) * rx_number(t, grams + times, 2),
        rx_number(t, kilos + times, 1) * 1000 * rx_number(t, kilos + times, 2),
        rx_number(t, kilos) * 1000,
        rx_number(t, grams),
    )


def weight_strict(title) -> Column:
    """Certain weights only: ranges and pure count units give NULL; a bare 3-5 digit number is the last resort."""
    t = strip(title)
    ranged = t.rlike(rf"(?i)\d+(?:\.\d+)?\s*(?:-|~|～|至|到)\s*\d+(?:\.\d+)?\s*(?:{KILO}|斤|{GRAM})")
    explicit = F.coalesce(
        rx_number(t, rf"(?i){NUM}\s*(?:{GRAM})"),
        rx_number(t, rf"(?i){NUM}\s*(?:{KILO})") * 1000,
        rx_number(t, rf"{NUM}\s*斤") * 500,
    )
    bare = F.when(~t.rlike("箱|颗|粒|包"), rx_number(t, r"(?<!\d)(\d{3,5})(?!\d)"))
    return F.when(~ranged, F.coalesce(explicit, bare))


def _quantity(m: Column) -> Column:
    """Grams of a short text that holds one number and one unit."""
    return rx_number(m, NUM) * _factor(rx(m, f"(?i){UNIT}"))


def _from_segment(t: Column) -> Column:
    """``struct(weight_g, note)`` of one text segment, strongest signal first; NULL without a weight.

    Each rule scans the segment once for its phrase; numbers and units are then read off the short phrase.
    """
    box = f"[{words.QUANTITY_WORDS}]"

    def product(m: Column) -> Column:
        # a slash between weight and count is a ratio, not a multiplication
        return F.when(m.rlike("[*xX]"), _quantity(m) * rx_number(m, rf"[*xX]\s*{NUM}"))

    def mean(m: Column) -> Column:
        start, end = F.regexp_extract(m, r"^(.*?)\s*(?:-|~|至|到)", 1), F.regexp_extract(m, r"(?:-|~|至|到)\s*(.*)$", 1)
        unit = _factor(rx(end, f"(?i){UNIT}"))
        return (rx_number(start, NUM) * F.coalesce(_factor(rx(start, f"(?i){UNIT}")), unit) + rx_number(end, NUM) * unit) / 2

    marks = ["共", "合计", "总重", "净重", "重量", "规格", "实发"]
    rules = [
        ("强信号重量", rf"(?i)(?:{'|'.join(marks)})\s*[:：]?\s*({NUM}\s*{UNIT})", 1, _quantity),
        ("倍数重量", rf"(?i)({NUM}\s*{UNIT}\s*(?:\*|x|/)\s*{NUM}\s*{box}?)", 1, product),
        ("反向倍数重量", rf"(?i)({NUM}\s*{box}\s*(?:\*|x)\s*{NUM}\s*{UNIT})", 1, lambda m: rx_number(m, NUM) * _quantity(F.regexp_extract(m, r"[*xX]\s*(.*)$", 1))),
        ("范围重量均值", rf"(?i)({NUM}\s*{UNIT}?\s*(?:-|~|至|到)\s*{NUM}\s*{UNIT})", 1, mean),
        ("普通重量", rf"(?i)({NUM}\s*{UNIT})", 1, _quantity),
    ]

    def found(label: str, pattern: str, group: int, formula) -> Column:
        phrase = F.regexp_extract(t, pattern, group)
        if label == rules[0][0]:
            phrase = F.when(t.rlike(f"[{''.join(m[0] for m in marks)}]"), phrase)
        value = let(phrase, lambda m: F.when(m != "", formula(m)))
        return let(value, lambda v: F.when(v.isNotNull(), F.struct(F.round(v, 2).alias("weight_g"), F.lit(label).alias("note"))))

    return F.coalesce(*[found(*r) for r in rules])


def weight_structured(title, normalized: bool = False) -> Column:
    """Bracketed weights first, then the whole title: ``struct(weight_g, note)``."""

    def of(t: Column) -> Column:
        inner = F.filter(F.regexp_extract_all(t, F.lit(r"[\(\[【](.*?)[\)\]】]"), F.lit(1)), lambda s: s.rlike(r"\d"))
        hits = F.array_compact(F.transform(inner, lambda s: _from_segment(strip(s))))
        marked = F.transform(hits, lambda h: F.struct(h["weight_g"].alias("weight_g"), F.concat(F.lit("括号优先-"), h["note"]).alias("note")))
        none = F.struct(F.lit(None).cast("double").alias("weight_g"), F.lit("未识别重量").alias("note"))
        return F.coalesce(F.try_element_at(marked, F.lit(1)), F.when(t.rlike(r"\d"), _from_segment(t)), none)

    return of(col(title)) if normalized and isinstance(title, str) else let(col(title) if normalized else normalize_text(title), of)


def weight_fallback(title, structured: Column | None = None) -> Column:
    """Structured mode, then the plain first quantity including 斤; ``structured`` is that weight if it is known already."""
    p = rf"(?i){NUM}\s*{UNIT}"
    known = weight_structured(title)["weight_g"] if structured is None else structured
    return F.coalesce(known, rx_number(title, p, 1) * _factor(rx(title, p, 2)))


MODES = {
    "first": weight_first,
    "multi": weight_multi,
    "strict": weight_strict,
    "structured": lambda t: weight_structured(t)["weight_g"],
    "fallback": weight_fallback,
}


def weight_grams(title, mode: str = "structured") -> Column:
    return MODES[mode](title)
