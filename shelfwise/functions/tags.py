"""Tags of a product title: flavours, packages, gift flag, specification, keywords, label rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import words
from shelfwise.functions.text import BLANK, col, contains_any, let, normalize_text, strip

_NUM = words.NUMERAL_CLASS
_TAKEN = ""  # private-use character that marks text already consumed by an earlier pattern


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def contained_terms(text, terms: Sequence[str]) -> Column:
    """Dictionary terms occurring in the text, longest first."""
    ordered = sorted(dict.fromkeys(t for t in terms if t), key=lambda t: (-len(t), terms.index(t)))
    return F.filter(string_array(ordered), lambda w: F.contains(col(text), w))


def longest_term(text, terms: Sequence[str]) -> Column:
    return F.try_element_at(contained_terms(text, terms), F.lit(1))


def flavor_tags(name, terms: Sequence[str] = tuple(words.FLAVOR_WORDS)) -> Column:
    """Contained flavours without those that are part of another contained flavour."""
    return let(contained_terms(name, terms), lambda found: F.filter(found, lambda w: ~F.exists(found, lambda o: (o != w) & F.contains(o, w))))


def first_tags(title, terms: Sequence[str] = tuple(words.TITLE_FLAVOR_WORDS), limit: int = 4) -> Column:
    """Contained terms in dictionary order, at most ``limit`` (the tag column holds that many)."""
    return F.slice(F.filter(string_array(list(dict.fromkeys(terms))), lambda w: F.contains(col(title), w)), 1, limit)


def package_tags(name, patterns: Sequence[tuple[str, str]] = tuple(words.PACKAGE_PATTERNS)) -> Column:
    # joined arrays are compiled, a filter over them would not be
    return F.concat(*[F.when(_any_of(name, p), string_array([label])).otherwise(string_array([])) for label, p in patterns])


def _any_of(text, pattern: str) -> Column:
    """``rlike``; alternatives that are words, or words behind a numeral, are looked for as words first."""
    options = pattern.split("|")
    bare = [o.removeprefix(_NUM) for o in options]
    if not all(re.fullmatch(r"\w+", b) for b in bare):
        return col(text).rlike(pattern)
    hit = contains_any(text, [o for o, b in zip(options, bare) if o == b])
    counted = [b for o, b in zip(options, bare) if o != b]
    # of a numeral, its last character is enough; it is looked for behind the word only, a class of many characters is slow
    word = f"(?:{'|'.join(counted)})"
    found = hit | (contains_any(text, counted) & col(text).rlike(f"{word}(?<={_NUM[:-1]}{word})")) if counted else hit
    return contains_any(text, _common_characters(bare)) & found


def _common_characters(options: Sequence[str]) -> list[str]:
    """A few characters of which every option has one."""
    left, out = list(options), []
    while left:
        out.append(max(dict.fromkeys("".join(left)), key=lambda c: sum(c in o for o in left)))
        left = [o for o in left if out[-1] not in o]
    return out


def is_gift(name, terms: Sequence[str] = tuple(words.GIFT_WORDS)) -> Column:
    return contains_any(name, terms)


def first_label(text, rules: Sequence[tuple[str, Sequence[str] | str]], default: str | None = None) -> Column:
    """Label of the first rule of ``(label, terms)`` with a contained term."""
    out = None
    for label, terms in rules:
        hit = contains_any(text, [terms] if isinstance(terms, str) else terms)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def subcategory(title, rules: Sequence[tuple[str, str]] = tuple(words.SUBCATEGORY_RULES)) -> Column:
    return F.coalesce(first_label(title, [(label, [term]) for term, label in rules]), F.lit(""))


def numeral_value(token) -> Column:
    """Integer value of an Arabic or Chinese numeral token, else NULL."""
    t = col(token)
    digits = F.map_from_arrays(string_array(list(words.NUMERAL_DIGITS)), F.array(*[F.lit(v) for v in words.NUMERAL_DIGITS.values()]))
    units = F.map_from_arrays(string_array(list(words.NUMERAL_UNITS)), F.array(*[F.lit(v) for v in words.NUMERAL_UNITS.values()]))

    def state(total, section, pending):
        as_long = lambda x: x.cast("bigint")
        return F.struct(as_long(total).alias("total"), as_long(section).alias("section"), as_long(pending).alias("pending"))

    def step(acc, ch):
        digit, unit = F.try_element_at(digits, ch), F.try_element_at(units, ch)
        closed = (acc["section"] + acc["pending"]) * unit
        return (
            F.when(digit.isNotNull(), state(acc["total"], acc["section"], digit))
            .when(unit == 10000, state(acc["total"] + closed, F.lit(0), F.lit(0)))
            .when(unit == 100000000, state(F.try_multiply(acc["total"] + acc["section"] + acc["pending"], unit), F.lit(0), F.lit(0)))
            .otherwise(state(acc["total"], acc["section"] + F.greatest(acc["pending"], F.lit(1)) * unit, F.lit(0)))
        )

    folded = F.aggregate(
        F.filter(F.split(t, ""), lambda ch: ch != ""),
        state(F.lit(0), F.lit(0), F.lit(0)),
        step,
        lambda acc: acc["total"] + acc["section"] + acc["pending"],
    )
    han = f"^[{''.join(words.NUMERAL_DIGITS)}{''.join(words.NUMERAL_UNITS)}]+$"
    return F.when(t.rlike(r"^\d+$"), t.try_cast("bigint")).when(t.rlike(han), folded)


def _arabic(spec: Column) -> Column:
    """Rewrite every numeral run of a specification phrase in Arabic digits and drop blanks."""
    runs = F.regexp_extract_all(spec, F.lit(f"({_NUM}|[^0-9一二两三四五六七八九十百千万]+)"), F.lit(1))
    mapped = F.transform(runs, lambda r: F.when(r.rlike(f"^{_NUM}$"), F.coalesce(numeral_value(r).cast("string"), r)).otherwise(r))
    # digits without leading zeros are Arabic already
    told = F.when(spec.rlike(r"[一二两三四五六七八九十百千万]|(?<![0-9])0|[0-9]{19}"), F.array_join(mapped, "")).otherwise(spec)
    return F.regexp_replace(told, f"{BLANK}+", "")


def specification(name) -> Column:
    """Series in brackets (no weight, at most 30 characters) and count phrases, in pattern order.

    Each phrase pattern runs on the text left over by the earlier ones, which gives earlier patterns
    precedence over overlapping later ones.
    """
    t = col(name)
    inner = F.transform(F.regexp_extract_all(t, F.lit(r"[\(\[【](.*?)[\)\]】]"), F.lit(1)), strip)
    series = F.transform(
        F.filter(inner, lambda s: (s != "") & (F.length(s) <= 30) & ~s.rlike("(?i)kg|公斤|千克|斤|g|克")),
        lambda s: F.concat(F.lit("系列:"), s),
    )
    box = f"[{words.QUANTITY_WORDS}]"
    parts, rest = [], t
    none = F.array().cast("array<string>")
    for needed, pattern in (("共款", rf"共\s*{_NUM}\s*款"), ("买送", rf"买\s*{_NUM}\s*送\s*{_NUM}"), ("装", rf"{_NUM}\s*{box}\s*装"), ("", rf"{_NUM}\s*{box}")):
        # a phrase needs its fixed characters; most titles have none of them
        may = F.lit(True)
        for ch in needed:
            may = may & F.contains(t, F.lit(ch))
        parts.append(F.when(may.isNull() | may, F.regexp_extract_all(rest, F.lit(f"({pattern})"), F.lit(1))).otherwise(none))
        rest = F.when(may, F.regexp_replace(rest, pattern, _TAKEN)).otherwise(rest)
    counts = F.filter(F.transform(F.concat(*parts), _arabic), lambda s: s != "")
    # series keep their repetitions, counts are added once
    return let(series, lambda ser: F.concat(ser, F.array_except(counts, ser)))


def char_bigrams(text) -> Column:
    """All overlapping two-character windows, one linear regex pass."""
    return F.regexp_extract_all(col(text), F.lit(r"(?s)(?=(..))"), F.lit(1))


def keyword_tags(name, extra: Sequence = (), stop: Sequence[str] = tuple(words.KEYWORD_STOP_WORDS), vocabulary: Sequence[str] = tuple(words.FLAVOR_WORDS), normalized: bool = False) -> Column:
    """Keywords without a segmenter: latin words, Han bigrams, vocabulary terms and known entities."""

    def found(t: Column) -> Column:
        latin = F.regexp_extract_all(t, F.lit(r"([A-Za-z]{2,})"), F.lit(1))
        han = F.regexp_extract_all(t, F.lit(r"(?=([一-龥]{2}))"), F.lit(1))
        return F.concat(contained_terms(t, vocabulary), latin, han)

    tokens = F.filter(F.array_distinct(let(col(name) if normalized else normalize_text(name), found)), lambda w: ~F.lower(w).isin("kg", "g", "克", "斤"))
    known = F.filter(F.array_compact(F.array(*[strip(col(c)) for c in extra])) if extra else F.array().cast("array<string>"), lambda w: w != "")
    return F.array_except(F.array_distinct(F.concat(tokens, known)), string_array(list(stop)))


def brand_status(row_brand, title_brand) -> Column:
    """Agreement of two cleaned brands."""
    e, a = F.coalesce(col(row_brand), F.lit("")), F.coalesce(col(title_brand), F.lit(""))
    return (
        F.when((e == "") & (a == ""), "missing_both")
        .when(a == "", "missing_extracted")
        .when(e == "", "missing_original")
        .when(F.contains(a, e) | F.contains(e, a), "consistent")
        .otherwise("mismatch")
    )


def weight_status(row_weight, title_weight) -> Column:
    """Agreement of two weights within ``max(1 g, 2 %)``."""
    o, x = col(row_weight), col(title_weight)
    has_o = F.coalesce(o > 0, F.lit(False))
    return (
        F.when(~has_o & x.isNull(), "missing_both")
        .when(~has_o, "filled_from_text")
        .when(x.isNull(), "missing_extracted")
        .when(F.abs(o - x) <= F.greatest(F.lit(1.0), o * 0.02), "consistent")
        .otherwise("mismatch")
    )


def structure_notes(brand_state, weight_state, flavors, packages, weight_note) -> Column:
    b, w = col(brand_state), col(weight_state)
    return F.concat_ws(
        ";",
        F.when(b == "consistent", F.lit("品牌一致")).otherwise(F.concat(F.lit("品牌"), b)),
        F.when(w == "consistent", F.lit("重量一致")).otherwise(F.concat(F.lit("重量"), w)),
        F.concat(F.lit("重量来源:"), col(weight_note)),
        F.when(F.size(col(flavors)) == 0, F.lit("未识别口味")),
        F.when(F.size(col(packages)) == 0, F.lit("未识别包装")),
    )
