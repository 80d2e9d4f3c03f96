"""Dated blocks of price texts, read column by column in Arrow batches.

A handful of patterns per block costs Spark's own expressions most of their time inside lambdas, which are interpreted;
Arrow's kernels run the same patterns over all blocks of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfwise.functions import words
from shelfwise.functions.pagetext import either
from shelfwise.functions.text import BLANKS

_DAY = "20[0-9]{2}[.\\-/年][0-9]{1,2}[.\\-/月][0-9]"
_DAY_PARTS = "^(?P<y>20[0-9]{2})[.\\-/年](?P<m>[0-9]{1,2})[.\\-/月](?P<d>[0-9]{1,2})"
_NUMBER = "[0-9]+(?:\\.[0-9]+)?"
_SIGNS, _UNIT = "¥￥", "元"
_GAP = f"[：:{BLANKS}]*"
_LEADING = f"[{_SIGNS}][{BLANKS}]*(?P<signed>{_NUMBER})|(?P<worded>{_NUMBER})[{BLANKS}]*{_UNIT}"

_CLAUSE, _LABEL, _WORD = "[^，。;\n]", f"{words.COUPON_LABEL}{_GAP}", either(words.COUPON_WORDS)
#: A coupon's clause: anything behind the label, or a coupon word and a digit in front of it or behind.
_TOLD = f"{_LABEL}{_CLAUSE}+|[0-9]+{_WORD}{_CLAUSE}*|{_WORD}[^，。;\n0-9]*[0-9]{_CLAUSE}*"
_UNTOLD = f"{_WORD}[^，。;\n0-9]+"


def _found(texts: pa.Array, pattern: str, *groups: str) -> list[pa.Array]:
    """Named groups of the first match; NULL where a text or a group has none."""
    hit = pc.extract_regex(texts, pattern=pattern)
    return [pc.if_else(pc.not_equal(g, ""), g, None) for g in (pc.struct_field(hit, name) for name in groups)]


def _where(mask: pa.Array, texts: pa.Array, read) -> pa.Array:
    """``read`` of the texts the mask holds for, NULL for the others."""
    at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
    back = np.full(len(texts), -1)
    back[at] = np.arange(len(at))
    return read(texts.take(pa.array(at))).take(pa.array(back, mask=back < 0))


def _priced(blocks: pa.Array, labels) -> pa.Array:
    """The amount behind one of the labels."""
    return _found(blocks, f"{either(labels)}{_GAP}[{_SIGNS}]?[{BLANKS}]*(?P<n>{_NUMBER})", "n")[0].cast("float64")


def _leading(blocks: pa.Array) -> pa.Array:
    """The first amount behind a currency sign or in front of the unit."""
    return pc.coalesce(*_found(blocks, _LEADING, "signed", "worded")).cast("float64")


def _days(blocks: pa.Array) -> pa.Array:
    """Dates the blocks start with; NULL where the calendar has no such day."""
    y, m, d = (p.cast("int32").fill_null(0).to_numpy(zero_copy_only=False) for p in _found(blocks, _DAY_PARTS, "y", "m", "d"))
    month = ((y.astype("int64") - 1970) * 12 + np.clip(m, 1, 12) - 1).astype("datetime64[M]")
    day = month.astype("datetime64[D]") + (d - 1)
    real = (m >= 1) & (m <= 12) & (day.astype("datetime64[M]") == month)
    return pa.array(day, mask=~real)


def _lines(texts: pa.Array) -> pa.Array:
    """Lines without blanks at their ends, runs of blanks and empty lines."""
    t = pc.replace_substring_regex(texts, f"[{BLANKS.replace(chr(10), '')}]+", " ")
    return pc.ascii_trim(pc.replace_substring_regex(t, " ?\n[ \n]*", "\n"), " \n")


def coupons(blocks: pa.Array) -> pa.Array:
    """The clause around the leftmost coupon word of a block; ``''`` without one.

    It starts at the word, with a number right in front of it, and must hold a digit. Behind the label any wording counts, and the label goes.
    """
    # behind its label a coupon may lie in a later line
    b = pc.coalesce(_where(pc.match_substring(blocks, words.COUPON_LABEL), blocks, _lines), blocks)
    told, untold = _found(b, f"(?P<told>{_TOLD})|(?P<untold>{_UNTOLD})", "told", "untold")
    # what lies in a clause without a digit is no coupon either
    later = lambda x: _found(pc.replace_substring_regex(x, f"({_TOLD})|{_UNTOLD}", "\\1"), f"(?P<told>{_TOLD})", "told")[0]
    told = pc.coalesce(told, _where(pc.is_valid(untold), b, later))
    told = pc.replace_substring_regex(pc.replace_substring_regex(told, f"^{_LABEL}", ""), f"[{BLANKS}]+", " ")
    return pc.ascii_trim(told, " ").fill_null("")


def _dated_blocks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts cut in front of every date: text number, ordinal in it, block. What lies before the first date is left out."""
    mark = "\x00"
    while pc.any(pc.match_substring(texts, mark)).as_py():
        mark += "\x01"
    marked = pc.replace_substring_regex(texts, _DAY, f"{mark}\\0")
    # the day of a date may begin another one
    glued = f"({_DAY.removesuffix('[0-9]')})({_DAY})"
    if pc.any(pc.match_substring_regex(texts, glued)).as_py():
        marked = pc.replace_substring_regex(marked, glued, f"\\1{mark}\\2")
    pieces = pc.split_pattern(marked, mark)
    text = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    ordinal = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text)))) - 1
    dated = np.flatnonzero(ordinal >= 0)
    return text[dated], ordinal[dated], pc.list_flatten(pieces).take(pa.array(dated))


def details(texts: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Text number of every distinct dated price, and its columns."""
    text, ordinal, blocks = _dated_blocks(texts.fill_null(""))

    def keep(at: np.ndarray, *columns):
        return [c[at] if isinstance(c, np.ndarray) else c.take(pa.array(at)) for c in columns]

    price = _priced(blocks, words.FINAL_PRICE_LABELS)
    price = pc.coalesce(price, _where(pc.is_null(price), blocks, _leading))
    text, ordinal, blocks, price = keep(np.flatnonzero(price.is_valid().to_numpy(zero_copy_only=False)), text, ordinal, blocks, price)
    day = _days(blocks)
    text, ordinal, blocks, price, day = keep(np.flatnonzero(day.is_valid().to_numpy(zero_copy_only=False)), text, ordinal, blocks, price, day)
    out = {"date": day, "final_price": price, "page_price": _priced(blocks, words.PAGE_PRICE_LABELS), "coupon": coupons(blocks), "ordinal": pa.array(ordinal, "int32")}
    # only a text that has a date twice can repeat a row
    dated = text.astype("int64") * 2**20 + day.cast("int32").to_numpy(zero_copy_only=False)
    if len(np.unique(dated)) < len(dated):
        ids = pa.table({"text": text, **{c: out[c] for c in ("date", "final_price", "page_price", "coupon")}, "at": np.arange(len(text))})
        at = np.sort(ids.group_by(["text", "date", "final_price", "page_price", "coupon"]).aggregate([("at", "min")])["at_min"].to_numpy())
        text, *columns = keep(at, text, *out.values())
        out = dict(zip(out, columns))
    return text, out
