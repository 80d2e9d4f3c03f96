"""Words out of text without blanks: the likeliest path through the lattice of all dictionary words that occur in it.

Spark counts how often every short run of Han characters occurs in the corpus; what is frequent enough is a word with that share as its
probability, and words known beforehand (brands, flavours) are certain. A text's words are the split with the greatest product of probabilities,
found by dynamic programming over the occurrences that the dictionary's automaton reports.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import words as fixed
from shelfwise.functions.tags import string_array
from shelfwise.functions.text import normalize_text, strip
from shelfwise.operators.automaton import Automaton, flat, slices

HAN = "[一-龥]+"
#: A run of letters is a word, up to a length that no word has.
TOKEN = "[一-龥]+|[A-Za-z]{2,60000}"
#: A word of two characters or more makes up a ``COMMON``-th of all characters at least, so there are at most so many per length.
COMMON = 100_000
#: Log probabilities in millionths, as integers: sums are exact and ties are ties.
UNIT = 1_000_000
LENGTH_BITS = 16


def word_counts(df: DataFrame, text: str, max_length: int = 4, min_count: int = 2, common: int = COMMON) -> DataFrame:
    """``word, n, weight``: Han runs of up to ``max_length`` characters that the texts have often enough, single characters always.

    Equal runs are counted before they are cut up, cuts are added up before they are shuffled. Null texts have no runs.
    """
    runs = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(HAN), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    at = runs.select("run", "n", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    cut = at.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(max_length), F.length("run") - F.col("i") + 1)), lambda k: F.substring(F.col("run"), F.col("i"), k))).alias("word"))
    counts = cut.groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.where(F.length("word") == 1).agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(min_count, -(-total // common))
    return counts.where((F.length("word") == 1) | often).withColumn("weight", F.round(UNIT * F.log(F.col("n") / F.lit(max(1, total)))).cast("long"))


def best_path(data: np.ndarray, bounds: np.ndarray, end: np.ndarray, length: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the words on every text's best path, in order, from all edges ``end, length, weight`` of the lattice.

    The weights of a path add up; of equal ones the longer last word wins. All texts take a step together, so there are as many steps as the longest has bytes.
    """
    text = np.searchsorted(bounds, end, "left") - 1
    order = np.argsort(end - bounds[text], kind="stable")
    end, length, weight, text = end[order], length[order], weight[order], text[order]
    local = end - bounds[text]
    steps = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1], [True]])) if len(local) else np.zeros(0, np.int64)
    none = np.iinfo(np.int64).min
    # A place's best weight and the length of its last word, in one number that maxima compare; one more place per text, for its beginning.
    best = np.full(len(data) + len(bounds), none, np.int64)
    best[bounds[:-1] + np.arange(len(bounds) - 1)] = 0
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        to = end[a:b] + text[a:b]
        before = best[to - length[a:b]]
        ok = before != none
        np.maximum.at(best, to[ok], ((before[ok] >> LENGTH_BITS) + weight[a:b][ok] << LENGTH_BITS) + length[a:b][ok])
    place, owner = bounds[1:] + np.arange(len(bounds) - 1), np.arange(len(bounds) - 1)
    first = bounds[:-1] + owner
    begins, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = place > first
    while live.any():
        place, owner, first = place[live], owner[live], first[live]
        n = best[place] & ((1 << LENGTH_BITS) - 1)
        place = place - n
        begins.append(place - owner)
        lengths.append(n)
        live = place > first
    begins, lengths = np.concatenate(begins), np.concatenate(lengths)
    order = np.argsort(begins)
    return begins[order], lengths[order]


def cut(tokens: pa.Array, words: Automaton, weights: np.ndarray, unknown: int) -> tuple[pa.Array, np.ndarray]:
    """The words of every token, and how many each has; tokens that do not begin with a Han character stay whole."""
    data, bounds = flat(tokens)
    lead = data[np.minimum(bounds[:-1], max(len(data) - 1, 0))] if len(data) else np.zeros(len(tokens), np.uint8)
    whole = np.flatnonzero((np.diff(bounds) > 0) & (lead < 0x80))
    end, term = words.occurrences(data, bounds)
    sizes = np.fromiter(words.lengths, np.int64, len(words.lengths))
    single = np.flatnonzero((data & 0xC0) != 0x80)  # every character alone, were it unknown
    single_end = np.append(single[1:], len(data)) if len(single) else single
    many = np.diff(bounds)[whole]
    edges = [
        np.concatenate([end, single_end, bounds[1:][whole]]), np.concatenate([sizes[term], single_end - single, many]),
        np.concatenate([weights[term], np.full(len(single), unknown), np.zeros(len(whole), np.int64)]),
    ]
    begins, lengths = best_path(data, bounds, *edges)
    out = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return out, np.diff(np.searchsorted(begins, bounds))


def _segment(shared: Broadcast):
    @F.arrow_udf("array<string>")
    def run(tokens: pa.Array) -> pa.Array:
        words, weights, unknown = shared.value
        lists = tokens.fill_null([]) if tokens.null_count else tokens
        own = lists.flatten()
        parts = [cut(piece, words, weights, unknown) for piece in slices(own)]
        found = pa.concat_arrays([p for p, _ in parts]).cast(pa.string()) if parts else pa.array([], pa.string())
        upto = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))]) if parts else np.zeros(1, np.int64)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) if len(lists) else np.zeros(1, np.int64)
        return pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), found)

    return run


def segmented(text: Column, counts: DataFrame, known: Sequence[str] = ()) -> Column:
    """The words of a text in order, as an array: Han runs by their best path, runs of Latin letters whole, anything else is no word.

    ``counts`` are those of :func:`word_counts`, whose size has a bound; ``known`` words weigh nothing, so no split of them is likelier. A character that
    the corpus lacks is half as likely as the rarest could be. Null and empty texts have no words.
    """
    rows = {r["word"]: r["weight"] for r in counts.select("word", "weight").collect()}
    rows |= dict.fromkeys((w for w in known if w), 0)
    terms = sorted((w.encode() for w in rows), key=bytes)
    automaton = Automaton(terms)
    automaton.lengths = list(map(len, terms))
    weights = np.array([rows[t.decode()] for t in terms], np.int64)
    unknown = int(weights.min(initial=0)) - round(UNIT * float(np.log(2)))
    shared = counts.sparkSession.sparkContext.broadcast((automaton, weights, unknown))
    return _segment(shared)(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))


def keywords(text: Column, counts: DataFrame, entities: Sequence = (), known: Sequence[str] = tuple(fixed.FLAVOR_WORDS), stop: Sequence[str] = tuple(fixed.KEYWORD_STOP_WORDS)) -> Column:
    """Distinct words in order, without stop words, units and single characters (but known ones), then the entities that are not among them."""
    tokens = segmented(normalize_text(text), counts, known)
    kept = F.filter(tokens, lambda w: ~w.rlike(r"(?i)^(kg|g|克|斤|公斤|千克)$") & ((F.length(w) > 1) | w.isin(*known)))
    more = F.filter(F.array_compact(F.array(*[strip(F.col(c) if isinstance(c, str) else c) for c in entities])), lambda w: w != "") if entities else F.array().cast("array<string>")
    return F.array_except(F.array_distinct(F.concat(kept, more)), string_array(list(stop)))
