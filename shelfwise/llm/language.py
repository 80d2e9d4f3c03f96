"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

Posterior log odds of a language are the sum of

* the text's likelihood: byte trigrams in ``BUCKETS`` hash classes, counted per declared language over all texts;
* the declared language of the markup, and the suffix of the address: each a conditional table ``P(value | language)`` with
  additive smoothing, from grouped counts;
* the host's prior: counts of the text-only languages of a host's pages, smoothed towards those of its parent domain, these
  towards those of the suffix, and these towards the corpus.

The posterior also weighs the text under the best language against an unknown one, whose trigrams are each as likely as halfway (in
logarithms) between the language's own average over all its texts and the uniform distribution.

Counting sends partial sums only; the trigram table has a fixed number of classes, so its size does not follow the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.cells import WHITE_LOWER, Slice, mixed, per_text, slices, small_batches
from shelfwise.sources.staging import stage

BUCKETS = 1 << 16
#: Bytes of text worked on at a time.
SLICE = 1 << 19
SMOOTHING = 0.5
#: A trigram's evidence is damped: neighbouring trigrams are not independent, and one text must not outweigh all other evidence for good.
DAMPING = 0.25
#: Pseudo-counts by which a level of the host hierarchy leans on the level above.
LEAN = 20.0
#: How often a declared language or suffix is taken to be of no meaning.
DOUBT = 0.05
#: The prior of a text in none of the languages.
UNKNOWN = 0.05
#: A text has no letters to speak of if they are less than this part of its visible bytes.
LEAST_LETTERS = 0.2
#: A text is rejected if its best language has less than this posterior, or if it has no letters to speak of.
LEAST_POSTERIOR = 0.5


#: Undetermined, several, and no linguistic content.
NO_LANGUAGE = ["und", "mul", "zxx"]
VISIBLE = WHITE_LOWER > 32
LETTER = ((WHITE_LOWER >= 97) & (WHITE_LOWER <= 122)) | (WHITE_LOWER >= 128)


def trigrams(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash classes of the byte trigrams that hold a letter (or a byte outside ASCII), and every text's bounds among them."""
    data = WHITE_LOWER[part.data].astype(np.uint32)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64)
    codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    # All three bytes belong to one text: its closing line feed may be the last of them.
    inside = letter[1:-1] | letter[:-2]
    ends = part.offsets[1:-1]
    for cut in (ends - 2, ends - 1):
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    at = np.flatnonzero(inside)
    return (mixed(codes[at].astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(at, part.offsets)


def count_trigrams(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts of every class per language, over all texts whose declared language is one of ``languages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        number = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            own = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()])
            for part in slices(batch.column(1), SLICE):
                classes, bounds = trigrams(part)
                language = np.repeat(own[part.first:part.first + len(part)], np.diff(bounds))
                known = language >= 0
                counts += np.bincount(language[known] * BUCKETS + classes[known], minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["class", "n"])

    merged = docs.select("declared", "text").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    counts = np.zeros(len(languages) * BUCKETS)
    counts[merged["class"].to_numpy()] = merged["n"].to_numpy()
    return counts.reshape(len(languages), BUCKETS)


def text_scores(table: np.ndarray):
    """A column function: the damped log likelihoods of a text under every language, and last its damped number of trigrams; null for a text without letters."""

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        out, has = [], []
        for part in slices(texts, SLICE):
            classes, bounds = trigrams(part)
            each = np.empty((len(part), table.shape[0] + 1))
            for k in range(table.shape[0]):
                total = np.concatenate([[0.0], np.cumsum(table[k][classes], dtype=np.float64)])
                each[:, k] = total[bounds[1:]] - total[bounds[:-1]]
            each[:, -1] = np.diff(bounds)
            out.append(each * DAMPING)
            letters = per_text(LETTER[part.data], part.offsets)
            has.append((np.diff(bounds) > 0) & (letters >= LEAST_LETTERS * per_text(VISIBLE[part.data], part.offsets)))
        if not out:
            return pa.array([], pa.list_(pa.float64()))
        each, has = np.concatenate(out), np.concatenate(has)
        sizes = np.where(has, table.shape[0] + 1, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(each[has].ravel()))
        return pa.array([x if h else None for x, h in zip(lists.to_pylist(), has, strict=True)], pa.list_(pa.float64())) if not has.all() else lists

    return score.asNondeterministic()  # else a filter on the result would be pushed below and score every text twice


def host_levels(host: Column) -> list[Column]:
    """Suffix, registered domain and whole host; a host of one label is all three."""
    return [F.call_function("substring_index", host, F.lit("."), F.lit(-1)), F.call_function("substring_index", host, F.lit("."), F.lit(-2)), host]


def log_table(counts: DataFrame, value: str, languages: list[str]) -> dict[str, list[float]]:
    """``log P(value | language)`` with additive smoothing and a share of doubt, for values that the counts have."""
    rows = counts.collect()
    totals = [sum(r[f"n{k}"] for r in rows) for k in range(len(languages))]
    n = len(rows) + 1
    return {r[value]: [math.log((1 - DOUBT) * (r[f"n{k}"] + SMOOTHING) / (totals[k] + SMOOTHING * n) + DOUBT / n) for k in range(len(languages))] for r in rows}


def primary_subtag(declared: Column) -> Column:
    """The two or three letters before the first ``-`` or ``_`` of a language tag, lower-cased; null for other shapes and such as name no language."""
    found = F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_]|$)", 1)
    return F.when((found != "") & ~found.isin(NO_LANGUAGE), found)


def with_language(pages: DataFrame, text_col: str = "text", declared: Column | None = None, host: Column | None = None, languages: list[str] | None = None, into: str = "language") -> DataFrame:
    """``pages`` with ``predicted, posterior, accepted`` in a struct ``into``; all columns stay, but for an old one of that name.

    ``declared`` is the declared language (default: column ``lang``), ``host`` the address's host (default: column ``source``); null
    values say nothing. ``languages`` default to the primary subtags of two or three letters that are declared. A null or empty text, or one without
    letters to speak of, is judged by the other evidence but never accepted; one in none of the languages has a low posterior. Ties go to the language first in the alphabet. An empty table, or
    one without any declared language, gives its rows with a null prediction, not accepted.
    """
    declared = F.col("lang") if declared is None else declared
    host = F.col("source") if host is None else host
    # The pages' own columns are one struct, so no name of theirs meets one used here.
    evidence = small_batches(pages).select(F.struct(*pages.columns).alias("own"), primary_subtag(declared).alias("declared"), F.lower(host).alias("host"))
    text = F.col("own")[text_col].cast("string")
    kept = [F.col("own")[c].alias(c) for c in pages.columns if c != into]
    flat_ = evidence.select("declared", "host", text.alias("text"))
    if languages is None:
        # Two or three letters: 18,252 values at most.
        languages = sorted(r["declared"] for r in flat_.filter("declared is not null").select("declared").distinct().collect())
    answer = "struct<predicted: string, posterior: double, accepted: boolean>"
    if not languages:
        none = F.struct(F.lit(None).cast("string").alias("predicted"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted")).cast(answer)
        return evidence.select(*kept, none.alias(into))
    counts = count_trigrams(flat_, languages) + SMOOTHING
    shares = counts / counts.sum(1, keepdims=True)
    score = text_scores(np.log(shares).astype(np.float32))
    unknown = F.array(*(F.lit(float(x)) for x in ((shares * np.log(shares)).sum(1) - math.log(BUCKETS)) / 2))
    of_text = lambda both: F.slice(both, 1, len(languages))

    # What the text alone says of every page, softened into fractions, counted by declared language, suffix, domain and host.
    suffix, domain, whole = host_levels(F.col("host"))
    best = F.array_max("scores")
    weights = F.transform("scores", lambda x: F.exp(x - best))
    said = flat_.select("declared", suffix.alias("suffix"), domain.alias("domain"), whole.alias("host"), of_text(score(F.col("text"))).alias("scores")).filter("scores is not null")
    said = said.select("declared", "suffix", "domain", "host", weights.alias("w")).withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    sums = [F.sum(F.col("w")[k] / F.col("total")).alias(f"n{k}") for k in range(len(languages))]
    by_host = stage(said.groupBy("declared", "suffix", "domain", "host").agg(*sums))
    again = [F.sum(f"n{k}").alias(f"n{k}") for k in range(len(languages))]
    of_declared = log_table(by_host.filter(F.col("declared").isin(languages)).groupBy("declared").agg(*again), "declared", languages)
    corpus = by_host.agg(*again).first()
    everything = [corpus[f"n{k}"] or 0.0 for k in range(len(languages))]
    root = [(x + 1.0) / (sum(everything) + len(languages)) for x in everything]
    prior = F.array(*(F.lit(p) for p in root))
    levels = by_host.filter("host is not null")

    def leaning(keys: list[str], above: DataFrame | None, above_keys: list[str]) -> DataFrame:
        """A level's language fractions, smoothed towards the level above."""
        own = levels.groupBy(*keys).agg(*again)
        own = own.withColumn("above", prior) if above is None else own.join(above.withColumnRenamed("prior", "above"), above_keys)
        total = sum((F.col(f"n{k}") for k in range(1, len(languages))), F.col("n0"))
        return own.select(*keys, F.array(*((F.col(f"n{k}") + LEAN * F.col("above")[k]) / (total + LEAN) for k in range(len(languages)))).alias("prior"))

    by_suffix = leaning(["suffix"], None, [])
    by_domain = leaning(["suffix", "domain"], by_suffix, ["suffix"])
    priors = stage(leaning(["suffix", "domain", "host"], by_domain, ["suffix", "domain"]).select(F.col("host").alias("of_host"), "prior"))

    zero = F.array(*(F.lit(0.0) for _ in languages))
    spoken = F.create_map(*(x for v, logs in of_declared.items() for x in (F.lit(v), F.array(*map(F.lit, logs))))) if of_declared else F.create_map().cast("map<string,array<double>>")
    held = evidence.join(priors, F.col("host") == F.col("of_host"), "left").withColumn("scored", score(text)).withColumn("scores", of_text("scored"))
    of_markup = F.when(F.col("declared").isNotNull(), F.coalesce(F.try_element_at(spoken, F.col("declared")), zero)).otherwise(zero)
    parts = F.arrays_zip(F.coalesce("scores", zero).alias("text"), of_markup.alias("markup"), F.coalesce("prior", prior).alias("host"))
    logs = F.transform(parts, lambda p: p["text"] + p["markup"] + F.log(p["host"]))
    held = held.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    posterior = 1.0 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    at = F.array_position("logs", F.col("top")).cast("int")
    predicted = F.element_at(F.array(*map(F.lit, languages)), at)
    against = F.element_at("scored", -1) * F.element_at(unknown, at) - F.element_at("scores", at)
    posterior = posterior / (1.0 + F.coalesce(F.exp(against), F.lit(0.0)) * (UNKNOWN / (1 - UNKNOWN)))
    result = F.struct(predicted.alias("predicted"), posterior.alias("posterior"), ((posterior >= LEAST_POSTERIOR) & F.col("scores").isNotNull()).alias("accepted"))
    return held.select("own", result.alias("answer")).select(*kept, F.col("answer").alias(into))
