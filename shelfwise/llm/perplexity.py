"""Quality rules with n-gram perplexity.

The language model is an interpolated modified Kneser-Ney model of characters, one per language, counted by Spark over all texts.
An n-gram is a 64-bit hash of its characters and its language. The model is a Spark table of all n-grams of the highest order, as long as
the texts make it: a small one is broadcast, any other is joined with the n-grams that blocks of texts hold. Every language has its own band
of log perplexity around its median; documents outside it are rejected, besides those that fail the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.cells import WHITE, Slice, Words, flat, mixed, packed, per_text, release, slices, small_batches, words
from shelfwise.sources.staging import stage

ORDER = 4
#: A band reaches so many median absolute deviations from the median, and so many nats at least.
WIDTH, LEAST_WIDTH = 10.0, 0.7
#: Log perplexities are counted in cells of a thousandth of a nat.
CELLS = 1000
#: Bytes of text and rows worked on at a time.
SLICE, ROWS = 1 << 19, 1000
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Models of at most so many n-grams (12 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: A task sends its counts on when it holds so many distinct n-grams, in batches of so many.
PENDING, ROWS_PER_BATCH = 1 << 20, 1 << 17
#: By a shuffle, 2 ** so many rows at a time meet the n-grams they hold.
BLOCK_BITS = 9
COUNT_SCHEMA = ", ".join([*(f"gram{n} long, context{n} long" for n in range(1, ORDER + 1)), "count long"])


# -- base rules ---------------------------------------------------------------------------------------------------------------


def repeated_words(found: Words) -> np.ndarray:
    """How many words of every text lie in a three-word window that the text has twice or more, the first included."""
    covered = np.zeros(len(found.ids), bool)
    counts = found.counts
    at = np.flatnonzero(np.repeat(np.arange(len(counts)), counts)[2:] == np.repeat(np.arange(len(counts)), counts)[:-2]) if len(found.ids) > 2 else np.zeros(0, np.int64)
    if len(at):
        size = len(found.vocabulary)
        pair = found.ids[at] * size + found.ids[at + 1]
        if size >= 1 << 21:  # three numbers don't fit one key: number the pairs first
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair * size + found.ids[at + 2]
        text = np.searchsorted(found.bounds, at, "right") - 1
        order = np.argsort(key, kind="stable")  # texts stay in order among equal windows
        same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return per_text(covered, found.bounds)


def duplicate_lines(part: Slice) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    ends = np.flatnonzero(part.data == 10) + 1
    starts = np.concatenate([[0], ends[:-1]])
    coded = packed(part.data, np.append(starts, ends[-1:])).dictionary_encode()
    data, offsets = flat(coded.dictionary)
    wordy = per_text(WHITE[data] != 32, offsets) > 0
    line = coded.indices.to_numpy().astype(np.int64)
    text = np.searchsorted(part.offsets, starts, "right") - 1
    keep = wordy[line]
    line, text = line[keep], text[keep]
    distinct = np.unique(text * (len(wordy) + 1) + line) // (len(wordy) + 1)
    return np.bincount(text, minlength=len(part)) - np.bincount(distinct, minlength=len(part))


def base_counts(part: Slice) -> dict[str, np.ndarray]:
    found = words(part, WHITE)
    inside = (WHITE[part.data] != 32) & ((part.data & 0xC0) != 0x80)
    return {
        "n_words": found.counts,
        "word_chars": per_text(inside, part.offsets),
        "n_symbols": per_text(SYMBOLS[part.data], part.offsets),
        "n_dup_lines": duplicate_lines(part),
        "n_repeat_words": repeated_words(found),
    }


# -- the model ----------------------------------------------------------------------------------------------------------------


@dataclass
class Grams:
    """Hashes of the ``ORDER``-grams at the places to predict, these places among ``points`` and ``salts``, and the texts' bounds among them."""

    hashes: np.ndarray
    at: np.ndarray
    bounds: np.ndarray
    points: np.ndarray
    salts: np.ndarray


def hashed(columns: list[np.ndarray], salts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row's characters, one column each, and its language."""
    with np.errstate(over="ignore"):
        value = salts + np.uint64(len(columns))
        for points in columns:
            value = mixed(value + points)
    return value.view(np.int64)


def grams(part: Slice, salts: np.ndarray) -> Grams:
    """The ``ORDER``-grams of a slice of :func:`padded` texts: a text follows ``ORDER - 1`` line feeds, and its closing line feed is predicted."""
    points = np.frombuffer(b"\n\0\0\0" + part.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])[part.offsets] + 1
    salt = np.concatenate([salts[:1], np.repeat(salts, np.diff(ends))]) if len(salts) else np.zeros(1, np.uint64)
    predicted = np.ones(len(points), bool)
    predicted[:ORDER - 1] = False
    for k in range(ORDER - 2):
        predicted[ends[:-1] + k] = False
    at = np.flatnonzero(predicted)
    whole = hashed([points[k:len(points) - ORDER + 1 + k] for k in range(ORDER)], salt[ORDER - 1:]) if len(at) else np.zeros(0, np.int64)
    return Grams(whole[at - ORDER + 1], at, np.searchsorted(at, ends), points, salt)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, unsorted, and the place of every value among them."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def padded_slices(texts: pa.Array, language: np.ndarray) -> Iterator[tuple[Slice, np.ndarray]]:
    """Slices of padded texts with their languages' salts; few rows are copied at a time."""
    for low in range(0, len(texts), ROWS):
        for part in slices(padded(texts.slice(low, ROWS)), SLICE):
            yield part, language[low + part.first:low + part.first + len(part)]


def padded(texts: pa.Array) -> pa.Array:
    """Line feeds before every text; with the one that closes the text before it they make a full context."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.binary_join_element_wise(pa.scalar("\n" * (ORDER - 2), pa.large_string()), texts, pa.scalar("", pa.large_string()))


def salts(languages: pa.Array) -> np.ndarray:
    """A 64-bit number of every row's language; null is a language of its own."""
    coded = pc.fill_null(languages.cast(pa.string()), "").dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    import xxhash

    own = np.array([xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy()]


class Pending:
    """Distinct ``ORDER``-grams with their counts, characters and languages."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, own: Grams) -> None:
        keys, index = distinct(own.hashes)
        where = np.empty(len(keys), np.int64)
        where[index] = own.at  # any of its places
        self.parts.append((keys, np.bincount(index, minlength=len(keys)), own.salts[where], *(own.points[where - back].astype(np.uint32) for back in range(ORDER - 1, -1, -1))))
        self.size += len(keys)

    def merge(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        keys, first, index = np.unique(columns[0], return_index=True, return_inverse=True)
        self.parts = [(keys, np.bincount(index, columns[1]).astype(np.int64), *(c[first] for c in columns[2:]))]
        self.size = len(keys)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for keys, counts, salt, *points in self.parts:
            for a in range(0, len(keys), ROWS_PER_BATCH):
                cut = slice(a, a + ROWS_PER_BATCH)
                own = [p[cut].astype(np.uint64) for p in points]
                pairs = [(hashed(own[ORDER - n:], salt[cut]), hashed(own[ORDER - n:-1], salt[cut])) for n in range(1, ORDER)] + [(keys[cut], hashed(own[:-1], salt[cut]))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for pair in pairs for x in pair] + [pa.array(counts[cut])], [c.split()[0] for c in COUNT_SCHEMA.split(", ")])
        self.parts, self.size = [], 0


def count_types(docs: DataFrame) -> DataFrame:
    """Distinct n-grams of the highest order and how often they occur, with the shorter n-grams that end with them and all their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = Pending()
        for batch in batches:
            for part, salt in padded_slices(batch.column(0), salts(batch.column(1))):
                pending.add(grams(part, salt))
                if pending.size > PENDING:
                    pending.merge()
                    if pending.size > PENDING // 2:
                        yield from pending.batches()
        if pending.size:
            pending.merge()
            yield from pending.batches()
        release()

    whole, *others = [f"gram{ORDER}", *(x for n in range(1, ORDER + 1) for x in (f"gram{n}", f"context{n}") if x != f"gram{ORDER}")]
    return docs.select("text", "language").mapInArrow(run, COUNT_SCHEMA).groupBy(whole).agg(*(F.first(x).alias(x) for x in others), F.sum("count").alias("a"))


@dataclass
class Model:
    """``gram, v``: the log probability of every n-gram of the highest order, and how many there are."""

    table: DataFrame
    rows: int

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole table as sorted hashes and their values."""
        table = self.table.toArrow()
        return by_key(table.column("gram").to_numpy(), table.column("v").to_numpy())


def by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (max(0, x) for x in counts_of_counts)
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.0), float(k)) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]


def train(docs: DataFrame) -> Model:
    """From the columns ``text`` and ``language`` of all rows."""
    levels = {ORDER: stage(count_types(docs))}
    for n in range(ORDER - 1, 0, -1):  # adjusted counts: how many different n-grams of the next order end with it
        others = [f"context{n}", *(x for k in range(1, n) for x in (f"gram{k}", f"context{k}"))]
        levels[n] = stage(levels[n + 1].groupBy(f"gram{n}").agg(*(F.first(x).alias(x) for x in others), F.count("*").alias("a")))
    floor = 1.0 / (levels[1].count() + 1)
    lower: DataFrame | None = None
    for n in range(1, ORDER + 1):
        own = levels[n].select(F.col(f"gram{n}").alias("gram"), F.col(f"context{n}").alias("context"), *([F.col(f"gram{n - 1}").alias("suffix")] if n > 1 else []), "a")
        seen = own.agg(*(F.sum((F.col("a") == k).cast("long")).alias(f"n{k}") for k in range(1, 5))).first()
        d = discounts([seen[f"n{k}"] or 0 for k in range(1, 5)])
        weight = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        held = own.groupBy("context").agg(F.sum("a").alias("total"), F.sum(weight).alias("taken"))
        base = F.lit(floor) if lower is None else F.col("lower")
        joined = own.join(held, "context")
        if lower is not None:
            joined = joined.join(lower, "suffix")
        p = stage(joined.select("gram", (F.greatest(F.col("a") - weight, F.lit(0.0)) / F.col("total") + F.col("taken") / F.col("total") * base).alias("p")))
        lower = p.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return Model(p.select("gram", F.log("p").cast("float").alias("v")), p.count())


def log_perplexities(_: Model | None, dense: tuple[np.ndarray, np.ndarray], part: Slice, language: np.ndarray) -> np.ndarray:
    """Mean negative log probability of the characters of every text of a slice of padded texts.

    ``dense`` has the n-grams of these texts at least; a model is counted on all texts that it is asked about.
    """
    own = grams(part, language)
    wanted, index = distinct(own.hashes)
    keys, values = dense
    place = np.searchsorted(keys, wanted)
    if len(wanted) and (not len(keys) or (keys[np.minimum(place, len(keys) - 1)] != wanted).any()):
        raise ValueError("the model was not counted on this text")
    return -per_text(values[place].astype(np.float64)[index], own.bounds) / np.diff(own.bounds)


def scores_by_join(rows: DataFrame, model: Model) -> DataFrame:
    """``row, language, has_text, log_perplexity`` from ``row, text, language``; no task holds more of the model than its block of rows asks for."""
    blocks = rows.withColumn("block", F.shiftright("row", BLOCK_BITS))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                for part, salt in padded_slices(batch.column(1).slice(low, high - low), salts(batch.column(2).slice(low, high - low))):
                    wanted, _ = distinct(grams(part, salt).hashes)
                    for a in range(0, len(wanted), ROWS_PER_BATCH):
                        own = wanted[a:a + ROWS_PER_BATCH]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block[low])), pa.array(own)], ["block", "gram"])

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        keys, first = np.unique(found.column("gram").to_numpy(), return_index=True)
        known = keys, found.column("v").to_numpy()[first]
        out = []
        for batch in texts.select(["row", "text", "language"]).to_batches():
            logs = [log_perplexities(None, known, part, salt) for part, salt in padded_slices(batch.column(1), salts(batch.column(2)))]
            has = pc.fill_null(pc.greater(pc.binary_length(batch.column(1)), 0), False)
            out.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), has, pa.array(np.concatenate(logs) if logs else np.zeros(0))], ["row", "language", "has_text", "log_perplexity"]))
        return pa.Table.from_batches(out)

    found = blocks.select("block", "text", "language").mapInArrow(needed, "block long, gram long").join(model.table, "gram").select("block", "gram", "v")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, "row long, language string, has_text boolean, log_perplexity double")


QUALITY = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, log_perplexity: double>"


def measured(spark, known: tuple[np.ndarray, np.ndarray] | None, with_counts: bool):
    """A column function of text and language: log perplexity, with the base counts or alone; it is null without a model."""
    shared = None if known is None else spark.sparkContext.broadcast(known)

    @F.arrow_udf(QUALITY if with_counts else "double")
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        if shared is None:
            logs = pa.nulls(len(texts), pa.float64())
        else:
            found = [log_perplexities(None, shared.value, part, salt) for part, salt in padded_slices(texts, salts(languages))]
            logs = pa.array(np.concatenate(found) if found else np.zeros(0))
        if not with_counts:
            return logs
        counts = [base_counts(p) for p in slices(texts, SLICE)]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return pa.StructArray.from_arrays([*(pa.array(np.concatenate([c[k] for c in counts]).astype(np.int64) if counts else np.zeros(0, np.int64)) for k in names), logs], [*names, "log_perplexity"])

    return run.asNondeterministic()  # else a filter on the result would be pushed below and score every text twice


def bands(logs: DataFrame) -> DataFrame:
    """``language, lower, upper`` from ``language, log_perplexity`` of all documents; medians are exact to a cell."""
    cells = stage(logs.groupBy("language", F.floor(F.col("log_perplexity") * CELLS).alias("cell")).agg(F.count("*").alias("n")))

    def median(table: DataFrame) -> DataFrame:
        # Cells are bounded by the range of the logarithm, not by the number of documents.
        upto = F.sum("n").over(Window.partitionBy("language").orderBy("cell"))
        total = F.sum("n").over(Window.partitionBy("language"))
        return table.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") * 2 >= F.col("total")).groupBy("language").agg(F.min("cell").alias("median"))

    middle = median(cells)
    off = cells.join(middle, "language").groupBy("language", "median", F.abs(F.col("cell") - F.col("median")).alias("cell")).agg(F.sum("n").alias("n"))
    spread = median(off).withColumnRenamed("median", "mad")
    width = F.greatest(F.col("mad") / CELLS * WIDTH, F.lit(LEAST_WIDTH))
    return middle.join(spread, "language").select("language", (F.col("median") / CELLS - width).alias("lower"), (F.col("median") / CELLS + width).alias("upper"))


def with_quality(docs: DataFrame, text_col: str = "text", language: Column | None = None, into: str = "quality") -> DataFrame:
    """``docs`` with a struct ``into``: the base counts, ``base_failed, log_perplexity, kept``; other columns stay.

    The base rules reject fewer than 50 words and texts of which more than half lies in repeated three-word windows. ``language`` (default:
    column ``lang``) chooses the model and the band; null is a language of its own. Null and empty texts have no words and fail. An old
    column of the name ``into`` is replaced. An empty table gives no rows.
    """
    language = F.col("lang") if language is None else language
    spark = docs.sparkSession
    source = small_batches(docs).select(F.col(text_col).cast("string").alias("text"), F.coalesce(language, F.lit("")).alias("language"))
    model = train(source)
    # The documents' own columns are one struct, so no name of theirs meets one used here.
    judged = docs.select(F.struct(*docs.columns).alias("own"), F.coalesce(language, F.lit("")).alias("language"))
    text = F.col("own")[text_col].cast("string")
    if model.rows <= BROADCAST_ROWS:
        known = model.dense()
        logs = source.filter("text != ''").select("language", measured(spark, known, with_counts=False)("text", "language").alias("log_perplexity"))
        judged = judged.withColumn("measured", measured(spark, known, with_counts=True)(text, F.col("language"))).withColumn("log", F.col("measured.log_perplexity"))
    else:
        judged = judged.withColumn("row", F.monotonically_increasing_id())
        scored = stage(scores_by_join(judged.select("row", text.alias("text"), "language"), model))
        logs = scored.filter("has_text").select("language", "log_perplexity")
        judged = judged.join(scored.select("row", F.col("log_perplexity").alias("log")), "row")
        judged = judged.withColumn("measured", measured(spark, None, with_counts=True)(text, F.col("language")))
    limits = stage(bands(logs))
    m = lambda name: F.col("log" if name == "log_perplexity" else f"measured.{name}")
    failed = (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))
    inside = F.coalesce(m("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]
    result = F.struct(*(m(x).alias(x) for x in names), failed.alias("base_failed"), (~failed & inside).alias("kept"), "lower", "upper")
    return judged.join(limits, "language", "left").select("own", result.alias("answer")).select(*(F.col("own")[c].alias(c) for c in docs.columns if c != into), F.col("answer").alias(into))
