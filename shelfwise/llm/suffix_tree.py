"""Probabilistic suffix tree: a variable-length Markov model of texts, learnt by Spark and applied to every text.

A text is its words, A-Z lower-cased, each with one separator behind it, the last with an end sign; the symbols are these bytes. A context
is the last 0 to ``DEPTH`` symbols. Its next-symbol distribution is interpolated with that of the context one symbol shorter by absolute
discounting, the empty context's with one added to every symbol. A context becomes a state if, by leave-one-out, it tells its next symbols better
than the shorter one by a stated divergence, or if a longer one that ends with it does; a symbol is scored by the longest state that its context
ends with.

A window is a context of ``DEPTH`` symbols and the next one, packed into one number without loss, latest symbol of the context first, so that
shorter contexts are masks. All levels are joins and groups of windows: 256 rows meet at most in any of them. When texts are scored, a window or
word that makes up a ``COMMON``-th of all occurrences or more is looked up in a broadcast array, which can hold ``COMMON`` entries at most; the rest
are joined by a shuffle, in which none of them is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.cells import WHITE_LOWER, Slice, hashes, per_text, release, slices, small_batches, words
from shelfwise.sources.staging import stage

DEPTH = 5
SEPARATOR, BEGIN, END = 0x20, 0x0D, 0x0A
#: What absolute discounting takes from every count, and the divergence in nats from which a context is a state.
DISCOUNT, DIVERGENCE = 0.75, 3.0
SYMBOLS = 256
#: Entries of a broadcast array have at least a ``COMMON``-th of all occurrences: so many there are at most, 12 bytes each.
COMMON = 8_000_000
#: Bytes of text worked on at a time; distinct entries that a task keeps before it sends them on, in batches of so many.
SLICE, PENDING, ROWS_PER_BATCH = 1 << 19, 1 << 19, 1 << 17
WINDOW, WORD = 0, 1
END_WORD = int(hashes(pa.array(["\n"]))[0].astype(np.int64))


def symbols(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts of a slice and the texts' bounds among them."""
    data = WHITE_LOWER[part.data]
    inside = data != SEPARATOR
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    last = part.offsets[1:] - 1
    keep[last] = True
    data[last] = END
    places = np.flatnonzero(keep)
    ends = np.searchsorted(places, last)
    # A separator that only white space follows gives way to the end sign.
    before = ends[ends > 0] - 1
    keep[places[before[data[places[before]] == SEPARATOR]]] = False
    count = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], count[part.offsets]


def windows(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The window that ends at every symbol."""
    sizes = np.diff(bounds)
    padded = np.full(len(own) + DEPTH * len(sizes), BEGIN, np.int64)
    at = np.arange(len(own)) + DEPTH * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    padded[at] = own
    out = padded[at]
    for k in range(1, DEPTH + 1):
        out |= padded[at - k] << (8 * (DEPTH + 1 - k))
    return out


def mask(level: int) -> int:
    """The bits of a window that a context of ``level`` symbols and the next one take."""
    return ((1 << 8 * level) - 1) << (8 * (DEPTH + 1 - level)) | 0xFF


def summed(keys: np.ndarray, train: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, train, every
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(train[order], first), np.add.reduceat(every[order], first)


def counted(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in order, how often they come up where ``chosen``, and how often at all; a window leaves room for the mark."""
    marked, n = np.unique(keys << 1 | chosen, return_counts=True)
    return summed(marked >> 1, n * (marked & 1), n)


def count_occurrences(docs: DataFrame) -> DataFrame:
    """``kind, key, train, n`` from ``text, learn``: occurrences of every window and word, among the texts to learn from and all in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]

        def send(kind: int) -> Iterator[pa.RecordBatch]:
            parts, pending[kind] = pending[kind], []
            if not parts:
                return
            columns = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            for a in range(0, len(columns[0]), ROWS_PER_BATCH):
                own = [c[a:a + ROWS_PER_BATCH] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), kind, np.int8)), *map(pa.array, own)], ["kind", "key", "train", "n"])

        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for part in slices(batch.column(0), SLICE):
                chosen = learn[part.first:part.first + len(part)]
                own, bounds = symbols(part)
                pending[WINDOW].append(counted(windows(own, bounds), np.repeat(chosen, np.diff(bounds))))
                found = words(part, WHITE_LOWER)
                size = len(found.vocabulary)
                train = np.bincount(found.ids[np.repeat(chosen, found.counts)], minlength=size)
                pending[WORD].append((hashes(found.vocabulary).astype(np.int64), train, np.bincount(found.ids, minlength=size)))
                pending[WORD].append((np.array([END_WORD]), np.array([chosen.sum()]), np.array([len(chosen)])))
                for kind in (WINDOW, WORD):
                    if sum(len(k) for k, _, _ in pending[kind]) > PENDING:
                        pending[kind] = [summed(*(np.concatenate(c) for c in zip(*pending[kind], strict=True)))]
                        if len(pending[kind][0][0]) > PENDING // 2:
                            yield from send(kind)
        yield from send(WINDOW)
        yield from send(WORD)
        release()

    return docs.mapInArrow(count, "kind byte, key long, train long, n long").groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("n").alias("n"))


def level_of(rows: DataFrame, level: int, shorter: DataFrame | None, total: int) -> DataFrame:
    """``key, context, train, p, told``: the smoothed probability of every window of a level, and what its context tells more than the shorter one.

    ``shorter`` is the level below. A context has at most 256 next symbols and a window at most 256 that are one symbol longer, so neither window nor join is skewed.
    """
    rows = rows.select("key", F.col("key").bitwiseAND(mask(level) & ~0xFF).alias("context"), "train")
    if shorter is None:
        return rows.select("*", ((F.col("train") + 1) / (total + SYMBOLS)).alias("p"), F.lit(0.0).alias("told"))
    base = shorter.select(F.col("key").alias("short"), F.col("p").alias("base"))
    rows = rows.withColumn("short", F.col("key").bitwiseAND(mask(level - 1))).join(base, "short")
    own = Window.partitionBy("context")
    c, base = F.col("train"), F.col("base")
    rows = rows.withColumn("size", F.sum("train").over(own)).withColumn("types", F.sum((c > 0).cast("long")).over(own))
    smooth = lambda count, size, types: (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * types * base) / size
    p = F.when(F.col("size") > 0, smooth(c, F.col("size"), F.col("types"))).otherwise(base)
    without = F.when((c > 0) & (F.col("size") > 1), c * F.log(smooth(c - 1, F.col("size") - 1, F.col("types") - (c == 1).cast("long")) / base)).otherwise(0.0)
    return rows.select("key", "context", "train", p.alias("p"), F.sum(without).over(own).alias("told"))


def learn(seen: DataFrame, divergence: float = DIVERGENCE) -> DataFrame:
    """``key, log``: the decimal logarithm of every window's probability, from ``key, train`` of all windows."""
    rows = [stage(seen.select("key", "train"))]
    for level in range(DEPTH - 1, -1, -1):
        rows.append(stage(rows[-1].groupBy(F.col("key").bitwiseAND(mask(level)).alias("key")).agg(F.sum("train").alias("train"))))
    rows.reverse()
    total = rows[0].agg(F.sum("train")).first()[0] or 0
    levels = [stage(level_of(rows[0], 0, None, total))]
    for level in range(1, DEPTH + 1):
        levels.append(stage(level_of(rows[level], level, levels[-1], total)))
    states: list[DataFrame | None] = [None] * (DEPTH + 1)
    for level in range(DEPTH, 0, -1):
        own = levels[level].filter(F.col("told") >= divergence).select("context")
        if level < DEPTH:
            own = own.unionByName(states[level + 1].select(F.col("context").bitwiseAND(mask(level) & ~0xFF).alias("context")))
        states[level] = stage(own.distinct())
    best = levels[0].select("key", "p")
    for level in range(1, DEPTH + 1):
        short = best.select(F.col("key").alias("short"), F.col("p").alias("base"))
        rows_ = levels[level].withColumn("short", F.col("key").bitwiseAND(mask(level - 1))).join(short, "short")
        best = rows_.join(states[level].withColumn("state", F.lit(True)), "context", "left").select("key", F.when(F.col("state"), F.col("p")).otherwise(F.col("base")).alias("p"))
    return best.select("key", F.log10("p").alias("log"))


def dense(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values, of a table that cannot have more than ``COMMON`` rows."""
    got = rows.select("key", F.col(value).cast("float").alias("v")).toArrow()
    keys, values = got.column("key").to_numpy(), got.column("v").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys' values in a table of sorted keys, 0 where there is none, and where there is one."""
    known, values = table
    if not len(known):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return np.where(hit, values[at].astype(np.float64), 0.0), hit


RARE = "array<struct<key: long, n: int>>"
SCORED = f"struct<n_tokens: long, n_known: long, base: double, log: double, words: {RARE}, windows: {RARE}>"


def rare(keys: np.ndarray, text: np.ndarray, size: int) -> pa.Array:
    """Per text, its keys and how often it has each."""
    pairs = np.empty(len(keys), [("text", np.int64), ("key", np.int64)])
    pairs["text"], pairs["key"] = text, keys
    pairs, n = np.unique(pairs, return_counts=True)
    entries = pa.StructArray.from_arrays([pa.array(pairs["key"]), pa.array(n.astype(np.int32))], ["key", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs["text"], np.arange(size + 1)).astype(np.int32)), entries)


def scorer(spark, common_words: tuple[np.ndarray, np.ndarray], common_windows: tuple[np.ndarray, np.ndarray]):
    """A column function of the text: what its common words and windows add up to, and its others as lists."""
    shared = spark.sparkContext.broadcast((common_words, common_windows))

    @F.arrow_udf(SCORED)
    def run(texts: pa.Array) -> pa.Array:
        by_word, by_window = shared.value
        end, end_common = find(by_word, np.array([END_WORD]))
        out = []
        for part in slices(texts, SLICE):
            size = len(part)
            found = words(part, WHITE_LOWER)
            coded = hashes(found.vocabulary).astype(np.int64)
            count, common = find(by_word, coded)
            count, common_at = count[found.ids], common[found.ids]
            text = np.repeat(np.arange(size), found.counts)
            base = per_text(np.log10(count + 1), found.bounds) + np.log10(end + 1)
            known = per_text((common_at & (count > 0)).astype(np.int64), found.bounds) + int(end[0] > 0)
            # The end sign follows every text; where it is not among the common words it is one of the others.
            others = [coded[found.ids[~common_at]], text[~common_at]]
            if not end_common[0]:
                others = [np.concatenate([others[0], np.full(size, END_WORD)]), np.concatenate([others[1], np.arange(size)])]
            own, bounds = symbols(part)
            keys, index = np.unique(windows(own, bounds), return_inverse=True)
            log, hit = find(by_window, keys)
            missed = np.flatnonzero(~hit[index])
            at = np.searchsorted(bounds, missed, "right") - 1
            columns = [pa.array(found.counts + 1), pa.array(known), pa.array(base), pa.array(per_text(log[index], bounds)), rare(*others, size), rare(keys[index[missed]], at, size)]
            out.append(pa.StructArray.from_arrays(columns, ["n_tokens", "n_known", "base", "log", "words", "windows"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("log", pa.float64()), *((x, pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32())]))) for x in ("words", "windows"))]))

    return run.asNondeterministic()


def common(table: DataFrame, least: int) -> DataFrame:
    """Entries with a ``least``-th of all occurrences, of which there are at most so many."""
    total = table.agg(F.sum("n")).first()[0] or 0
    return table.filter(F.col("n") * least >= total)


def score(docs: DataFrame, learn_from: Column | None = None, text_col: str = "text", id_col: str = "doc_id", divergence: float = DIVERGENCE, least: int = COMMON) -> DataFrame:
    """Every row's ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; scores are decimal logarithms.

    The model learns from the rows where ``learn_from`` (default: all) is true. Tokens are the words and one end per text, which is counted as a
    token: ``base_score`` is the add-one unigram model's, ``score`` the suffix tree's. Null, empty and blank texts are an end alone. Every
    window of every text has a probability above 0, whether or not it was learnt. With nothing to learn from, all symbols are alike. Repeated rows
    are scored like any others, other columns are not read, an empty table gives no rows.
    """
    spark = docs.sparkSession
    chosen = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    source = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), chosen.alias("learn"))
    seen = stage(count_occurrences(source.select("text", "learn")))
    seen_words, seen_windows = (seen.filter(F.col("kind") == kind).drop("kind") for kind in (WORD, WINDOW))
    sizes = seen_words.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("train") > 0).cast("long")), F.lit(0)).alias("v")).first()
    logs = stage(learn(seen_windows, divergence).join(seen_windows.select("key", "n"), "key"))
    run = scorer(spark, dense(common(seen_words, least), "train"), dense(common(logs, least), "log"))
    scored = stage(source.select(F.monotonically_increasing_id().alias("row"), "id", "learn", run("text").alias("s")).select("row", "id", "learn", "s.*"))
    others = lambda name: scored.select("row", F.inline(name))
    known = F.when(F.col("train") > 0, F.col("n")).otherwise(0)
    from_words = others("words").join(seen_words.select("key", "train"), "key").select("row", (F.col("n") * F.log10(F.col("train") + 1.0)).alias("base"), known.alias("known"), F.lit(0.0).alias("log"))
    from_windows = others("windows").join(logs.select("key", "log"), "key").select("row", F.lit(0.0).alias("base"), F.lit(0).alias("known"), (F.col("n") * F.col("log")).alias("log"))
    more = from_words.unionByName(from_windows).groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("known").alias("more_known"), F.sum("log").alias("more_log"))
    joined = scored.drop("words", "windows").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return joined.select(
        F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(sizes["n"]).cast("long").alias("train_tokens"),
        (plus("base", "more_base") - F.col("n_tokens") * float(np.log10(sizes["n"] + sizes["v"] + 1))).alias("base_score"), plus("log", "more_log").alias("score"),
    )


def seventh(key: Column) -> Column:
    """Rows to learn from: all but those whose id's CRC-32, modulo 7, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 7 != 2
