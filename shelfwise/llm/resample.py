"""Target-distribution importance resampling over hashed word n-grams.

A text is lower-cased and blanked by one 256-byte table and split into words; the CRC-32 of a word seeds that of the n-gram which the next word
extends. Tasks reduce n-grams to counts per bucket, Spark adds them up, and every document is weighed by how much likelier its buckets are in
the target than in the corpus. Adding Gumbel noise made of a document's id and taking the greatest sums is a draw without replacement.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.cells import ALNUM_LOWER, small_batches
from shelfwise.llm.ordering import positions

#: Letters, digits and bytes outside ASCII stay, A-Z are lower-cased, everything else is blank.
TABLE = ALNUM_LOWER.tobytes()
BUCKETS, GRAMS = 10_000, 3
LEAST_WORDS, SHARE, SEED = 20, (5, 100), 42


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def hashed(own: list[bytes], grams: int = GRAMS) -> Iterator[list[int]]:
    """CRC-32 of all runs of 1, 2 .. ``grams`` words, joined by one space: each run's is that of the run before, carried on."""
    spaced = [b" " + w for w in own]
    level = list(map(crc32, own))
    yield level
    for k in range(1, grams):
        level = list(map(crc32, spaced[k:], level))
        yield level


def texts_of(column: pa.Array) -> list[bytes]:
    """Bytes of every text, null as empty."""
    return [t or b"" for t in column.cast(pa.string()).cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """``bucket, n``: how many n-grams of all texts fall into every bucket that has any. A task ships one row per bucket at most."""
    bucket_of = buckets.__rmod__

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                for level in hashed(words(text), grams):
                    seen.update(map(bucket_of, level))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["bucket", "n"])

    return small_batches(texts).select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of a nat that one n-gram of a bucket speaks for the target, with one added to every count.

    There are ``buckets`` of them, whatever the tables hold, so they pass through the driver.
    """
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (corpus, target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * all_s / ((s.get(b, 0) + 1) * all_t))) for b in range(buckets)]


def measure(gains: list[int], grams: int = GRAMS):
    """A column function of the text: ``n_words, n_features, weight``."""
    bucket_of, gain_of = len(gains).__rmod__, gains.__getitem__

    @F.arrow_udf("struct<n_words: long, n_features: long, weight: long>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts_of(texts):
            own = words(text)
            n = weight = 0
            for level in hashed(own, grams):
                n += len(level)
                weight += sum(map(gain_of, map(bucket_of, level)))
            rows.append((len(own), n, weight))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_features", "weight"])

    return run.asNondeterministic()  # else every use of a field would read the texts again


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, a function of the key alone; a null key counts as an empty one."""
    uniform = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((uniform + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS,
    least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: int = SEED,
) -> DataFrame:
    """Every row's ``doc_id, n_features, weight, score, rank``: drawn rows have ranks 1, 2, 3 ... by descending score, others null.

    Of the N rows with ``least_words`` words or more, ``floor(N * share)`` are drawn; ties go to the smaller id, a null id first; rows that agree in
    id and text are drawn one by one. Null and empty texts have no features, weigh 0 and are never drawn. Without a target text, a bucket
    counts the less the commoner it is in the corpus. Other columns are not read; an empty table gives no rows.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, grams), bucket_counts(target, target_col, buckets, grams), buckets)
    weighed = small_batches(docs).select(F.col(id_col).alias("id"), measure(gains, grams)(F.col(text_col).cast("string")).alias("m")).select("id", "m.*")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = scored.select("*", (F.col("n_words") < least_words).alias("late"), (-F.col("score")).alias("falling"))
    placed = positions(scored, ["late", "falling", "id"], "place")
    drawn = placed.filter(~F.col("late")).count() * share[0] // share[1]
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
