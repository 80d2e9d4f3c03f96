"""Exact de-duplication: counting quotient filters per partition, merged losslessly, then byte verification.

1. One pass fingerprints every normalised text (64 bits) and stages ``(row, doc_id, fingerprint, SHA-256)``.
2. Every partition builds counting quotient filters, one per segment of the fingerprint space. Filters of a segment merge by
   their sorted remainders; counts add up. A text that a third of all rows share is one slot per partition.
3. Fingerprints with a count above one route their rows, and only those, to byte verification: rows group by the whole
   normalised text. Partial aggregation leaves one row per text and task, so a hot text is never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.cells import without_rows
from shelfwise.sources.staging import stage

FINGERPRINT_BITS = 64
SEGMENT_ROWS = 1 << 16
BROADCAST_ROWS = 200_000
FILTER_SCHEMA = "segment int, filter binary"


@dataclass
class QuotientFilter:
    """A counting quotient filter of one segment.

    ``occupied`` has a bit for every quotient with a run, ``run_ends`` one for every slot that ends a run; runs follow one
    another in the order of their quotients, remainders are sorted within a run, and every slot has a counter.
    """

    quotient_bits: int
    remainder_bits: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, quotient_bits: int, remainder_bits: int) -> QuotientFilter:
        """From sorted distinct values below ``2 ** (quotient_bits + remainder_bits)``."""
        quotients = (values >> np.uint64(remainder_bits)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        ends = np.ones(len(values), bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        return cls(quotient_bits, remainder_bits, occupied, ends, values & np.uint64((1 << remainder_bits) - 1), counts.astype(np.uint64))

    def values(self) -> np.ndarray:
        """All values in ascending order."""
        run = np.concatenate([[0], np.cumsum(self.run_ends)[:-1]]) if len(self.run_ends) else np.zeros(0, np.int64)
        return (np.flatnonzero(self.occupied)[run].astype(np.uint64) << np.uint64(self.remainder_bits)) | self.remainders

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Lossless: equal values of several filters meet and their counts add up."""
        values = np.concatenate([f.values() for f in filters])
        distinct, where = np.unique(values, return_inverse=True)
        counts = np.zeros(len(distinct), np.uint64)
        np.add.at(counts, where, np.concatenate([f.counts for f in filters]))
        total = filters[0].quotient_bits + filters[0].remainder_bits
        bits = quotient_bits(len(distinct))
        return cls.build(distinct, counts, bits, total - bits)

    def to_bytes(self) -> bytes:
        """Bit vectors packed, remainders cut to their own width, small counters in one byte with escapes for the large."""
        small = np.minimum(self.counts, 255).astype(np.uint8)
        width = (self.remainder_bits + 7) // 8
        head = np.array([self.quotient_bits, self.remainder_bits, len(self.remainders)], np.int64)
        cut = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return b"".join(x.tobytes() for x in (head, np.packbits(self.occupied), np.packbits(self.run_ends), cut, small, self.counts[small == 255]))

    @classmethod
    def from_bytes(cls, blob: bytes) -> QuotientFilter:
        q, r, n = (int(x) for x in np.frombuffer(blob, np.int64, 3))
        at, width = 24, (r + 7) // 8
        occupied = np.unpackbits(np.frombuffer(blob, np.uint8, ((1 << q) + 7) // 8, at), count=1 << q).astype(bool)
        at += ((1 << q) + 7) // 8
        ends = np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.frombuffer(blob, np.uint8, n, at).astype(np.uint64)
        counts[counts == 255] = np.frombuffer(blob, np.uint64, int((counts == 255).sum()), at + n)
        return cls(q, r, occupied, ends, wide.view("<u8").ravel().astype(np.uint64), counts)


def quotient_bits(slots: int) -> int:
    """Quotients for a load of at most three quarters."""
    return max(3, math.ceil(math.log2(max(1, slots) / 0.75)))


def build_filters(fingerprints: DataFrame, column: str, segments: int) -> DataFrame:
    """Counting quotient filters of every partition, one row per segment that has values; ``segments`` is a power of two."""
    segment_bits = segments.bit_length() - 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            new, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_counts=True)
            values, where = np.unique(np.concatenate([values, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(values)).astype(np.int64)
        low = FINGERPRINT_BITS - segment_bits
        own = (values >> np.uint64(low)).astype(np.int64) if segment_bits else np.zeros(len(values), np.int64)
        for a in np.unique(own):
            x, y = np.searchsorted(own, [a, a + 1])
            q = quotient_bits(y - x)
            inside = values[x:y] & np.uint64((1 << low) - 1)
            blob = QuotientFilter.build(inside, counts[x:y], q, low - q).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([blob], pa.binary())], ["segment", "filter"])

    return fingerprints.select(column).mapInArrow(build, FILTER_SCHEMA)


def merge_filters(filters: DataFrame) -> DataFrame:
    """One filter per segment. A segment's group is bounded by the number of segments chosen for the row count."""

    def merge(table: pa.Table) -> pa.Table:
        blobs = table.column("filter").to_pylist()
        merged = QuotientFilter.merge([QuotientFilter.from_bytes(b) for b in blobs]).to_bytes()
        return pa.table({"segment": table.column("segment").slice(0, 1), "filter": pa.array([merged], pa.binary())})

    return filters.groupBy("segment").applyInArrow(merge, FILTER_SCHEMA)


def repeated_fingerprints(filters: DataFrame, segments: int) -> DataFrame:
    """``(fingerprint, n)`` of every value with a count above one."""
    low = FINGERPRINT_BITS - (segments.bit_length() - 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = QuotientFilter.from_bytes(blob)
                many = f.counts > 1
                whole = f.values()[many] | np.uint64(segment << low if low < 64 else 0)
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(f.counts[many].astype(np.int64))], ["fingerprint", "n"])

    return filters.mapInArrow(read, "fingerprint long, n long")


def normalised(text: Column) -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the group of equal texts that it belongs to.

    ``docs`` is a file scan or another plan with stable row numbers. Other columns are ignored, whatever their names.
    Null texts equal empty ones. Of a group, the smallest id stays (a null id is the largest); of rows that repeat an id and
    its text, exactly one stays. An empty table gives no rows. Returns ``row, doc_id, keep_id, group_size, kept, text_sha256``.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("row", F.monotonically_increasing_id()).withColumn("fingerprint", F.xxhash64("norm"))
    rows = stage(base.select("row", "doc_id", "fingerprint", F.unhex(F.sha2("norm", 256)).alias("sha")))
    segments = 1 << max(0, math.ceil(math.log2(max(1, rows.count()) / SEGMENT_ROWS)))
    repeated = stage(repeated_fingerprints(merge_filters(build_filters(rows, "fingerprint", segments)), segments))
    small = repeated.count() <= BROADCAST_ROWS
    known = repeated.select("fingerprint")
    routed = base.join(F.broadcast(known) if small else known, "fingerprint", "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = stage(routed.groupBy("fingerprint", "norm").agg(F.count("*").alias("n"), first).select("fingerprint", F.unhex(F.sha2("norm", 256)).alias("sha"), "n", "first"))
    joined = rows.join(groups.filter("n > 1"), ["fingerprint", "sha"], "left")
    return joined.select(
        "row",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` does not keep; all columns stay."""
    return without_rows(docs, exact_groups(docs, id_col, text_col).filter(~F.col("kept")))
