"""Whole texts as flat byte arrays: Arrow batches in, numpy words, lines and chunks out.

A batch is worked on in slices of a few megabytes, so a Python worker's memory does not follow the batch size; a single text
longer than a slice is a slice of its own and is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
BATCH_ROWS = 2000
LIBC = ctypes.CDLL(None)
SPACES = bytes([0x20, 9, 10, 11, 12, 13])


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands Python at most ``BATCH_ROWS`` rows at a time: texts make rows large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


@dataclass
class Slice:
    """Texts ``first .. first + len(offsets) - 1`` of a batch; ``data`` holds them one after another, each with ``\\n`` at its end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """``ids[i]`` is the i-th word as an index into ``vocabulary``; ``bounds`` are the texts' places in ``ids``."""

    ids: np.ndarray
    vocabulary: pa.Array
    bounds: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string array without nulls."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4)).astype(np.int64) if len(array) else np.zeros(1, np.int64)
    body = array.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def packed(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of :func:`flat`."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of whole texts; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type) and not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    _, ends = flat(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, "right")) - 1)
        yield Slice(low, *flat(pc.binary_join_element_wise(texts.slice(low, high - low).cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))))
        low = high
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on from stage to stage beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """256 bytes: separators become a space, A-Z may become a-z."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 32
    return table


WHITE = byte_table(SPACES, lower=False)
WHITE_LOWER = byte_table(SPACES, lower=True)
#: Letters, digits and everything outside ASCII make words; A-Z are lower-cased.
ALNUM_LOWER = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)), lower=True)


def words(part: Slice, table: np.ndarray) -> Words:
    """Words between separators, numbered by an exact dictionary of the slice."""
    data = table[part.data]
    inside = data != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(inside) and inside[0]:
        starts = np.concatenate([[0], starts])
    coded = packed(data, np.append(starts, len(data)) if len(starts) else np.zeros(1, np.int64))
    if not len(starts):
        return Words(np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(len(part) + 1, np.int64), starts)
    coded = coded.dictionary_encode()
    again = pc.ascii_rtrim(coded.dictionary.view(pa.large_string()), " ").dictionary_encode()
    ids = again.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
    return Words(ids, again.dictionary, np.searchsorted(starts, part.offsets), starts)


def hashes(vocabulary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every entry."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(vocabulary))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finisher)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def windows(word_hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside a text, and the texts' bounds among them.

    A text with fewer words, but at least one, has the whole sequence as its only window.
    """
    counts = np.diff(bounds)
    full = np.maximum(counts - size + 1, 0)
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolling = np.full(max(len(word_hashes) - size + 1, 0), size, np.uint64)
        for j in range(size):
            rolling = rolling * multiplier + word_hashes[j:len(rolling) + j]
        short = np.flatnonzero((counts > 0) & (counts < size))
        whole = counts[short].astype(np.uint64)
        for j in range(size - 1):
            live = counts[short] > j
            whole = np.where(live, whole * multiplier + word_hashes[np.where(live, bounds[short] + j, 0)], whole) if len(short) else whole
    sizes = full.copy()
    sizes[short] = 1
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(out_bounds[-1], np.uint64)
    long = np.flatnonzero(full)
    out[spread(out_bounds[long], full[long])] = rolling[spread(bounds[long], full[long])]
    out[out_bounds[short]] = whole
    return mixed(out), out_bounds


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def distinct_in_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every text and the new bounds."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.searchsorted(text[new], np.arange(len(bounds)))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of each text's values; 0 for a text without any."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def encoded_chunks(part: Slice, cut: Callable[[np.ndarray], np.ndarray], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of every text and their bounds, with every distinct chunk of the slice encoded once.

    ``cut`` marks the bytes before which a text may be cut without changing its tokens; ``encode`` gives flat ids, and where in them
    each chunk's begin and how many they are.
    """
    at = cut(part.data)
    at[part.offsets[1:] - 1] = False
    at[part.offsets[:-1]] = True
    starts = np.flatnonzero(at)
    own = np.ones(len(part.data), bool)  # without the line feeds that the slice added
    own[part.offsets[1:] - 1] = False
    data = part.data[own]
    coded = packed(data, np.append(starts - (np.searchsorted(part.offsets, starts, "right") - 1), len(data))).dictionary_encode()
    ids, begins, sizes = encode(coded.dictionary.to_pylist())
    index = coded.indices.to_numpy()
    lengths = sizes[index]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ids[spread(begins[index], lengths)], ends[np.searchsorted(starts, part.offsets)]


class HashTable:
    """Places of 64-bit keys (none negative) in open addressing at a load of an eighth; lookups of whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for k, at in enumerate(self.slot(keys).tolist()):
            n = 1
            while self.keys[at] != -1:
                at, n = (at + 1) & mask, n + 1
            self.keys[at], self.place[at] = keys[k], k
            self.probes = max(self.probes, n)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key in the array that the table was made of, or -1."""
        at = self.slot(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.place[at], np.int32(-1))
        open_ = np.flatnonzero((met != keys) & (met != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            met = self.keys[at[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.place[at[open_[hit]]]
            open_ = open_[~hit & (met != -1)]
        return out


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose stable number is a ``row`` of ``gone``; all columns stay, whatever their names."""
    row = free_name(docs, "row_number")
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone.select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)
