"""Token ids on disk in Simple-8b words: selectors, escapes and per-block offsets.

A file is a Parquet part (Spark's own writer commits it, so a lost executor leaves nothing behind) of segment rows. A segment
holds whole documents: their ids, lengths and one payload of 64-bit words. The payload is a sequence of blocks of
``BLOCK`` ids; ``block_offsets`` gives the word at which every block begins, so blocks decode on their own.

A word's upper four bits are its selector, the other 60 the values, lowest bits first. Selector 0 is an escape: the next word is
one raw value of 64 bits. The last word of a block is padded with zeros; the number of ids tells where they end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm import bytebpe
from shelfwise.llm.cells import slices, small_batches
from shelfwise.sources.staging import new_path

#: Fixed values of the format: ids per word and bits per id of selectors 1 to 14.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 1024
COUNTS = np.array([1, *(n for n, _ in PACKINGS)])
BITS = np.array([64, *(b for _, b in PACKINGS)])
SEGMENT_SCHEMA = "part int, start long, doc_ids array<long>, doc_tokens array<long>, n_ids long, block_offsets array<int>, payload binary"


WIDTH_16 = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits of every value."""
    out = np.zeros(len(values), np.uint8)
    for shift in (48, 32, 16, 0):
        part = values >> np.uint64(shift)
        if shift and not part.any():
            continue
        own = WIDTH_16[part & np.uint64(0xFFFF)]
        out = np.where((out == 0) & (own > 0), own + np.uint8(shift), out)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks and every block's first word."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = values
    # The widest value of the next 1, 2, 3, ... values of every place; nothing follows a block's end, so everything fits there.
    widths = np.zeros((blocks, BLOCK + PACKINGS[0][0]), np.uint8)
    widths[:, :BLOCK] = bit_widths(grid).reshape(blocks, BLOCK)
    widest = {1: widths.ravel()}
    selector = np.zeros(widths.size, np.uint8)
    for s in range(len(PACKINGS), 0, -1):
        count, bits = PACKINGS[s - 1]
        near = max(k for k in widest if k <= count)
        far = widest[near][count - near:] if count > near else widest[near]
        if count > near:
            widest[count] = widest[near].copy()
            np.maximum(widest[near][:len(far)], far, out=widest[count][:len(far)])
        fits = (widest[count] <= bits).view(np.uint8)
        selector = selector * (1 - fits) + s * fits
    selector = selector.reshape(blocks, -1)[:, :BLOCK].ravel()
    # All blocks walk from word to word side by side.
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    ends = np.minimum(at + BLOCK, n)
    live, steps = np.arange(blocks), []
    while len(live):
        steps.append((live, at[live]))
        at[live] += COUNTS[selector[at[live]]]
        live = live[at[live] < ends[live]]
    owner, start = np.concatenate([x for x, _ in steps]), np.concatenate([x for _, x in steps])
    order = np.argsort(start)
    owner, start = owner[order], start[order]
    chosen = selector[start]
    sizes = 1 + (chosen == 0)
    where = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.uint64)
    padded = np.concatenate([grid, np.zeros(64, np.uint64)])
    for s in np.unique(chosen):
        pick = chosen == s
        if s == 0:
            words[where[pick] + 1] = grid[start[pick]]
            continue
        count, bits = PACKINGS[s - 1]
        inside = (owner[pick] + 1) * BLOCK
        word = np.full(int(pick.sum()), int(s) << 60, np.uint64)
        for j in range(count):
            value = padded[start[pick] + j]
            if j:
                value = np.where(start[pick] + j < inside, value, np.uint64(0))
            word |= value << np.uint64(j * bits)
        words[where[pick]] = word
    return words, where[np.searchsorted(owner, np.arange(blocks))]


def decode(words: np.ndarray, block_offsets: np.ndarray, n: int) -> np.ndarray:
    """All values; every selector's words are unpacked at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    head = (words >> np.uint64(60)).astype(np.int64)
    live = np.ones(len(words), bool)
    # A raw value follows an escape; raw values may look like anything, so escapes are found from the front of every run.
    if (head == 0).any():
        for at in np.flatnonzero(head == 0):
            if live[at]:
                live[at + 1] = False
    at = np.flatnonzero(live)
    counts = COUNTS[head[at]]
    block = np.searchsorted(block_offsets, at, "right") - 1
    ends = np.cumsum(counts)
    first = np.searchsorted(at, block_offsets)
    start = block * BLOCK + (ends - counts) - (ends - counts)[first][block]
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(head[at]):
        pick = head[at] == s
        if s == 0:
            out[start[pick]] = words[at[pick] + 1]
            continue
        count, bits = PACKINGS[s - 1]
        mask, word, to, end = np.uint64((1 << bits) - 1), words[at[pick]], start[pick], stop[pick]
        for j in range(count):
            inside = to + j < end
            out[to[inside] + j] = (word[inside] >> np.uint64(j * bits)) & mask
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every whole text and write the files in ascending order of the document ids.

    Texts are dealt by ranges of the id before they are encoded. Null texts count as empty, null ids come first, rows with the
    same id stay side by side in no stated order, other columns are ignored, and an empty table gives files without rows.
    """
    tokenizer = tokenizer or bytebpe.tokenizer_path()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch.column(1), bytebpe.SLICE):
                ids, bounds = bytebpe.with_end(*bytebpe.encode(piece, tokenizer), end_id)
                words, offsets = encode(ids)
                row = [[part], [start], [batch.column(0).slice(piece.first, len(piece)).to_pylist()], [np.diff(bounds)], [len(ids)], [offsets], [words.astype("<u8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, ARROW_TYPES, strict=True)], ARROW_NAMES)
                start += len(ids)
        bytebpe.forget()

    dealt.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


ARROW_NAMES = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
ARROW_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.binary()]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segment rows with ``base``, the number of ids in all parts before theirs."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # As many rows as files were written: the number of shuffle partitions bounds it.
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    return files.join(F.broadcast(before), "part")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            words = np.frombuffer(row["payload"].as_buffer() or b"", "<u8")
            ids = decode(words, row["block_offsets"].values.to_numpy().astype(np.int64), row["n_ids"].as_py())
            lengths = row["doc_tokens"].values.to_numpy()
            yield row["base"].as_py() + row["start"].as_py(), row["doc_ids"].values, np.concatenate([[0], np.cumsum(lengths)]), ids.astype(np.uint32)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document, decoded from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, docs, bounds, ids in _texts(batches):
            for a in range(0, len(docs), 1000):
                b = min(a + 1000, len(docs))
                lists = pa.ListArray.from_arrays(pa.array(bounds[a:b + 1] - bounds[a], pa.int32()), pa.array(ids[bounds[a]:bounds[b]].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), pa.array(start + bounds[a:b]), lists], ["doc_id", "start", "ids"])

    return read_segments(spark, path).mapInArrow(read, "doc_id long, start long, ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the decoded files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, docs, bounds, ids in _texts(batches):
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = np.fromiter((zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)), np.int64, len(docs))
            yield pa.RecordBatch.from_arrays([docs, pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_segments(spark, path).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write, read back, and describe what was read."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    return token_digests(docs.sparkSession, path)
