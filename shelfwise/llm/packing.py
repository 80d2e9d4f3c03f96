"""Best-fit packing: a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits one sequence. The program asks for the fewest configurations that cover
the histogram. Multiplicative weights put a price on every length: its share of a sequence, the dual value if nothing is wasted,
falling exponentially with what covers it beyond the demand. A knapsack dynamic program over these prices gives the highest price of any
configuration, which turns the prices into a lower bound, and configurations that reach it. The configurations, with amounts that cover every length, are
the fractional solution; rounds go on until it lies within ``GAP`` of the bound. It is rounded to whole numbers, what rounding leaves is a
smaller program, and the last hundredth goes best-fit, also by counts.

The histogram has at most ``capacity`` entries, so the driver solves for counts and never sees a piece. Pieces meet their
sequences in tasks: a piece's rank within its length says which copy of which configuration holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm import bytebpe
from shelfwise.llm.cells import slices, small_batches
from shelfwise.sources.staging import stage

#: The fractional solution is within this share of its bound, or ``ROUNDS`` demands have been covered; the bound tells which.
GAP, ROUNDS = 0.02, 12
#: How fast a price falls, in demands covered too often; configurations found between two dynamic programs.
RATE, FRESH = 1.0, 32
#: Rounding goes on until best-fit has this share of the volume to place, or a pass places less than ``LEAST_PLACED`` of its sequences.
REMAINDER, LEAST_PLACED = 0.01, 0.25
NONE_LEFT = 1e-9
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
Plan = list[tuple[dict[int, int], int]]
Config = tuple[tuple[int, int], ...]


class Cover(NamedTuple):
    """Amounts of configurations that cover every length, their sum, and a lower bound on any such sum."""

    amounts: dict[Config, float]
    total: float
    bound: float


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The highest total price of a multiset of ``sizes`` (ascending) within every capacity from 0, by dynamic programming."""
    value = np.zeros(capacity + 1)
    for room in range(int(sizes[0]), capacity + 1):
        fit = int(np.searchsorted(sizes, room, "right"))
        value[room] = max(value[room - 1], (value[room - sizes[:fit]] + prices[:fit]).max())
    return value


def configuration(first: int, value: np.ndarray, prices: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> dict[int, int]:
    """A configuration with size ``first`` whose other pieces have the highest total price; of equal ones, it takes large sizes that are still in need."""
    config = {first: 1}
    room = len(value) - 1 - int(sizes[first])
    while value[room] > 0:
        fit = int(np.searchsorted(sizes, room, "right"))
        gains = value[room - sizes[:fit]] + prices[:fit]
        best = gains.max()
        if best < value[room] * (1 - NONE_LEFT):
            room -= 1
            continue
        equal = np.flatnonzero((gains >= best * (1 - NONE_LEFT)) & (need[:fit] > 0))
        wanted = [k for k in equal.tolist() if need[k] >= config.get(k, 0) + 1]
        k = wanted[-1] if wanted else int(np.argmax(gains))
        config[k] = config.get(k, 0) + 1
        room -= int(sizes[k])
    return config


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> Cover:
    """The covering program, solved by multiplicative weights.

    A round covers every length once more, from the largest on. A configuration gets the amount that its scarcest length still needs, so a
    round finds as many configurations as there are lengths at most. After ``t`` rounds, a ``t``-th of all amounts covers every length. Any prices,
    divided by the highest price of a configuration, are feasible for the dual program; their total is a bound.
    """
    demand = counts.astype(np.float64)
    covered, amounts, total = np.zeros(len(sizes)), {}, 0.0
    bound = float(demand @ sizes) / capacity
    for t in range(1, rounds + 1):
        k, age = len(sizes) - 1, FRESH
        while True:
            need = t * demand - covered
            while k >= 0 and need[k] <= NONE_LEFT * demand[k]:
                k -= 1
            if k < 0:
                break
            if age >= FRESH:
                beyond = np.maximum(covered / demand - t, 0) + (need <= NONE_LEFT * demand)
                prices = sizes / capacity * np.exp(-RATE * beyond)
                value, age = knapsack(prices, sizes, capacity), 0
                bound = max(bound, float(demand @ prices) / value[capacity])
            config = configuration(k, value, prices, sizes, need)
            amount = min(need[j] / n for j, n in config.items() if need[j] > NONE_LEFT * demand[j])
            key = tuple(sorted(config.items()))
            amounts[key] = amounts.get(key, 0.0) + amount
            for j, n in config.items():
                covered[j] += amount * n
            total += amount
            age += 1
        if total / t <= (1 + gap) * bound:
            break
    return Cover({key: amount / t for key, amount in amounts.items()}, total / t, bound)


def rounded(cover: Cover, sizes: np.ndarray, left: np.ndarray) -> Plan:
    """Whole numbers of configurations out of the pieces ``left``, which are taken away: amounts rounded down, then, while their pieces last, up.

    Only configurations filled as well as the average are rounded up. Well-filled ones come first.
    """
    filled = {key: sum(int(sizes[k]) * n for k, n in key) for key in cover.amounts}
    usual = sum(filled[key] * amount for key, amount in cover.amounts.items()) / cover.total
    order = sorted(cover.amounts, key=lambda key: (-filled[key], -cover.amounts[key], key))
    plan: Plan = []

    def take(key: Config, most: int) -> None:
        copies = min([most, *(int(left[k]) // n for k, n in key)])
        if copies > 0:
            for k, n in key:
                left[k] -= n * copies
            plan.append((dict(key), copies))

    for key in order:
        take(key, int(cover.amounts[key] + NONE_LEFT))
    for key in order:
        if filled[key] >= usual and cover.amounts[key] % 1 > NONE_LEFT:
            take(key, 1)
    return plan


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over counts: sequences with the same content are one entry, so the work follows the lengths, not the pieces."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    there = np.zeros(capacity + 1, bool)

    def put(room: int, config: dict[int, int], copies: int) -> None:
        rooms.setdefault(room, []).append((config, copies))
        there[room] = True

    for k in range(len(sizes) - 1, -1, -1):
        size, left = int(sizes[k]), int(counts[k])
        while left:
            fits = int(np.argmax(there[size:])) + size
            if not there[fits]:
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, {k: each}, left // each)
                    left %= each
                if left:
                    put(capacity - left * size, {k: left}, 1)
                break
            config, copies = rooms[fits].pop()
            there[fits] = bool(rooms[fits])
            take = min(left, copies)
            put(fits - size, config | {k: config.get(k, 0) + 1}, take)
            if copies > take:
                put(fits, config, copies - take)
            left -= take
    return [entry for entries in rooms.values() for entry in entries]


def programmed(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """Rounded solutions of the program, and the counts that they leave: each pass solves it for what the passes before left."""
    left = counts.copy()
    plan: Plan = []
    volume = int(sizes @ counts)
    while int(sizes @ left) > REMAINDER * volume:
        live = np.flatnonzero(left)
        cover = fractional(sizes[live], left[live], capacity)
        own = Cover({tuple((int(live[k]), n) for k, n in key): amount for key, amount in cover.amounts.items()}, cover.total, cover.bound)
        placed = rounded(own, sizes, left)
        plan += placed
        if sum(copies for _, copies in placed) < LEAST_PLACED * cover.total:
            break
    return plan, left


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Whole numbers of configurations (index of size to count) that hold every piece exactly once: the program's, and best-fit for the remainder."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    if not len(sizes):
        return []
    plan, left = programmed(sizes, counts, capacity)
    return plan + best_fit(sizes, left, capacity)


def slot_table(sizes: np.ndarray, plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ascending first ranks of the runs of pieces, and for each run its first sequence, place and count in a sequence.

    Rank ``r`` of a run that begins at ``f`` lies in sequence ``first + (r - f) // n`` at offset ``place + (r - f) % n * length``.
    """
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used = dict.fromkeys(map(int, sizes), 0)
    sequence = 0
    for config, copies in plan:
        place = 0
        for k, n in sorted(config.items()):
            size = int(sizes[k])
            runs.setdefault(size, []).append((used[size], sequence, place, n))
            used[size] += n * copies
            place += n * size
        sequence += copies
    return {size: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for size, r in runs.items()}


def assign(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences of ``capacity`` as the program finds, gapless from 0.

    ``pieces`` is a stored table with ``part`` (the task that wrote a row) and ``local_rank`` (the row's rank among the rows of its
    part and length). Lengths are 1 to ``capacity``. Ties of length are interchangeable; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    cells = stage(pieces.groupBy(F.col(length_col).alias("size"), "part").agg(F.count("*").alias("n")))
    # One group per length; a group has one row per task that wrote pieces.
    bases = cells.select("size", "part", (F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).alias("base"))
    histogram = sorted((int(r["size"]), int(r["n"])) for r in cells.groupBy("size").agg(F.sum("n").alias("n")).collect())  # at most ``capacity`` rows
    sizes, counts = np.array([s for s, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    slots = spark.sparkContext.broadcast(slot_table(sizes, solve(sizes, counts, capacity)))
    names = [*pieces.columns, "base"]
    out = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = (batch.column(names.index("base")).to_numpy(zero_copy_only=False) + batch.column(names.index("local_rank")).to_numpy(zero_copy_only=False)).astype(np.int64)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:b]
                size = int(length[rows[0]])
                firsts, sequences, places, each = slots.value[size]
                run = np.searchsorted(firsts, rank[rows], "right") - 1
                within = rank[rows] - firsts[run]
                sequence[rows] = sequences[run] + within // each[run]
                offset[rows] = places[run] + within % each[run] * size
            kept = [batch.column(i) for i, n in enumerate(names) if n != "base"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*(n for n in names if n != "base"), "sequence_id", "offset"])

    ranked = pieces.join(bases.withColumnRenamed("size", length_col), [length_col, "part"])
    return ranked.select(*names).mapInArrow(place, out)


def cut_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Token pieces of every whole text: only longer documents are cut, and then all pieces but the first are full.

    A null text is empty and still has its end id; null ids, repeated rows and empty tables need no special care. Other columns are ignored.
    """
    tokenizer = tokenizer or bytebpe.tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch.column(1), bytebpe.SLICE):
                ids, bounds = bytebpe.with_end(*bytebpe.encode(piece, tokenizer), end_id)
                total = np.diff(bounds)
                n = -(-total // capacity)
                head = total - (n - 1) * capacity
                owner = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(number == 0, 0, head[owner] + (number - 1) * capacity)
                length = np.where(number == 0, head[owner], capacity)
                raw = memoryview(ids.astype("<u4")).cast("B")
                at = bounds[:-1][owner] + start
                crc = np.fromiter((zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at, at + length, strict=True)), np.int64, len(at))
                rank = np.empty(len(at), np.int64)
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank[order] = np.arange(len(order)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                names = batch.column(0).slice(piece.first, len(piece)).take(pa.array(owner))
                columns = [names, pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(at), part), pa.int32()), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECE_SCHEMA.split(", ")])
        bytebpe.forget()

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A null text is empty and has one piece with its end id alone. Null ids and repeated rows are documents of their own; pieces of equal length are
    interchangeable. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    return assign(stage(cut_pieces(docs, capacity, tokenizer, id_col, text_col)), capacity).drop("part", "local_rank")
