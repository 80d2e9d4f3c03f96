"""Which terms of a dictionary table a text contains, in time linear in the text whatever the terms' number and lengths.

Terms become a trie in flat arrays with a failure link per node (the longest other node that the node's prefix ends with) and an
output link (the next term on that way). A task walks many texts side by side, one byte a step; long texts go in pieces that overlap by the longest
term, so no array of windows is ever made. A dictionary is dealt by its first bytes into shards of a bounded size, each broadcast on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.staging import stage

#: Bytes of the terms of a shard; its arrays take thirty times as much at most.
SHARD_BYTES = 2 << 20
#: Bytes of text worked on at a time, and the shortest piece of a text.
SLICE_BYTES, PIECE = 1 << 20, 256
#: Automata of at most so many transitions have them all in one table.
TABLE_CELLS = 4 << 20


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings; null counts as empty."""
    wide = values.cast(pa.large_string()).fill_null("") if len(values) else pa.array([], pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1] or b"\0" * 8, np.int64, len(wide) + 1, 8 * wide.offset)
    body = wide.buffers()[2]
    return (np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


class Automaton:
    """``terms``: distinct and not empty, in the order of their bytes. A greater ``rank`` is preferred by :meth:`best`."""

    def __init__(self, terms: Sequence[bytes], rank: Sequence[int] | None = None):
        lengths = np.fromiter(map(len, terms), np.int64, len(terms))
        data = np.frombuffer(b"".join(terms), np.uint8)
        begin = np.cumsum(lengths) - lengths
        self.longest = int(lengths.max(initial=0))
        node = np.zeros(len(terms), np.int64)
        keys, count, levels = [], 1, []
        term = [np.full(1, -1, np.int32)]
        for depth in range(self.longest):
            live = np.flatnonzero(lengths > depth)
            key = node[live] << 8 | data[begin[live] + depth]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            node[live] = count + np.cumsum(new) - 1
            keys.append(key[new])
            levels.append((count, count + int(new.sum())))
            count = levels[-1][1]
            own = np.full(levels[-1][1] - levels[-1][0], -1, np.int32)
            ends = live[lengths[live] == depth + 1]
            own[node[ends] - levels[-1][0]] = ends
            term.append(own)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)  # the child over edge i is node i + 1
        self.term = np.concatenate(term)
        self.fail, self.out = np.zeros(count, np.int32), np.zeros(count, np.int32)
        own_rank = np.append(np.arange(len(terms)) if rank is None else np.asarray(rank), -1)[self.term]
        self.top = own_rank.astype(np.int64)
        self.table = None
        used = np.unique(data)
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(len(used)) + 1  # class 0: bytes of no term
        if count * (len(used) + 1) <= TABLE_CELLS:
            self.table = np.zeros((count, len(used) + 1), np.int32)
        for low, high in [(0, 1), *levels]:
            nodes = np.arange(low, high)
            if low > 1:
                parent, byte = self.keys[nodes - 1] >> 8, self.keys[nodes - 1] & 255
                self.fail[nodes] = self.step(self.fail[parent].astype(np.int64), byte)
            if low:
                f = self.fail[nodes]
                self.out[nodes] = np.where(self.term[f] >= 0, f, self.out[f])
                self.top[nodes] = np.maximum(self.top[nodes], self.top[f])
            if self.table is not None:
                self.table[nodes] = self.table[self.fail[nodes]]
                a, b = np.searchsorted(self.keys, [low << 8, high << 8])
                self.table[self.keys[a:b] >> 8, self.classes[self.keys[a:b] & 255]] = np.arange(a, b) + 1

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        if self.table is not None:
            return self.table[state, self.classes[byte]]
        state, out = state.copy(), np.zeros(len(state), np.int32)
        open_ = np.arange(len(state))
        while len(open_):
            key = state[open_] << 8 | byte[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[open_[hit]] = at[hit] + 1
            open_ = open_[~hit & (state[open_] != 0)]  # at the root a byte that begins no term is passed over
            state[open_] = self.fail[state[open_]]
        return out

    def walk(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per step, the texts and states that have a term behind them, and the places in ``data`` where it ends.

        Pieces overlap, so a term near a piece's beginning may come twice."""
        size = max(PIECE, 4 * self.longest)
        lengths = np.diff(bounds)
        pieces = -(-lengths // size)
        text = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.maximum(number * size - (self.longest - 1), 0)
        length = np.minimum((number + 1) * size, lengths[text]) - start
        order = np.argsort(-length, kind="stable")
        text, at, length = text[order], (bounds[text] + start)[order], length[order]
        state = np.zeros(len(text), np.int64)
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, "left"))  # pieces longer than i
            state[:n] = self.step(state[:n], data[at[:n] + i])
            found = np.flatnonzero(self.top[state[:n]] >= 0)
            if len(found):
                yield text[found], state[found], at[found] + i + 1

    def best(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Per text the greatest rank of a term that it contains, or -1."""
        out = np.full(len(bounds) - 1, -1, np.int64)
        for text, state, _ in self.walk(data, bounds):
            np.maximum.at(out, text, self.top[state])
        return out

    def contained(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and term, each once, in order."""
        n = max(1, int(self.term.max(initial=0)) + 1)
        pairs, held = [np.zeros(0, np.int64)], 0
        for text, state, _ in self.walk(data, bounds):
            state = np.where(self.term[state] >= 0, state, self.out[state])
            while len(state):
                pairs.append(text * n + self.term[state])
                held += len(state)
                state = self.out[state]
                text, state = text[state > 0], state[state > 0]
            if held > SLICE_BYTES:
                pairs = [np.unique(np.concatenate(pairs))]
                held = 0
        found = np.unique(np.concatenate(pairs))
        return found // n, found % n


    def occurrences(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every term once: where in ``data`` it ends, and the term."""
        n = max(1, int(self.term.max(initial=0)) + 1)
        found = [np.zeros(0, np.int64)]
        for _, state, end in self.walk(data, bounds):
            state = np.where(self.term[state] >= 0, state, self.out[state])
            while len(state):
                found.append(end * n + self.term[state])
                state = self.out[state]
                end, state = end[state > 0], state[state > 0]
        found = np.unique(np.concatenate(found))
        return found // n, found % n


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``SLICE_BYTES``."""
    _, ends = flat(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE_BYTES, "right")) - 1)
        yield texts.slice(low, high - low)
        low = high


def shards(terms: DataFrame, term: str) -> Iterator[list[str]]:
    """Distinct terms in the order of their bytes, in runs of about ``SHARD_BYTES``; the driver holds one at a time.

    Texts pass once through every shard, so a dictionary of many shards costs as many passes. The runs come from sizes per pair of first bytes, added up in Spark; pairs whose terms are more than a shard are split in their order.
    """
    own = stage(terms.select(F.col(term).cast("string").alias("w")).where(F.length("w") > 0).distinct())
    lead = F.substring(F.col("w").cast("binary"), 1, 2)
    sizes = own.groupBy(lead.alias("lead")).agg(F.sum(F.octet_length("w")).alias("n"))  # 65,792 rows at most
    upto = F.sum("n").over(Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1))
    runs: dict[int, list[bytes]] = {}
    for row in sizes.select("lead", F.floor(F.coalesce(upto, F.lit(0)) / SHARD_BYTES).alias("run")).collect():
        runs.setdefault(row["run"], []).append(bytes(row["lead"]))
    for run in sorted(runs):
        held, size = [], 0
        within = own.where((lead >= F.lit(min(runs[run]))) & (lead <= F.lit(max(runs[run])))) if len(runs) > 1 else own
        for row in within.orderBy("w").toLocalIterator():
            held.append(row["w"])
            size += len(row["w"].encode())
            if size > SHARD_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def _rank(terms: list[str]) -> np.ndarray:
    """Longer terms first in favour, then those with greater bytes."""
    rank = np.empty(len(terms), np.int64)
    rank[sorted(range(len(terms)), key=lambda i: (len(terms[i]), terms[i].encode()))] = np.arange(len(terms))
    return rank


def _contained(shared: Broadcast):
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        words, automaton = shared.value
        words, out = pa.array(words, pa.string()), []
        for piece in slices(texts):
            at, found = automaton.contained(*flat(piece))
            places = np.searchsorted(at, np.arange(len(piece) + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(places), words.take(pa.array(found))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return run


def _longest(shared: Broadcast):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        words, automaton = shared.value
        words, none = pa.array([*words, None], pa.string()), len(words)
        found = [automaton.best(*flat(piece)) for piece in slices(texts)]
        return words.take(pa.array(np.concatenate([np.where(x < 0, none, x) for x in found]))) if found else pa.array([], pa.string())

    return run


def contained_terms(text: Column, terms: DataFrame, term: str) -> Column:
    """All distinct terms that a text contains, as an array; empty for a null text and without terms."""
    spark = terms.sparkSession
    parts = [_contained(spark.sparkContext.broadcast((own, Automaton([w.encode() for w in own]))))(text) for own in shards(terms, term)]
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def longest_term(text: Column, terms: DataFrame, term: str) -> Column:
    """The longest term that a text contains, of equally long ones that with the greatest bytes; null without one."""
    spark, parts = terms.sparkSession, []
    for own in shards(terms, term):
        rank = _rank(own)
        ordered = [own[i] for i in np.argsort(rank)]
        parts.append(_longest(spark.sparkContext.broadcast((ordered, Automaton([w.encode() for w in own], rank))))(text))
    if len(parts) < 2:
        return parts[0] if parts else F.lit(None).cast("string")
    best = F.array_max(F.transform(F.filter(F.array(*parts), lambda w: w.isNotNull()), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return best["w"]
