"""Ids of whole texts by the tokenizers library and a byte-level BPE file, each distinct stretch of a slice encoded once."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from shelfwise.llm.cells import Slice, encoded_chunks, flat, release

#: Chunks that go to the library as one text, and bytes that it gets at a time: its result objects take a hundred times as much.
JOINED, IN_FLIGHT = 500, 1 << 17
#: Bytes of text worked on at a time.
SLICE = 1 << 20
#: Chunks that a worker remembers, and their bytes: about 50 MB with the table around them.
KNOWN_CHUNKS, KNOWN_BYTES = 200_000, 8 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files lie; another file's path may be passed to every operator instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer and every id's length in bytes (a byte is one character of a byte-level token)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    added = loaded.get_added_tokens_decoder()
    return loaded, np.array([len(added[i].content.encode() if i in added else loaded.id_to_token(i) or "") for i in range(loaded.get_vocab_size())], np.int64)


@functools.lru_cache(maxsize=2)
def added_tokens(path: str) -> re.Pattern[bytes] | None:
    """Where the library takes an added token out of a text, before its pattern finds words: the leftmost, then the longest."""
    added = tokenizer(path)[0].get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or "\n" in t.content for t in added):
        raise ValueError("added tokens that look at what stands beside them, or hold a line feed, are not supported")
    return re.compile(b"|".join(re.escape(x) for x in sorted((t.content.encode() for t in added), key=len, reverse=True))) if added else None


VISIBLE = np.zeros(256, bool)
VISIBLE[33:127] = True
WIDE = np.arange(256) >= 128
#: The byte before the last of every Unicode white space outside ASCII, and some others.
UNSURE = np.isin(np.arange(256), [0xC2, 0x9A, 0x80, 0x81])


def ends_visible(last: np.ndarray, before_last: np.ndarray) -> np.ndarray:
    return VISIBLE[last] | (WIDE[last] & ~UNSURE[before_last])


BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])
MARK = VISIBLE & ~ALNUM


def word_cuts(data: np.ndarray) -> np.ndarray:
    """Where the pattern of byte-level BPE always begins a new word, whatever comes before and after.

    These are white space after a visible character, and an ASCII mark after an ASCII letter or digit.
    """
    cut = np.zeros(len(data), bool)
    cut[2:] = BLANK[data[2:]] & ends_visible(data[1:-1], data[:-2])
    cut[1:] |= MARK[data[1:]] & ALNUM[data[:-1]]
    return cut


def token_cuts(data: np.ndarray, path: str) -> np.ndarray:
    """:func:`word_cuts`, with every added token a chunk of its own."""
    cut = word_cuts(data)
    added = added_tokens(path)
    for found in added.finditer(data) if added else ():
        a, b = found.span()
        cut[a + 1:b] = False
        cut[a] = True
        cut[b] = True  # at least the text's closing line feed follows
    return cut


def joinable_chunks(first: np.ndarray, last: np.ndarray, before_last: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Chunks that begin with white space and end visibly: one after another, each begins where the pattern begins a word."""
    return (lengths > 2) & BLANK[first] & ends_visible(last, before_last)


class Encoder:
    """The library behind a bounded table of chunks that this Python worker has met: a chunk in it is not encoded again."""

    def __init__(self, path: str):
        self.model, self.sizes = tokenizer(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.ids, self.begins, self.lengths = (np.zeros(0, t) for t in (np.uint32, np.int64, np.int64))

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.begins) > KNOWN_CHUNKS or self.bytes > KNOWN_BYTES:
            self.clear()
        at = np.fromiter((self.known.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = [chunks[i] for i in new]
            ids, begins, lengths = self.encode(missing)
            at[new] = len(self.begins) + np.arange(len(new))
            self.known.update(zip(missing, at[new].tolist(), strict=True))
            self.bytes += sum(map(len, missing)) + 4 * len(ids)
            self.begins = np.concatenate([self.begins, begins + len(self.ids)])
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        return self.ids, self.begins[at], self.lengths[at]

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Many chunks at a time go to the library in one text; bytes tell their tokens apart."""
        data, bounds = flat(pa.array(chunks, pa.large_binary()))
        lengths = np.diff(bounds)
        end = np.maximum(bounds[1:], 2)
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        joinable = joinable_chunks(padded[bounds[:-1]], padded[end - 1], padded[end - 2], lengths)
        order = np.concatenate([np.flatnonzero(joinable), np.flatnonzero(~joinable)])
        n = int(joinable.sum())
        groups = itertools.chain((b"".join([chunks[i] for i in order[a:min(a + JOINED, n)]]) for a in range(0, n, JOINED)), (chunks[i] for i in order[n:]))
        ids = np.concatenate(list(self.flat_ids(groups)) or [np.zeros(0, np.uint32)])
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        places = np.searchsorted(ends, np.concatenate([[0], np.cumsum(lengths[order])]))
        begins, counts = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        begins[order], counts[order] = places[:-1], np.diff(places)
        return ids, begins, counts


    def flat_ids(self, groups: Iterator[bytes]) -> Iterator[np.ndarray]:
        """Ids of texts one after another; the library gets ``IN_FLIGHT`` bytes at a time, or one longer text."""
        held: list[bytes] = []

        def flush() -> np.ndarray:
            got = [e.ids for e in self.model.encode_batch_fast([g.decode() for g in held], add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(got), np.uint32, sum(map(len, got)))

        size = 0
        for group in groups:
            if held and size + len(group) > IN_FLIGHT:
                yield flush()
                held, size = [], 0
            held.append(group)
            size += len(group)
        if held:
            yield flush()


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    """Drop the remembered chunks: a worker that lives on does other work beside a full executor. The tokenizer itself stays."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
    release()


def encode(part: Slice, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids as the library gives them (no special tokens added, such as the text holds recognised) and the bounds of every text."""
    return encoded_chunks(part, functools.partial(token_cuts, path=path), encoder(path))


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """One end id after every text."""
    out = np.full(len(ids) + len(bounds) - 1, end, np.uint32)
    ends = bounds + np.arange(len(bounds))
    keep = np.ones(len(out), bool)
    keep[ends[1:] - 1] = False
    out[keep] = ids
    return out, ends
