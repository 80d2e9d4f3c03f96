"""SentencePiece BPE in numpy: merge rounds over flat symbol arrays, and the way back.

Words (a run of spaces and what follows) of all texts of a slice lie in one symbol array. In a round every word finds its lowest
pair rank by a segmented minimum, merges all leftmost non-overlapping pairs of that rank at once, and the array is compacted;
words without a known pair leave. A merge whose piece could take part in a pair of the same or a lower rank is done alone,
as the library's queue would, so ids equal the library's in every case.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.bytebpe import tokenizer_path
from shelfwise.llm.cells import HashTable, Slice, encoded_chunks, flat, packed, slices, small_batches, spread

NONE = np.int32(2**31 - 1)
SPACE = "▁"
ASCII = 128


def model_path() -> str:
    return tokenizer_path("piece_bpe_32k.model")


class PieceModel:
    """Vocabulary, pair table and byte pieces of a SentencePiece BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = library.vocab_size()
        self.end = library.eos_id()
        pieces = [library.id_to_piece(i) for i in range(self.size)]
        control = [library.is_control(i) or library.is_unused(i) for i in range(self.size)]
        single = [library.is_byte(i) for i in range(self.size)]
        unknown = [library.is_unknown(i) for i in range(self.size)]
        special = [a or b or c for a, b, c in zip(control, single, unknown, strict=True)]
        number = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in number):
            raise ValueError("a piece has a space after another character: words can't be encoded one by one")
        self.byte_ids = np.array([i for _, i in sorted((int(p[3:5], 16), i) for i, p in enumerate(pieces) if single[i])], np.int64)
        scores = {p: library.get_score(i) for p, i in number.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # A character outside the vocabulary is the number size + code point.
        symbol = lambda s: number.get(s, self.size + ord(s) if len(s) == 1 else None)
        keys, ranks, merged = [], [], []
        self.alone = np.zeros(self.size, bool)
        for piece, i in number.items():
            own = rank[scores[piece]]
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is None or right is None:
                    continue
                keys.append(left << 32 | right)
                ranks.append(own)
                merged.append(i)
                for part, s in ((piece[:cut], left), (piece[cut:], right)):
                    if len(part) > 1 and rank[scores[part]] >= own:
                        self.alone[s] = True
        self.table = HashTable(np.array(keys, np.int64))
        self.ranks, self.merged = np.array(ranks, np.int32), np.array(merged, np.int32)
        self.of_ascii = np.array([number.get(SPACE if c == 32 else chr(c), self.size + c) for c in range(ASCII)], np.int64)
        self.of_wide = {ord(p): i for p, i in number.items() if len(p) == 1}
        text = ["" if control[i] else " ⁇ " if unknown[i] else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
        self.bytes_of = pa.array([bytes([int(p[3:5], 16)]) if single[i] else t.encode() for i, (p, t) in enumerate(zip(pieces, text, strict=True))], pa.large_binary())
        self.silent = np.array(control)
        self.spaced = np.array([not special[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self.decimal = pa.array([f"{i} ".encode() for i in range(self.size)], pa.large_binary())

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of every pair; rank ``NONE`` where it is no piece."""
        place = self.table.find(left << 32 | right)
        return np.where(place < 0, NONE, self.ranks[place]), self.merged[place]

    def symbols(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of every character and the chunks' bounds."""
        text = b"".join(chunks).decode().encode("utf-32-le")
        points = np.frombuffer(text, np.uint32).astype(np.int64)
        lengths = np.fromiter((len(c.decode()) for c in chunks), np.int64, len(chunks))
        out = self.of_ascii[np.minimum(points, ASCII - 1)]
        wide = np.flatnonzero(points >= ASCII)
        if len(wide):
            distinct, where = np.unique(points[wide], return_inverse=True)
            out[wide] = np.array([self.of_wide.get(int(p), self.size + int(p)) for p in distinct], np.int64)[where]
        return out, np.concatenate([[0], np.cumsum(lengths)])

    def merge(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every chunk and their bounds: rounds until no pair remains."""
        symbols, bounds = self.symbols(chunks)
        word = np.repeat(np.arange(len(chunks)), np.diff(bounds))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks = np.full(len(symbols), NONE, np.int32)
            merged = np.zeros(len(symbols), np.int32)
            same = np.flatnonzero(word[1:] == word[:-1])
            ranks[same], merged[same] = self.find(symbols[same], symbols[same + 1])
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(word))
            lowest = np.minimum.reduceat(ranks, starts)
            ended = np.repeat(lowest == NONE, sizes)
            if ended.any():
                done.append((word[ended], symbols[ended]))
                live = ~ended
                symbols, word, ranks, merged = symbols[live], word[live], ranks[live], merged[live]
                sizes, lowest = sizes[lowest != NONE], lowest[lowest != NONE]
            if not len(symbols):
                break
            chosen = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # Neighbouring candidates overlap: every second one of a run, from its left end.
            new_run = np.diff(chosen, prepend=-2) != 1
            first_of_run = chosen[new_run][np.cumsum(new_run) - 1]
            picked = (chosen - first_of_run) % 2 == 0
            lonely = self.alone[merged[chosen]]
            if lonely.any():
                first = np.diff(word[chosen], prepend=-1) != 0
                picked &= first | ~np.isin(word[chosen], word[chosen][lonely])
            at = chosen[picked]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        words_ = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(words_, kind="stable")
        ids, words_ = self.bytes_for_unknown(ids[order], words_[order])
        return ids, np.searchsorted(words_, np.arange(len(chunks) + 1))

    def bytes_for_unknown(self, ids: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become their bytes' pieces."""
        outside = np.flatnonzero(ids >= self.size)
        if not len(outside):
            return ids, owners
        distinct, where = np.unique(ids[outside], return_inverse=True)
        data, offsets = flat(pa.array([chr(int(c) - self.size).encode() for c in distinct], pa.large_binary()))
        sizes = np.ones(len(ids), np.int64)
        sizes[outside] = np.diff(offsets)[where]
        out = np.repeat(ids, sizes)
        starts = np.cumsum(sizes) - sizes
        out[spread(starts[outside], sizes[outside])] = self.byte_ids[data[spread(offsets[:-1][where], sizes[outside])]]
        return out, np.repeat(owners, sizes)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text of a slice of :func:`prefixed` texts, and their bounds."""

        def run(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, bounds = self.merge(chunks)
            return ids, bounds[:-1], np.diff(bounds)

        return encoded_chunks(part, word_cuts, run)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of every text and their bounds: the piece of the leading space dropped, bytes that are no UTF-8 replaced one by one."""
        data, offsets = flat(self.bytes_of.take(pa.array(ids)))
        at = offsets[bounds]
        first, led = bounds[:-1].copy(), np.zeros(len(bounds) - 1, bool)
        open_ = np.flatnonzero(first < bounds[1:])
        while len(open_):  # the first piece that isn't a control symbol
            led[open_] = self.spaced[ids[first[open_]]]
            open_ = open_[self.silent[ids[first[open_]]]]
            first[open_] += 1
            open_ = open_[first[open_] < bounds[open_ + 1]]
        keep = np.ones(len(data), bool)
        keep[at[:-1][led]] = False
        data, ends = data[keep], at - np.concatenate([[0], np.cumsum(led)])
        try:
            codecs.utf_8_decode(data.tobytes(), "strict", True)
        except UnicodeDecodeError:
            data, ends = flat(pa.array([bytes(data[a:b]).decode("utf-8", "one-by-one").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.large_binary()))
        return data, ends


codecs.register_error("one-by-one", lambda e: ("�" * (e.end - e.start), e.end))


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def word_cuts(data: np.ndarray) -> np.ndarray:
    """True at a space after a character that is no white space and can't end the space symbol itself."""
    cut = data == 32
    cut[:1] = False
    cut[1:] &= (data[:-1] > 32) & (data[:-1] != 0x81)
    return cut


def prefixed(texts: pa.Array) -> pa.Array:
    """Every text that isn't empty with the space that the model puts before it; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ids with the end id, and bounds of every slice."""
    own = model(path)
    for part in slices(prefixed(texts)):
        ids, bounds = own.encode(part)
        out = np.full(len(ids) + len(part), own.end, np.int64)
        ends = bounds + np.arange(len(bounds))
        keep = np.ones(len(out), bool)
        keep[ends[1:] - 1] = False
        out[keep] = ids
        yield part.first, out, ends


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text and the end id.

    A null or empty text has the end id alone. Ids may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, bounds in encoded(batch.column(1), path):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), lists], ["doc_id", "ids"])

    return _ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded_docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            bounds = lists.offsets.to_numpy().astype(np.int64)
            data, ends = model(path).decode(lists.values.to_numpy()[bounds[0]:bounds[-1]].astype(np.int64), bounds - bounds[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(data, ends).view(pa.large_string()).cast(pa.string())], ["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text: encoded, then decoded from its ids, in one task."""
    path = path or model_path()

    def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        view = memoryview(np.ascontiguousarray(data))
        return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(starts, ends, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, bounds in encoded(batch.column(1), path):
                numbers, at = flat(model(path).decimal.take(pa.array(ids)))
                of_ids = digests(numbers, at[bounds[:-1]], at[bounds[1:]] - 1)
                data, ends = model(path).decode(ids, bounds)
                of_text = digests(data, ends[:-1], ends[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(of_ids)), pa.array(np.diff(bounds)), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
