"""Token counts by a linear longest-match automaton, without building pieces.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that continue it. A failure link
leads from a node to where matching goes on after the pieces that greedy matching would have cut off by then; their number is
stored at the node. A word's length in pieces is a sum of such numbers along one pass over its characters.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.bytebpe import tokenizer_path
from shelfwise.llm.cells import WHITE, HashTable, per_text, slices, small_batches, words

BEGIN, CONTINUE = 0, 1
POINT_BITS = 21
SIDE_BY_SIDE = 32


class Automaton:
    """Greedy longest-match lengths of words; a word that greedy matching can't cover counts as one unknown piece."""

    def __init__(self, begin: Iterable[str], continuing: Iterable[str]):
        self.children: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((BEGIN, begin), (CONTINUE, continuing)):
            for piece in pieces:
                at = root
                for c in map(ord, piece):
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        final.append(False)
                    at = self.children[at][c]
                if at != root:
                    final[at] = True
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque([BEGIN, CONTINUE])
        while queue:
            node = queue.popleft()
            for c, child in self.children[node].items():
                queue.append(child)
                if final[child]:
                    self.fail[child], self.popped[child] = CONTINUE, 1
                    continue
                back, cut = self.fail[node], self.popped[node]
                while back >= 0 and c not in self.children[back]:
                    cut += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[child], self.popped[child] = self.children[back][c], cut
        edges = [(n << POINT_BITS | c, k) for n, own in enumerate(self.children) for c, k in own.items()]
        self.table = HashTable(np.array([e for e, _ in edges], np.int64))
        self.targets = np.array([k for _, k in edges], np.int64)
        self.fails, self.pops = np.array(self.fail), np.array(self.popped)

    def one(self, points: Iterable[int], node: int = BEGIN, count: int = 0) -> int:
        """Pieces of one word, or -1, from a state on."""
        for c in points:
            while c not in self.children[node]:
                if self.fail[node] < 0:
                    return -1
                count += self.popped[node]
                node = self.fail[node]
            node = self.children[node][c]
        while node != CONTINUE:
            if self.fail[node] < 0:
                return -1
            count += self.popped[node]
            node = self.fail[node]
        return count

    def lengths(self, vocabulary: pa.Array) -> np.ndarray:
        """Pieces of every word, -1 for unknown ones: all words walk side by side, the last few long ones alone."""
        texts = vocabulary.to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        ends = at + sizes
        node, count = np.full(len(texts), BEGIN), np.zeros(len(texts), np.int64)
        live = np.arange(len(texts))
        while len(live) > SIDE_BY_SIDE:
            inside = at[live] < ends[live]
            place = np.full(len(live), -1)
            go = live[inside]
            place[inside] = self.table.find(node[go] << POINT_BITS | points[at[go]])
            step = place >= 0
            node[live[step]] = self.targets[place[step]]
            at[live[step]] += 1
            stay = live[~step]
            ended = (at[stay] == ends[stay]) & (node[stay] == CONTINUE)
            lost = ~ended & (self.fails[node[stay]] < 0)
            count[stay[lost]] = -1
            back = stay[~ended & ~lost]
            count[back] += self.pops[node[back]]
            node[back] = self.fails[node[back]]
            live = np.concatenate([live[step], back])
        for i in live.tolist():
            count[i] = self.one(points[at[i]:ends[i]].tolist(), int(node[i]), int(count[i]))
        return count


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """From a SentencePiece file: pieces with the space symbol begin a word, the others continue it."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [library.id_to_piece(i) for i in range(library.vocab_size()) if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i))]
    return Automaton([p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if p[0] != "▁"])


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every whole text; words are what stands between ASCII white space.

    A null or empty text has none of them. Ids may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = words(part, WHITE)
                pieces = automaton(path).lengths(found.vocabulary)[found.ids]
                unknown = pieces < 0
                columns = [batch.column(0).slice(part.first, len(part)), pa.array(found.counts), pa.array(per_text(np.where(unknown, 1, pieces), found.bounds)), pa.array(per_text(unknown, found.bounds))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
