"""License scans by diagonal voting.

All rolling two-word hashes of all texts meet the positions of the templates' in a Spark join. A match votes for its diagonal, the
text position minus the template position. A diagonal with all votes of its template is a span of its own; neighbouring diagonals
with some of them, as words inserted or left out make, merge into one. Spans with as many votes as any that the words can accept has
reach as far as their outer diagonals, and are verified on the words of the text.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.cells import ALNUM_LOWER, Words, hashes, slices, small_batches, windows, words
from shelfwise.sources.staging import stage

GRAM = 2
#: Merged diagonals lie at most so many words apart.
GAP = 3
#: The part of a template's words, and of its own, that a span must have in common to count.
SHARE = 0.8
#: Tables of at most so many rows and spans are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_SPANS = 50_000, 500_000
ROWS_PER_BATCH = 1 << 17

#: The phrases whose exact places are the base result, and the phrases and notices that add labels.
BASE_PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "boost"),
    ("isc license", "isc"),
    ("released into the public domain", "public-domain"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("all rights reserved", "proprietary"),
]


def templates(base: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple[list[str], str, bool]]:
    """Words, label and whether it is a base phrase, of every template; each has two words at least."""
    out = [(p.split(), label, True) for p, label in base] + [(p.split(), label, False) for p, label in notices]
    if any(len(w) < GRAM for w, _, _ in out):
        raise ValueError(f"a template needs {GRAM} words at least")
    return out


def grams(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all word pairs and the texts' bounds among them; a text of one word has one gram that no template has."""
    return windows(hashes(found.vocabulary)[found.ids] if len(found.ids) else np.zeros(0, np.uint64), found.bounds, GRAM)


def rolling_grams(docs: DataFrame) -> DataFrame:
    """``row, pos, gram`` of every word pair of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1)):
                own, bounds = grams(words(part, ALNUM_LOWER))
                counts = np.diff(bounds)
                row = np.repeat(rows[part.first:part.first + len(part)], counts)
                pos = np.arange(len(own)) - np.repeat(bounds[:-1], counts)
                for a in range(0, len(own), ROWS_PER_BATCH):
                    b = a + ROWS_PER_BATCH
                    yield pa.RecordBatch.from_arrays([pa.array(row[a:b]), pa.array(pos[a:b]), pa.array(own[a:b].view(np.int64))], ["row", "pos", "gram"])

    return docs.select("row", "text").mapInArrow(run, "row long, pos long, gram long")


def least_votes(n_words: int) -> int:
    """The fewest word pairs left in any span of ``SHARE``: every word left out or inserted may part two runs of words in common."""
    share = Fraction(str(SHARE))
    return max(1, min(common - 1 - (n_words - common) - (int(common / share) - common) for common in range(math.ceil(n_words * share), n_words + 1)))


def template_grams(known: list[tuple[list[str], str, bool]]) -> list[tuple[int, int, int, int, int]]:
    """``gram, template, tpos, n_grams, least`` rows."""
    out = []
    for t, (own, _, _) in enumerate(known):
        part = next(slices(pa.array([" ".join(own)])))
        values, _ = grams(words(part, ALNUM_LOWER))
        out += [(int(g), t, p, len(values), least_votes(len(own))) for p, g in enumerate(values.view(np.int64))]
    return out


def spans(docs: DataFrame, known: list[tuple[list[str], str, bool]]) -> DataFrame:
    """``row, template, first, last``: word places of the diagonals worth a look."""
    places = docs.sparkSession.createDataFrame(template_grams(known), "gram long, template int, tpos long, n_grams int, least int")
    votes = rolling_grams(docs).join(F.broadcast(places), "gram")  # a few rows per template
    diagonals = votes.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy("row", "template", "n_grams", "least", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + GRAM - 1).alias("last"))
    whole = F.col("votes") == F.col("n_grams")
    exact = diagonals.filter(whole).select("row", "template", "first", "last")
    # One text's diagonals of one template lie in a window: a text bounds it.
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    starts = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True))
    grouped = diagonals.filter(~whole).withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(order))
    # The words before the first vote and after the last may be in common, too.
    reach = [F.greatest(F.min_by("diagonal", "first"), F.lit(0)).alias("first"), (F.max_by("diagonal", "last") + F.col("n_grams") + GRAM - 2).alias("last")]
    merged = grouped.groupBy("row", "template", "n_grams", "least", "group").agg(F.sum("votes").alias("votes"), *reach).filter(F.col("votes") >= F.col("least"))
    return exact.unionByName(merged.select("row", "template", "first", "last"))


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, share: double>>"


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE_PHRASES, notices: list[tuple[str, str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License findings of every text: the columns of ``RESULT``.

    Words are runs of ASCII letters, A-Z lower-cased, digits and everything outside ASCII. ``n_base`` counts the exact places of base
    phrases, overlapping ones too; ``score`` is the largest part of a template that a verified span has. Null and empty texts have
    no words and no findings. ``docs`` is a file scan or another plan with stable row numbers; ids may be null or repeat, other columns
    are ignored, and an empty table gives no rows.
    """
    known = templates(base, notices)
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    found = stage(spans(rows, known).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("template", "first", "last"))).alias("found")))  # one text's spans
    size = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("spans")).first()
    small = size["rows"] <= BROADCAST_ROWS and size["spans"] <= BROADCAST_SPANS

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                own = words(part, ALNUM_LOWER)
                findings = batch.column(2).slice(part.first, len(part)).to_pylist()
                out = [judged(own, i, f) for i, f in enumerate(findings)]
                columns = [batch.column(0).slice(part.first, len(part)), pa.array(own.counts), *(pa.array([o[k] for o in out], t) for k, t in enumerate(TYPES))]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    def judged(own: Words, i: int, findings: list[dict] | None) -> tuple:
        exact, seen = [], []
        for f in findings or []:
            wanted, label, is_base = known[f["template"]]
            low, high, first, last, share = int(own.bounds[i]), int(own.bounds[i + 1]), f["first"], f["last"], 1.0
            if own.vocabulary.take(pa.array(own.ids[low + first:low + last + 1])).to_pylist() != wanted:
                # Inserted words may part the template's outer words from the rest.
                extra = int(len(wanted) / Fraction(str(SHARE))) - len(wanted)
                a = max(low, low + first - extra)
                got = own.vocabulary.take(pa.array(own.ids[a:min(low + last + 1 + extra, high)])).to_pylist()
                if sum(w in wanted for w in got) < SHARE * len(wanted):
                    continue
                common = [m for m in difflib.SequenceMatcher(None, got, wanted, autojunk=False).get_matching_blocks() if m.size]
                runs = [common[j:k] for j in range(len(common)) for k in range(j + 1, len(common) + 1)]
                share, first, last = max((sum(m.size for m in r) / max(len(wanted), r[-1].a + r[-1].size - r[0].a), a - low + r[0].a, a - low + r[-1].a + r[-1].size - 1) for r in runs)
            if share < SHARE:
                continue
            seen.append((label, first, last, share))
            if is_base and share == 1.0:
                exact.append((first, last, label))
        joined = lambda labels: ",".join(sorted(set(labels)))
        return (
            len(exact), min((e[0] for e in exact), default=None), max((e[0] for e in exact), default=None), joined(e[2] for e in exact), joined([*(e[2] for e in exact), *(s[0] for s in seen)]),
            max((s[3] for s in seen), default=0.0), [dict(zip(("label", "first", "last", "share"), s, strict=True)) for s in sorted(seen)],
        )

    joined = rows.join(F.broadcast(found) if small else found, "row", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(verify, RESULT)


SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(SPAN)]
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
