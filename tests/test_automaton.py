"""The dictionary automaton against plain search."""
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.operators import automaton, extraction
from shelfwise.operators.automaton import Automaton, flat


def brute(texts, terms):
    return {(i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if w in (t or "")}


@pytest.mark.parametrize("cells", [automaton.TABLE_CELLS, 0])
def test_against_search(monkeypatch, cells):
    monkeypatch.setattr(automaton, "TABLE_CELLS", cells)
    monkeypatch.setattr(automaton, "PIECE", 8)
    random.seed(2)
    for alphabet in ("ab", "ab中é", "abcdefgh "):
        for _ in range(30):
            word = lambda n: "".join(random.choice(alphabet) for _ in range(n))
            terms = sorted({word(random.randint(1, 6)) for _ in range(random.randint(1, 30))}, key=str.encode)
            texts = [word(random.randint(0, 60)) for _ in range(20)] + [None, ""]
            own = Automaton([w.encode() for w in terms])
            data, bounds = flat(pa.array(texts))
            assert set(zip(*(x.tolist() for x in own.contained(data, bounds)), strict=True)) == brute(texts, terms)
            best = own.best(data, bounds)
            assert [max((j for i2, j in brute(texts, terms) if i2 == i), default=-1) for i in range(len(texts))] == best.tolist()


def test_many_terms_of_many_lengths():
    """A hundred thousand terms of twenty lengths over a text of a hundred thousand characters, in a few seconds and bytes."""
    random.seed(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = sorted({"".join(random.choice(letters) for _ in range(random.randint(3, 22))) for _ in range(100_000)})
    planted = random.sample([w for w in terms if len(w) > 8], 200)
    text = "".join(random.choice(letters) for _ in range(90_000))
    for w in planted:
        at = random.randrange(len(text))
        text = text[:at] + "_" + w + "_" + text[at:]
    own = Automaton([w.encode() for w in terms])
    t0 = time.process_time()
    _, found = own.contained(*flat(pa.array([text])))
    assert time.process_time() - t0 < 20
    assert {terms[j] for j in found} == {w for w in terms if w in text} >= set(planted[-1:])


def test_pairs_and_longest_over_shards(spark, monkeypatch):
    monkeypatch.setattr(automaton, "SHARD_BYTES", 12)
    terms = ["ab", "abc", "b", "bcd", "Zürich", "中文", "文", "ABC", "zzz", "aa", "cab"]
    texts = [(1, "xabcd"), (2, None), (3, ""), (4, "中文 zürich ABC"), (5, "aaa"), (6, "cab abc"), (6, "b")]
    d = spark.createDataFrame([(w,) for w in [*terms, "ab", "", None]], "w string")
    df = spark.createDataFrame(texts, "id int, t string")
    assert len(list(automaton.shards(d, "w"))) > 2
    wanted = {(i, w) for i, t in texts for w in terms if w in (t or "")}
    got = [tuple(r) for r in extraction.contained_pairs(df, "id", "t", d, "w").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    blind = {(i, w) for i, t in texts for w in terms if w.lower() in (t or "").lower()}
    assert {tuple(r) for r in extraction.contained_pairs(df, "id", "t", d, "w", ignore_case=True).collect()} == blind
    best = {}
    for i, w in wanted:
        best[i] = max(best.get(i, ""), w, key=lambda x: (len(x), x.encode()))
    assert {tuple(r) for r in extraction.longest_contained(df, "id", "t", d, "w", "best").collect()} == set(best.items())
    none = d.where("false")
    assert extraction.contained_pairs(df, "id", "t", none, "w").count() == 0
    assert extraction.longest_contained(df, "id", "t", none, "w", "best").count() == 0
    assert np.all(Automaton([]).best(*flat(pa.array(["x"]))) == -1)
