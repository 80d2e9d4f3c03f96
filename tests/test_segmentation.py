"""Segmentation against all ways to split short texts."""
import itertools
import math
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from shelfwise.operators import segmentation as sg
from shelfwise.operators.automaton import Automaton

UNKNOWN = -30_000_000


def splits(text):
    for cuts in itertools.product([False, True], repeat=len(text) - 1):
        out, word = [], text[0]
        for c, cut in zip(text[1:], cuts, strict=True):
            if cut:
                out.append(word)
                word = c
            else:
                word += c
        yield [*out, word]


def best(text, weights):
    """The heaviest split; of equal ones the longer last word, then the longer one before it."""
    own = lambda w: max(weights.get(w, -math.inf), UNKNOWN if len(w) == 1 else -math.inf)
    return max(splits(text), key=lambda s: (sum(map(own, s)), [len(w) for w in reversed(s)]))


def test_against_all_splits():
    random.seed(6)
    for alphabet in ("茶香", "茶香麻辣"):
        for _ in range(25):
            word = lambda n: "".join(random.choice(alphabet) for _ in range(n))
            weights = {word(random.randint(1, 4)): -random.randint(0, 4) * 1_000_000 for _ in range(random.randint(0, 12))}
            terms = sorted((w.encode() for w in weights), key=bytes)
            own = Automaton(terms)
            own.lengths = list(map(len, terms))
            texts = [word(random.randint(1, 9)) for _ in range(12)] + ["", "latin"]
            found, counts = sg.cut(pa.array(texts), own, sg.np.array([weights[t.decode()] for t in terms], "int64"), UNKNOWN)
            got, at = found.to_pylist(), 0
            for t, n in zip(texts, counts, strict=True):
                assert got[at:at + n] == ([t] if t == "latin" else best(t, weights) if t else [])
                at += n


def test_counts_and_words(spark):
    texts = ["蜂蜜红枣茶 tea x1", "红枣茶,红枣", "蜂蜜", None, "", "红枣" * 3000, "蜂蜜红枣茶 tea x1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    counts = sg.word_counts(df, "t", max_length=3)
    got = {r["word"]: r["n"] for r in counts.collect()}
    runs = [r for t in texts for r in __import__("re").findall("[一-龥]+", t or "")]
    wanted = Counter(r[i:i + k] for r in runs for k in (1, 2, 3) for i in range(len(r) - k + 1))
    assert got == {w: n for w, n in wanted.items() if len(w) == 1 or n >= 2}
    rows = {r["id"]: r["w"] for r in df.select("id", sg.segmented(F.col("t"), counts, ["红枣茶"]).alias("w")).collect()}
    assert rows[0] == ["蜂蜜", "红枣茶", "tea"] and rows[1] == ["红枣茶", "红枣"] and rows[3] == rows[4] == []
    assert "".join(rows[5]) == texts[5]
    words = {r["id"]: r["w"] for r in df.select("id", sg.keywords(F.col("t"), counts, [F.lit("新品"), F.lit(None)], ["红枣茶", "茶"], ["tea"]).alias("w")).collect()}
    assert words[0] == ["蜂蜜", "红枣茶", "新品"] and words[4] == ["新品"]
    assert sg.word_counts(df.where("false"), "t").count() == 0
    assert df.where("false").select(sg.segmented(F.col("t"), counts)).count() == 0
