"""Merkle manifest, importance resampling and suffix tree against brute force, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""
import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import merkle, resample, suffix_tree

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key long, tree string, idx int, steps string, place long, id string, late boolean, row long, learn int, s string, name int, bucket int"


def sample():
    random.seed(5)
    vocabulary = ["the", "of", "and", "À", "été", "übér", "rain", "Rain-fall", "x1", "99", "mo"]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    rows = [(i, f"src{i % 3}", "hot" if i < 1500 else random.choice(["a", "é", "Z"]), i % 50, prose(i % 40)) for i in range(1600)]
    rows += [(2000, None, None, None, None), (2001, None, None, 3, ""), (None, "s", "hot", 1, "no id"), (None, None, None, None, None), (7, "s", "hot", 2, "again"), (7, "s", "hot", 2, "again"), (2100, "s", "alone", 9, "one leaf")]
    rows += [(2200, "s", "", 0, " \n\t "), (2201, "s", "hot", 1, "A Long One " * 40_000), (2202, "s", "hot", 1, "tail of blanks the \n "), (2203, "s", "hot", 1, "\x00 zero")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    path = tempfile.mkdtemp(prefix="llm-docs-") + "/t"
    spark.createDataFrame([(*r, 1, "t", 2, "s", 3, "i", True, 4, 5, "x", 6, 7) for r in sample()], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    row = (*row[:3], None if row[3] is None else row[3] + more, row[4])
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes):
    """The root and every leaf's siblings, left and right, level by level."""
    ways, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, below = [], []
        for a in range(0, len(nodes), 2):
            run = nodes[a:a + 2]
            for k in range(len(run)):
                for x in under[a + k]:
                    ways[x].append((run[:k], run[k + 1:]))
            above.append(H(*run))
            below.append(sum(under[a:a + 2], []))
        nodes, under = above, below
    return nodes[0], ways


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in names:
        by[k].sort(key=lambda x: x[:3])
        trees[k] = grown([x[2] for x in by[k]])
    root, upper = grown([trees[k][0] for k in names])
    for k, way in zip(names, upper, strict=True):
        for x, own in zip(by[k], trees[k][1], strict=True):
            steps, row = own + way, x[3]
            h = leaf(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for left, right in steps:
                h = H(*left, h, *right)
            yield row[0], x[2], trees[k][0], root, H(*(d for s in steps for side in s for d in side)), h, h == root


def test_manifest(docs, monkeypatch):
    wanted = Counter(brute_manifest(sample()))
    assert Counter(tuple(r) for r in merkle.tamper_check(docs).collect()) == wanted
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)  # many rounds of growth
    assert Counter(tuple(r) for r in merkle.tamper_check(docs).collect()) == wanted
    proofs = merkle.manifest(docs).withColumn("again", merkle.fold(F.col("leaf"), F.col("steps")))
    assert proofs.filter("again != root").count() == 0
    assert merkle.tamper_check(docs.filter("false")).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_small_manifests(spark, n):
    for rows in ([(i, "s", "en", i, "t") for i in range(n)], [(i, "s", f"l{i}", i, "t") for i in range(n)]):
        table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        assert Counter(tuple(r) for r in merkle.tamper_check(table).collect()) == Counter(brute_manifest(rows))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_resample(spark, docs):
    target = spark.createDataFrame([(1, "rain of the été"), (2, None), (3, "99 x1")], "item_id long, text string")
    own = [(r[0], *features(r[4])) for r in sample()]
    s, t = Counter(), Counter()
    for r in own:
        s.update(r[2])
    for r in target.collect():
        t.update(features(r["text"])[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for i, n, found in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(can[:5 * len(can) // 100]):
        r[4] = place + 1
    assert Counter(tuple(r) for r in resample.resample(docs, target).collect()) == Counter(tuple(r[:5]) for r in rows)
    assert resample.resample(docs.filter("false"), target).count() == 0
    nothing = resample.resample(docs, target.filter("false")).agg(F.max("rank")).first()[0]
    assert nothing == 5 * len(can) // 100


class Tree:
    """The suffix tree by dictionaries, one text after another."""

    def __init__(self, texts, depth=suffix_tree.DEPTH, discount=suffix_tree.DISCOUNT, divergence=suffix_tree.DIVERGENCE):
        self.depth, self.discount = depth, discount
        self.next = defaultdict(Counter)
        for t in texts:
            for context, x in self.places(t):
                for k in range(depth + 1):
                    self.next[context[:k]][x] += 1
        self.states = {b""}
        for context in sorted(self.next, key=len, reverse=True):
            if context and self.told(context) >= divergence:
                self.states.update(context[:k] for k in range(1, len(context) + 1))

    def places(self, text):
        own = b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())) + b"\n"
        padded = b"\r" * self.depth + own
        for i in range(len(own)):
            yield padded[i:i + self.depth][::-1], own[i]

    def smooth(self, count, size, types, base):
        return (max(count - self.discount, 0.0) + self.discount * types * base) / size

    def p(self, context, x):
        seen = self.next.get(context, Counter())
        if not context:
            return (seen[x] + 1) / (sum(seen.values()) + 256)
        base = self.p(context[:-1], x)
        return self.smooth(seen[x], sum(seen.values()), len(seen), base) if seen else base

    def told(self, context):
        seen, total = self.next[context], 0.0
        size = sum(seen.values())
        for x, c in seen.items():
            base = self.p(context[:-1], x)
            if size > 1:
                total += c * math.log(self.smooth(c - 1, size - 1, len(seen) - (c == 1), base) / base)
        return total

    def log10(self, text):
        out = 0.0
        for context, x in self.places(text):
            k = max(k for k in range(self.depth + 1) if context[:k] in self.states)
            out += math.log10(self.p(context[:k], x))
        return out


@pytest.mark.parametrize("least", [suffix_tree.COMMON, 40])
def test_suffix_tree(docs, least):
    rows = [r for r in sample() if r[0] is None or r[0] < 60 or r[0] > 1990]
    own = docs.filter("doc_id is null or doc_id < 60 or doc_id > 1990")
    kept = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    tree = Tree(r[4] for r in rows if kept(r[0]))
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\n"]
    c = Counter(x for r in rows if kept(r[0]) for x in tokens(r[4]))
    n, v = sum(c.values()), len(c)
    wanted = sorted(((r[0] is not None, r[0] or 0, not kept(r[0]), len(tokens(r[4])), sum(c[x] > 0 for x in tokens(r[4])), n), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(r[4])), tree.log10(r[4])) for r in rows)
    got = sorted(((r[0] is not None, r[0] or 0, *r[1:5]), r[5], r[6]) for r in suffix_tree.score(own, suffix_tree.seventh(F.col("doc_id")), least=least).collect())
    assert [g[0] for g in got] == [w[0] for w in wanted]
    for g, w in zip(got, wanted, strict=True):
        assert g[1:] == pytest.approx(w[1:], rel=1e-5)


def test_suffix_tree_edges(docs):
    assert suffix_tree.score(docs.filter("false")).count() == 0
    untrained = suffix_tree.score(docs.filter("doc_id < 3"), F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["held_out"]) for r in untrained} == {(0, 0, True)}
    for r in untrained:
        text = next(x[4] for x in sample() if x[0] == r["doc_id"])
        assert r["score"] == pytest.approx(-math.log10(256) * max(1, len(text.encode()) + 1), rel=1e-6)


def test_held_out_texts_gain_by_states(spark):
    """Held-out accuracy: made-up words of common syllables are likelier with states than by single symbols."""
    random.seed(8)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(random.choice(syllables) for _ in range(random.choice([1, 1, 2, 4])))
    table = spark.createDataFrame([(i, " ".join(word() for _ in range(60))) for i in range(400)], "doc_id long, text string")
    total = lambda divergence: suffix_tree.score(table, suffix_tree.seventh(F.col("doc_id")), divergence=divergence).filter("held_out").agg(F.sum("score")).first()[0]
    assert total(suffix_tree.DIVERGENCE) > 0.85 * total(float("inf"))
