"""Operators on Spark against brute force, over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import bytebpe, components, language, licenses, near_dedup, packing, perplexity, piece_bpe, queries, quotient_dedup, simple8b, url_filter, word_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, label string, n_words long, norm string, block int, language string, part int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 7919}x{i}" for i in range(60_000))


def sample() -> list[tuple[int | None, str | None]]:
    random.seed(9)
    vocabulary = [f"{a}{b}" for a in "the an of ing tion re con".split() for b in "a er ly nd st".split()]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    base = [prose(random.randint(30, 200)) for _ in range(40)]
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    for i in range(60):  # near copies: one to eight words changed
        words = base[i % 4].split()
        for _ in range(1 + i % 8):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((100 + i, " ".join(words)))
    rows += [(200, base[5]), (201, base[5].replace(" ", "\n\t ")), (202, base[5].upper()), (7, base[7]), (7, base[7]), (None, base[8]), (None, None), (300, None), (301, ""), (302, " \n"), (303, "one"), (304, "One"), (305, LONG), (306, LONG + " end")]
    rows += [(400, "Released under the MIT License. the mit  license, MIT-License"), (401, "GNU General Public License, and Apache License, Version 2.0"), (402, "mit"), (403, "permission is granted free of charge to any person obtaining a copy of this software"), (404, "é MIT License")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, random.choice(["en", "fr", None]), f"src{(i or 0) % 3}" if i != 11 else None, 0, 5, "x", -1, "n", 9, "zz", 3) for i, t in sample()]
    path = __import__("tempfile").mkdtemp(prefix="llm-docs-")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def empty(docs):
    return docs.filter("false")


def own(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_piece_bpe(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = Counter((d, len(ids := library.encode(t or "", add_eos=True)), sha(" ".join(map(str, ids))), sha(library.decode(ids))) for d, t in own(docs))
    assert Counter(tuple(r) for r in piece_bpe.round_trip_digests(docs).collect()) == wanted
    back = piece_bpe.decode_ids(piece_bpe.encode_texts(docs)).collect()
    assert Counter(tuple(r) for r in back) == Counter((d, library.decode(library.encode(t or "", add_eos=True))) for d, t in own(docs))
    assert piece_bpe.round_trip_digests(empty).count() == 0


def test_language(spark, docs, empty):
    found = {"en": "the of and that with this from they have", "de": "und nicht auch für sich mit einer keit ung", "fr": "les des que pour dans elle avec être où"}
    random.seed(4)
    rows = []
    for i in range(300):
        name = random.choice(sorted(found))
        text = " ".join(random.choice(found[name].split()) for _ in range(40))
        stated = random.choice(sorted(found)) if i % 10 == 0 else name  # a tenth may be stated wrongly
        rows.append((i, text if i % 50 else None, stated if i % 7 else None, f"www.{name}.example.{name}" if i % 3 else None, name))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, true string")
    got = language.with_language(table).collect()
    assert all(r["language"]["predicted"] == r["true"] for r in got if r["text"])
    assert all(r["language"]["accepted"] == bool(r["text"]) for r in got)
    # A page without text is judged by its host and its stated language.
    by_host = [r for r in got if not r["text"] and r["source"]]
    assert by_host and all(r["language"]["predicted"] == r["true"] for r in by_host if r["lang"] == r["true"] or r["lang"] is None)
    kept = language.with_language(docs)
    assert kept.columns == [c for c in docs.columns if c != "language"] + ["language"] and kept.count() == docs.count()
    assert language.with_language(empty).count() == 0
    assert not language.with_language(docs.withColumn("lang", F.lit(None).cast("string"))).filter("language.accepted").count()


def brute_components(rows, num, den):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            met = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * met >= num * (len(sets[i]) + len(sets[j]) - met):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = {}
    for (d, _), x in zip(rows, label):
        low[x] = min(low.get(x, (True, 0)), (d is None, d or 0))
    return Counter((d, len(s), None if low[x][0] else low[x][1]) for (d, _), s, x in zip(rows, sets, label))


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates(docs, empty, monkeypatch, small_blocks):
    if small_blocks:  # buckets of several blocks, and no broadcasts
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
        monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    for rule in (near_dedup.AT_85, near_dedup.AT_80):
        got = near_dedup.near_groups(docs, rule).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(own(docs), rule.num, rule.den)
        kept = Counter(r.component_id for r in got if r.kept and r.n_shingles and r.component_id is not None)
        assert set(kept.values()) == {1}
    once = near_dedup.drop_near_copies(docs)
    assert once.columns == docs.columns and near_dedup.near_groups(once, near_dedup.AT_80).filter("not kept").count() == 0
    assert near_dedup.near_groups(empty).count() == 0


def test_components(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(200)] + [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(70)] + [(500, 600 + i) for i in range(50)]
    edges = [e for e in edges if e[0] != e[1]]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_licenses(docs, empty):
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault((r.doc_id, r.n_words), r)
    for d, t in own(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = sorted((i, label) for p, label in licenses.BASE_PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        r = got[d, len(w)]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    missing = next(r for (d, _), r in got.items() if d == 403)  # a notice with a word left out
    assert missing.n_base == 0 and missing.labels == "mit" and 0.8 <= missing.score < 1
    assert licenses.scan(empty).count() == 0


def test_license_scan_by_a_shuffle(docs, monkeypatch):
    want = Counter(map(str, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert Counter(map(str, licenses.scan(docs).collect())) == want


def judge(url, rules, listed):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):])[0]

    form = lambda u: (lambda h, p: re.sub(r"^www\.", "", h) + re.sub(r"/+$", "", p))(*parts(u))
    host, path = parts(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[0] + r[1]), default=None)
    block = (host or path) and form(url) in {form(u) for u in listed if u is not None}
    return host, path, best and best[0] + best[1], best[2] if best else "block" if block else "allow"


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_filter(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    random.seed(6)
    hosts = ["a.com", "WWW.Example.com", "example.com", "x.example.com", "b.net", "spam.org", "www.spam.org", "net", "", "c.org:80", "notexample.com"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/es/2/", "/fr/a?x=http://q/en/", "/docs/a.html#/en/", "//", "/en/x/y/z"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "https://") for h in hosts for p in paths] + [None, "", "no scheme", "http:/x", "a\nb://c.com/\nen/"] + ["http://a.com/" + "x/" * 5000]
    urls += urls[:40]
    rules = [*queries.URL_RULES, ("example.com", "/en/x", "allow"), ("org", "/docs/a.h", "block")]
    listed = ["http://spam.org/en/", "https://www.c.org:80", None, "http://spam.org/es/2"]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge(pages, table, spark.createDataFrame([(u, 1) for u in listed], "url string, x int"))
    assert Counter(tuple(r) for r in got.collect()) == Counter((i if i % 9 else None, *judge(u, rules, listed)) for i, u in enumerate(urls))
    assert url_filter.judge(pages.filter("false"), table, spark.createDataFrame([], "url string")).count() == 0
    nothing = url_filter.judge(pages, table.filter("false"), spark.createDataFrame([], "url string")).collect()
    assert {r.verdict for r in nothing} == {"allow"} and len(nothing) == len(urls)


def test_quality(spark, docs, empty):
    got = perplexity.with_quality(docs)
    assert got.columns == [*docs.columns, "quality"] and got.count() == docs.count()
    for r in got.collect():
        n, again = r.quality.n_words, r.quality.n_repeat_words
        assert r.quality.base_failed == (n < 50 or 100 * again > 50 * n) and not (r.quality.base_failed and r.quality.kept)
    assert perplexity.with_quality(empty).count() == 0
    random.seed(8)
    vocabulary = [f"{a}{b}" for a in "the an of ing tion re con".split() for b in "a er ly nd st".split()]
    rows = [(i, " ".join(random.choice(vocabulary) for _ in range(120)), "en") for i in range(200)] + [(1000, " ".join("".join(random.choice("qxzjkvw0123456789%$") for _ in range(7)) for _ in range(120)), "en")]
    judged = {r.doc_id: r.quality for r in perplexity.with_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(judged[i].kept for i in range(200)) and not judged[1000].kept and not judged[1000].base_failed


def test_kneser_ney_equals_the_formula(spark):
    """Probabilities of all seen 4-grams against a plain dictionary model."""
    texts = ["abracadabra", "abra kadabra", "cab", "", None, "dada baba"]
    model = perplexity.train(spark.createDataFrame([(t, "en") for t in texts], "text string, language string"))
    n = perplexity.ORDER
    full = Counter()
    orders = {k: set() for k in range(1, n + 1)}
    for t in texts:
        line = "\n" * (n - 1) + (t or "") + "\n"
        for i in range(n - 1, len(line)):
            full[line[i - n + 1:i + 1]] += 1
            for k in orders:
                orders[k].add(line[i - k + 1:i + 1])
    counts = {n: full} | {k: Counter(g[1:] for g in orders[k + 1]) for k in range(1, n)}
    p = {"": 1 / (len(orders[1]) + 1)}
    for k in range(1, n + 1):
        own = counts[k]
        d = perplexity.discounts([sum(1 for c in own.values() if c == j) for j in range(1, 5)])
        taken, total = Counter(), Counter()
        for g, c in own.items():
            taken[g[:-1]] += d[min(c, 3) - 1]
            total[g[:-1]] += c
        p |= {g: max(c - d[min(c, 3) - 1], 0) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, c in own.items()}
    from shelfwise.llm.cells import slices
    import pyarrow as pa

    dense = model.dense()
    for part in slices(perplexity.padded(pa.array(texts))):
        got = perplexity.log_perplexities(model, dense, part, perplexity.salts(pa.array(["en"] * len(texts))))
    for t, g in zip(texts, got):
        line = "\n" * (n - 1) + (t or "") + "\n"
        assert g == pytest.approx(-np.mean([np.log(p[line[i - n + 1:i + 1]]) for i in range(n - 1, len(line))]), abs=1e-4)


def check_packing(rows, texts, capacity):
    library, _ = bytebpe.tokenizer(bytebpe.tokenizer_path())
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]
    wanted = Counter()
    for own in ids:
        n = -(-len(own) // capacity)
        head = len(own) - (n - 1) * capacity
        cuts = [0, *(head + k * capacity for k in range(n))]
        wanted.update((k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])))
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))] and sum(x for _, x in own) <= capacity
    return len(sequences), -(-sum(map(len, ids)) // capacity)


def test_packing(docs, empty):
    for capacity in (64, 2048):
        used, least = check_packing(packing.pack_documents(docs, capacity).collect(), [t for _, t in own(docs)], capacity)
        assert used <= least * 1.05 + 1
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_exact_duplicates(docs, empty, monkeypatch, small):
    if not small:
        monkeypatch.setattr(quotient_dedup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(quotient_dedup, "SEGMENT_ROWS", 16)
    groups = defaultdict(list)
    for d, t in own(docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    wanted = Counter((d, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    got = quotient_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == wanted
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = quotient_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert quotient_dedup.exact_groups(empty).count() == 0


def test_word_pieces(docs, empty):
    own_automaton = word_pieces.automaton(bytebpe.tokenizer_path("piece_bpe_32k.model"))
    wanted = Counter()
    for d, t in own(docs):
        n = [own_automaton.one(map(ord, w)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        wanted[d, len(n), sum(max(x, 1) for x in n), sum(x < 0 for x in n)] += 1
    assert Counter(tuple(r) for r in word_pieces.token_counts(docs).collect()) == wanted
    assert word_pieces.token_counts(empty).count() == 0


def test_token_files(spark, docs, empty):
    library, _ = bytebpe.tokenizer(bytebpe.tokenizer_path())
    rows = own(docs)
    ids = {t: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t in rows}
    got = sorted((tuple(r) for r in simple8b.round_trip(docs).collect()), key=lambda r: r[1])
    assert [(r[0] is not None, r[0] or 0) for r in got] == sorted((d is not None, d or 0) for d, _ in rows)
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t in rows)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    from shelfwise.sources.staging import new_path

    path = new_path(spark, "tokens")
    simple8b.write_tokens(docs, path)
    assert Counter((r.doc_id, tuple(r.ids)) for r in simple8b.read_tokens(spark, path).collect()) == Counter((d, tuple(ids[t].tolist())) for d, t in rows)
    assert simple8b.round_trip(empty).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    table, before = docs, None
    for name, step in corpus_pipeline.STAGES:
        path = __import__("tempfile").mkdtemp(prefix="llm-stage-")
        step(spark, table, "").write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.columns == docs.columns and after.exceptAll(table).count() == 0
        before, table = table, after
    texts = [t for _, t in own(before)]
    assert texts and all(len(t.split()) >= 50 for t in texts)
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts}) == len(texts)
    assert all(d == c for d, _, c in brute_components([(i, t) for i, t in enumerate(texts)], 80, 100))
    check_packing(table.collect(), texts, 2048)


def test_kneser_ney_of_many_ngrams_and_languages(spark, monkeypatch):
    """More n-grams than a fixed table keeps apart: every text's perplexity equals a plain dictionary model's, by a broadcast and by a join."""
    random.seed(12)
    n = perplexity.ORDER
    rows = [(i, "".join(chr(0x4E00 + random.randrange(4000)) for _ in range(100)), ["zh", "ja", None][i % 3]) for i in range(600)] + [(600, None, "zh"), (601, "", "ja")]
    lines = [(lang, "\n" * (n - 1) + (t or "") + "\n") for _, t, lang in rows]
    counts = {n: Counter((lang, t[i - n + 1:i + 1]) for lang, t in lines for i in range(n - 1, len(t)))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter((lang, g[1:]) for lang, g in counts[k + 1])
    p = Counter({(lang, ""): 1 / (len(counts[1]) + 1) for lang in ("zh", "ja", None)})
    for k in range(1, n + 1):
        d = perplexity.discounts([sum(1 for c in counts[k].values() if c == j) for j in range(1, 5)])
        taken, total = Counter(), Counter()
        for (lang, g), c in counts[k].items():
            taken[lang, g[:-1]] += d[min(c, 3) - 1]
            total[lang, g[:-1]] += c
        p.update({(lang, g): max(c - d[min(c, 3) - 1], 0) / total[lang, g[:-1]] + taken[lang, g[:-1]] / total[lang, g[:-1]] * p[lang, g[1:]] for (lang, g), c in counts[k].items()})
    wanted = {i: -np.mean([np.log(p[lang, t[j - n + 1:j + 1]]) for j in range(n - 1, len(t))]) for i, (lang, t) in enumerate(lines)}
    path = __import__("tempfile").mkdtemp(prefix="llm-grams-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.mode("overwrite").parquet(path)
    monkeypatch.setattr(perplexity, "PENDING", 5000)
    kept = []
    for most in (perplexity.BROADCAST_ROWS, 0):
        monkeypatch.setattr(perplexity, "BROADCAST_ROWS", most)
        got = {r.doc_id: r.quality for r in perplexity.with_quality(spark.read.parquet(path)).collect()}
        assert {i: q.log_perplexity for i, q in got.items()} == pytest.approx(wanted, abs=1e-4)
        kept.append({i: (q.kept, q.base_failed, q.n_words, q.lower, q.upper) for i, q in got.items()})
    assert kept[0] == kept[1]


WORDS_OF = {"en": "the of and that with this from they have", "de": "und nicht auch für sich mit einer keit ung", "ru": "что это как его она они был для при или чтобы только", "zh": "我们 他们 因为 所以 这个 那个 时间 问题"}


@pytest.mark.parametrize("stated", [["en"], ["en", "de"]])
def test_texts_in_no_known_language_are_rejected(spark, stated):
    """Other languages, keyboard noise and symbols under a stated language go; clean texts, short ones too, stay."""
    random.seed(14)
    prose = lambda name, n: " ".join(random.choice(WORDS_OF[name].split()) for _ in range(n))
    clean = [(prose(lang, random.choice([1, 3, 40, 400])), lang) for i in range(300) for lang in [stated[i % len(stated)]]]
    noise = lambda n: "".join(random.choice("qxzjkvwpbgfy") for _ in range(n))
    wrong = [(prose("ru", 60), "en"), (prose("ru", 300), None), (prose("zh", 60), "en"), (" ".join(noise(8) for _ in range(50)), "en"), ("#$% &*( " * 30 + "a", "en"), ("!!! ??? --- a", "en")]
    rows = [(i, t, lang, "h") for i, (t, lang) in enumerate(clean + wrong)]
    got = {r.doc_id: r.language for r in language.with_language(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i in range(len(rows)) if got[i].accepted != (i < len(clean))] == []


def test_declared_languages_of_three_letters(spark):
    tags = {"fil": ["fil", "fil-PH", "FIL_ph"], "ast": ["ast", " ast-ES"], "fi": ["fi", "FI-fi"], "en": ["en", "en_US"]}
    words = {"fil": "ang mga hindi kayo ako siya nang", "ast": "ye la llingua asturiana nun tamién yá", "fi": "että mutta joka hän ovat kun olla", "en": WORDS_OF["en"]}
    random.seed(15)
    rows = [(i, " ".join(random.choice(words[name].split()) for _ in range(60)), random.choice(tags[name]), "h", name) for i in range(200) for name in [sorted(tags)[i % 4]]]
    rows += [(1000 + i, rows[i][1], tag, "h", rows[i][4]) for i, tag in enumerate(["und", "mul", "zxx", "und-Latn", "english", "e", "", "x-klingon", "en1", None])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, true string")
    assert all(r.language.predicted == r.true and r.language.accepted for r in language.with_language(table).collect())
    assert {r.language.predicted for r in language.with_language(table, languages=["fil", "en"]).filter(F.col("true") == "fil").collect()} == {"fil"}
    got = spark.createDataFrame([(r[2],) for r in rows[200:]], "x string").select(language.primary_subtag(F.col("x")).alias("y")).collect()
    assert all(r.y is None for r in got)


CLASHING = ["prior", "of_host", "host", "declared", "own", "scored", "scores", "logs", "top", "lower", "upper", "row", "row_number", "__row", "__host", "__judged", "judged", "measured", "log", "key", "label", "fingerprint", "sha", "norm"]


@pytest.fixture(scope="module")
def clashing(docs):
    """The sample with extra columns of the names that operators use inside."""
    path = __import__("tempfile").mkdtemp(prefix="llm-clash-")
    docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"own {c}").alias(c) for c in CLASHING)).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


@pytest.mark.parametrize("many", [False, True])
def test_clashing_columns_of_judged_documents(docs, clashing, many, monkeypatch):
    """Extra columns stay as they are and change no verdict."""
    if many:
        monkeypatch.setattr(perplexity, "BROADCAST_ROWS", 0)
    for judge_, name in ((language.with_language, "language"), (perplexity.with_quality, "quality")):
        plain, got = judge_(docs), judge_(clashing)
        assert got.columns == [*clashing.columns, name]
        verdict = lambda df: Counter((r.doc_id, r.text, str(r[name][-1])) for r in df.collect())  # noqa: B023, E731
        assert verdict(plain) == verdict(got)
        assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHING)


def test_clashing_columns_of_the_pipeline(docs, clashing):
    import corpus_pipeline

    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(docs.sparkSession, clashing, "")
        assert got.columns == clashing.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING), name
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in step(docs.sparkSession, docs, "").collect()), name


def test_pipeline_of_an_empty_table(spark, empty):
    import corpus_pipeline

    for name, step in corpus_pipeline.STAGES:
        got = step(spark, empty, "")
        assert got.count() == 0, name
        assert name == "best_fit_packing" or got.columns == empty.columns


def test_license_notices_with_one_edit(spark):
    """Every notice with one word replaced, inserted or left out at any place is found where its words are enough."""
    rows, wanted = [], []
    for notice, label in licenses.NOTICES:
        w = notice.split()
        edits = [(w[:k] + ["qqq"] + w[k + 1:], len(w) - 1, len(w)) for k in range(len(w))] + [(w[:k] + ["qqq"] + w[k:], len(w), len(w) + 1) for k in range(1, len(w))] + [(w[:k] + w[k + 1:], len(w) - 1, len(w)) for k in range(len(w))]
        for words, common, size in edits:
            if 10 * common >= 8 * size:
                rows.append((len(rows), " ".join(["zzz"] * 7 + words + ["yyy"] * 7)))
                wanted.append((label, common / size))
    path = __import__("tempfile").mkdtemp(prefix="llm-notices-")
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path)
    got = {r.doc_id: r.spans for r in licenses.scan(spark.read.parquet(path)).collect()}
    missing = [rows[i] for i, (label, share) in enumerate(wanted) if not any(x.label == label and x.share >= share - 1e-9 for x in got[i])]
    assert missing == []


def test_url_rules_of_whole_hosts(spark):
    rules = [("example.com", "", "block"), ("example.com", "/en/", "allow"), ("net", "", "allow"), ("x.net", "/", "block")]
    urls = ["http://example.com", "http://www.example.com/de/1", "http://example.com/en/1", "http://example.com?q", "http://notexample.com/", "http://a.net", "http://x.net", "http://x.net/a", "http://b.org/", "http://void.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([*rules, ("void.org", None, "block"), (None, "/a", "block")], "host string, path string, verdict string")
    got = url_filter.judge(pages, table, spark.createDataFrame([], "url string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *judge(u, [*rules, ("void.org", "", "block")], [])) for i, u in enumerate(urls))
