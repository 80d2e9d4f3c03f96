"""Kernels without Spark: words, hashing, ids, filters, packing, automaton, language model parts."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import bytebpe, cells, near_dedup, packing, perplexity, piece_bpe, quotient_dedup, simple8b, word_pieces

TEXT = st.lists(st.sampled_from([*" \n\tabAB'.,é日▁\x00\u3000😀#", "th", "ing", "<s>", "  "]), max_size=40).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12), st.integers(1, 40))
def test_words_and_slices(texts, limit):
    seen = []
    for part in cells.slices(pa.array(texts, pa.string()), limit):
        found = cells.words(part, cells.WHITE_LOWER)
        names = found.vocabulary.to_pylist()
        seen += [[names[i] for i in found.ids[a:b]] for a, b in zip(found.bounds[:-1], found.bounds[1:])]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert seen == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12))
def test_ids_equal_the_libraries(texts):
    library, _ = bytebpe.tokenizer(bytebpe.tokenizer_path())
    for part in cells.slices(pa.array(texts, pa.string())):
        ids, bounds = bytebpe.with_end(*bytebpe.encode(part, bytebpe.tokenizer_path()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]

    import sentencepiece

    own, path = piece_bpe.model(piece_bpe.model_path()), piece_bpe.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for first, ids, bounds in piece_bpe.encoded(pa.array(texts, pa.string()), path):
        data, ends = own.decode(ids, bounds)
        for i in range(len(bounds) - 1):
            wanted = library.encode(texts[first + i] or "", add_eos=True)
            assert ids[bounds[i]:bounds[i + 1]].tolist() == wanted
            assert data[ends[i]:ends[i + 1]].tobytes().decode() == library.decode(wanted)


def test_ids_of_added_tokens_equal_a_fresh_library():
    from tokenizers import Tokenizer

    fresh, end = Tokenizer.from_file(bytebpe.tokenizer_path()), "<|endoftext|>"
    texts = [f"abc {end} def", f"abc{end}def", end, end + end, f"{end} x", f"x {end}", f"a\n{end}\nb", f"\n{end}\n", f"a  \n\n{end}  b", f"a\t{end}\u3000{end}é", f"日{end}日 ", "<|endoftext|", "|endoftext|>", f"<{end}>", f"<|endo{end}ftext|>", f"a.{end}.b 1{end}2 '{end}'s", "\n", "", None, "plain\n"]
    random.seed(3)
    texts += ["".join(random.choice([end, " ", "\n", "ab", "<|", "|>", "é", "7", ".", "  ", "'s"]) for _ in range(random.randrange(30))) for _ in range(400)]
    assert fresh.encode(texts[0], add_special_tokens=False).ids == [39305, 220, 50256, 825]
    for limit in (200, 1 << 20):
        got = []
        for part in cells.slices(pa.array(texts, pa.string()), limit):
            ids, bounds = bytebpe.encode(part, bytebpe.tokenizer_path())
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_decoding_of_any_ids():
    import sentencepiece

    random.seed(5)
    own, library = piece_bpe.model(piece_bpe.model_path()), sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    lists = [[random.choice([random.randrange(1, 32000), random.randrange(3, 259)]) for _ in range(random.randint(0, 12))] for _ in range(3000)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    data, ends = own.decode(np.array([i for x in lists for i in x]), bounds)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == [library.decode(x) for x in lists]


@pytest.mark.parametrize("n", [0, 1, 61, simple8b.BLOCK - 1, simple8b.BLOCK, simple8b.BLOCK + 1, 5000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 60, 50_000, 1 << 32, 1 << 60, (1 << 64) - 1):
        values = rng.integers(0, top, n, np.uint64, endpoint=top == (1 << 64) - 1)
        values = np.where(rng.random(n) < 0.5, values & np.uint64(3), values)
        words, offsets = simple8b.encode(values)
        assert (simple8b.decode(words, offsets, n) == values).all()
        for b, at in enumerate(offsets):  # blocks decode on their own
            end = offsets[b + 1] if b + 1 < len(offsets) else len(words)
            own = values[b * simple8b.BLOCK:(b + 1) * simple8b.BLOCK]
            assert (simple8b.decode(words[at:end], np.zeros(1, np.int64), len(own)) == own).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, (1 << 20) - 1), st.integers(1, 600), max_size=60), min_size=1, max_size=4))
def test_quotient_filters_merge_losslessly(parts):
    filters = []
    for part in parts:
        values = np.array(sorted(part), np.uint64)
        q = quotient_dedup.quotient_bits(len(values))
        made = quotient_dedup.QuotientFilter.build(values, np.array([part[int(v)] for v in values], np.int64), q, 20 - q)
        filters.append(quotient_dedup.QuotientFilter.from_bytes(made.to_bytes()))
    merged = quotient_dedup.QuotientFilter.from_bytes(quotient_dedup.QuotientFilter.merge(filters).to_bytes())
    assert dict(zip(merged.values().tolist(), merged.counts.tolist())) == dict(sum((Counter(p) for p in parts), Counter()))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_packing_plan_holds_every_piece_once(lengths):
    sizes, counts = np.unique(lengths, return_counts=True)
    plan = packing.solve(sizes, counts, 100)
    held = Counter()
    for config, copies in plan:
        assert copies > 0 and sum(int(sizes[k]) * n for k, n in config.items()) <= 100
        for k, n in config.items():
            held[k] += n * copies
    assert [held[k] for k in range(len(sizes))] == counts.tolist()
    # No more than first-fit decreasing's bound over the volume.
    assert sum(n for _, n in plan) <= 1.7 * sum(lengths) / 100 + 1


def test_packing_is_near_the_volume_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(5.5, 1.0, 20_000).astype(int) + 1, 2048)
    sizes, counts = np.unique(lengths, return_counts=True)
    assert sum(n for _, n in packing.solve(sizes, counts, 2048)) <= 1.002 * lengths.sum() / 2048 + 1


def covering(sizes, counts, capacity):
    """The fractional solution: every configuration fits, and every length is covered."""
    cover = packing.fractional(sizes, counts, capacity)
    covered = np.zeros(len(sizes))
    for config, amount in cover.amounts.items():
        assert amount > 0 and sum(int(sizes[k]) * n for k, n in config) <= capacity
        for k, n in config:
            covered[k] += amount * n
    assert (covered >= counts * (1 - 1e-6)).all()
    assert cover.total == pytest.approx(sum(cover.amounts.values()))
    return cover


def fewest(pieces, capacity):
    """The fewest sequences, by trying every place for every piece."""
    best = len(pieces)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= pieces[i]:
                put(i + 1, [*rooms[:k], rooms[k] - pieces[i], *rooms[k + 1:]])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best


def test_covering_program_is_bounded_by_its_dual():
    rng = np.random.default_rng(5)
    for _ in range(40):
        pieces = sorted(rng.integers(1, 31, rng.integers(1, 9)).tolist(), reverse=True)
        sizes, counts = np.unique(pieces, return_counts=True)
        cover = covering(sizes, counts, 30)
        optimum = fewest(pieces, 30)
        assert cover.bound <= optimum + 1e-9 and cover.bound <= cover.total + 1e-9
        assert optimum <= sum(n for _, n in packing.solve(sizes, counts, 30)) <= optimum + 1


@pytest.mark.parametrize("source", ["documents", "lognormal"])
def test_sequences_come_from_the_program(source):
    """Within two hundredths of the bound, and best-fit has less than a tenth of the sequences left to make."""
    if source == "documents":
        texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
        model = bytebpe.tokenizer(bytebpe.tokenizer_path())[0]
        total = np.array([len(e.ids) + 1 for e in model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)])
        n = -(-total // 2048)
        lengths = np.concatenate([total - (n - 1) * 2048, np.full(int((n - 1).sum()), 2048)])
    else:
        lengths = np.minimum(np.random.default_rng(3).lognormal(6.0, 1.0, 10_000).astype(int) + 1, 2048)
    sizes, counts = np.unique(lengths, return_counts=True)
    cover = covering(sizes, counts, 2048)
    assert cover.total <= 1.02 * cover.bound
    plan, left = packing.programmed(sizes, counts, 2048)
    placed, rest = sum(n for _, n in plan), sum(n for _, n in packing.best_fit(sizes, left, 2048))
    assert rest < 0.1 * placed
    assert placed + rest <= np.ceil(1.001 * lengths.sum() / 2048)


def test_packing_by_the_program_beats_best_fit():
    """Three pieces a sequence: best-fit alone takes a tenth more than the volume."""
    sizes, counts = np.unique(np.random.default_rng(2).integers(500, 900, 5000), return_counts=True)
    plain = sum(n for _, n in packing.best_fit(sizes, counts.copy(), 2048))
    assert sum(n for _, n in packing.solve(sizes, counts, 2048)) < 0.97 * plain


def test_automaton_counts_greedy_pieces():
    def greedy(word, begin, continuing):
        n = at = 0
        while at < len(word):
            end = len(word)
            while end > at and word[at:end] not in (continuing if at else begin):
                end -= 1
            if end == at:
                return -1
            at, n = end, n + 1
        return n

    random.seed(3)
    for _ in range(150):
        letters = "abcd"[:random.randint(1, 4)]
        word = lambda m: "".join(random.choice(letters) for _ in range(random.randint(1, m)))
        begin, continuing = {word(6) for _ in range(8)}, {word(5) for _ in range(8)}
        own = word_pieces.Automaton(begin, continuing)
        tried = [word(20) for _ in range(100)] + [word(400)]
        assert own.lengths(pa.array(tried, pa.large_string())).tolist() == [greedy(w, begin, continuing) for w in tried]


def test_estimates_and_intersections():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 600).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:600 - 20 * k], rng.integers(0, 2**63, 10 * k).astype(np.uint64)])) for k in range(12)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    low = near_dedup.minima(np.concatenate(sets), bounds, 400)
    signature = (low & np.uint32(255)).astype(np.uint8)
    true = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (near_dedup.intersections(sets, sets) == true).all()
    sizes = np.array([len(s) for s in sets])
    assert np.abs(near_dedup.estimates(signature, signature) - true / (sizes[:, None] + sizes - true)).max() < 0.12


def test_base_counts_of_odd_texts():
    texts = [None, "", " \n", "a b c a b c", "x\nx\n y \nx", "é# <b>|", "a a a a", "one two three\n" * 3, "w " * 300_000]
    got = [perplexity.base_counts(p) for p in cells.slices(pa.array(texts, pa.string()), 50)]
    columns = {k: np.concatenate([g[k] for g in got]).tolist() for k in got[0]}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        n = Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wanted = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(columns[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == wanted
