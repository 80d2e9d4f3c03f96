"""Validity intervals and dated states against brute force and full rebuilds."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from shelfwise.operators import states, validity

DAYS = [dt.date(2024, 1, d) for d in (1, 3, 4, 9, 10, 20)]
SCHEMA = "sku string, day date, price double, tag string, prior int"


def sample():
    rng = random.Random(5)
    rows = []
    for i, d in enumerate(DAYS):
        for k in range(30):
            if rng.random() < 0.8:
                rows.append((f"p{k}", d, rng.choice([1.0, 1.0, 2.0, float("nan"), None]), rng.choice(["a", None]), i))
    return rows + [(None, DAYS[0], 1.0, "a", 0), ("p1", None, 1.0, "a", 0)]


def brute(rows):
    known = {(k, d): (repr(p), t) for k, d, p, t, _ in rows if k is not None and d is not None}
    out = set()
    for k in {k for k, _ in known}:
        start = None
        for i, d in enumerate(DAYS):
            now = known.get((k, d))
            before = known.get((k, DAYS[i - 1])) if i else None
            if now is not None and now != before:
                start = i
            after = known.get((k, DAYS[i + 1])) if i + 1 < len(DAYS) else now
            if now is not None and (i + 1 == len(DAYS) or after != now):
                out.add((k, *now, DAYS[start], DAYS[i + 1] if i + 1 < len(DAYS) else None, i - start + 1))
    return out


def as_set(df):
    return {(r.sku, repr(r.price), r.tag, r.valid_from, r.valid_to, r.rounds) for r in df.collect()}


def test_intervals_folds_and_as_of_reads(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    whole = validity.intervals(df, "sku", "day", ["price", "tag"])
    assert as_set(whole) == want and whole.count() == len(want)
    folded = validity.intervals(df.where(F.col("day") == DAYS[0]), "sku", "day", ["price", "tag"])
    for d in DAYS[1:]:
        folded = validity.fold(folded, df.where(F.col("day") == d), "sku", d, ["price", "tag"])
    assert as_set(folded) == want and folded.count() == len(want)
    for d in DAYS:
        held = {(r.sku, repr(r.price), r.tag) for r in validity.as_of(whole, d).collect()}
        assert held == {(k, repr(p), t) for k, dd, p, t, _ in rows if dd == d and k is not None}
    asked = spark.createDataFrame([(f"p{k}", dt.date(2024, 1, d), k * 100 + d) for k in range(31) for d in (1, 2, 9, 15, 25)], "sku string, at date, n int")
    got = validity.as_of_join(asked, whole, "sku", "at", ["tag"]).collect()
    assert len(got) == 31 * 5
    last = {d: max(x for x in DAYS if x <= d) for d in {r["at"] for r in got}}
    tags = {(k, d): t for k, d, _, t, _ in rows}
    assert all(r.as_of_tag == tags.get((r.sku, last[r["at"]])) for r in got)
    none = df.where(F.lit(False))
    assert validity.intervals(none, "sku", "day", ["price", "tag"]).count() == 0
    assert as_set(validity.fold(whole, none, "sku", dt.date(2024, 2, 1), ["price", "tag"])) == {(*r[:4], r[4] or dt.date(2024, 2, 1), r[5]) for r in want}


def test_a_rerun_day_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 3 + ["b", None]), f"s{rng.randrange(400)}", rng.choice([None, float("nan"), round(rng.random() * 50, 2), round(rng.random() * 50, 2)]), DAYS[i % 3]) for i in range(4000)]
    schema = "category string, sku string, price double, day date"
    df = spark.createDataFrame(rows, schema)
    wrong = df.where((F.col("day") != DAYS[1]) | (F.col("sku") < "s2"))  # the second day came in part only
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    args = ("day", ["category"], ["price"], "sku")
    states.write_states(wrong, a, *args)
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "a" / "sums" / f"snapshot_date={DAYS[0]}").glob("*.parquet")}
    states.write_states(df.where(F.col("day") == DAYS[1]), a, *args)
    assert kept and all(p.stat().st_mtime_ns == t for p, t in kept.items())
    states.write_states(df, b, *args)
    read = lambda p: {r.category: r for r in states.merged(spark.read.parquet(f"{p}/sums"), ["category"], ["price"]).collect()}
    exact = lambda p: {r.category: r for r in states.merged_exact(spark.read.parquet(f"{p}/points"), ["category"], ["price"]).collect()}
    one, two, true = read(a), read(b), exact(a)
    assert exact(b) == true and set(one) == set(two) == {"hot", "b", None}
    for c in ("hot", "b"):
        prices = [p for k, _, p, _ in rows if k == c and p is not None and p == p]
        assert one[c].n == two[c].n == sum(1 for r in rows if r[0] == c)
        assert abs(one[c].price_sum - sum(prices)) < 1e-6 and abs(one[c].price_mean - statistics.mean(prices)) < 1e-9
        assert (one[c].price_min, one[c].price_max) == (min(prices), max(prices))
        assert true[c].items == len({r[1] for r in rows if r[0] == c}) and abs(true[c].price_quantile - statistics.median(prices)) < 1e-9
        assert abs(one[c].items_estimate - true[c].items) <= 0.1 * true[c].items
        below = sum(p <= one[c].price_quantile_estimate for p in prices) / len(prices)
        assert 0.45 <= below <= 0.55
    none = df.where(F.lit(False))
    assert states.merged(states.day_states(none, *args), ["category"], ["price"]).count() == 0
    blank = spark.createDataFrame([("x", None, None, DAYS[0])], schema)
    r = states.merged(states.day_states(blank, *args), ["category"], ["price"]).first()
    assert (r.n, r.items_estimate, r.price_sum, r.price_quantile_estimate) == (1, 0, None, None)
