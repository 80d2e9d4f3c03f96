"""Distribution kernels against pandas, skewed groups, merge invariants, keyed tables, payloads."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import dedupe as dd
from shelfwise.operators import distribution as ds
from shelfwise.operators import extraction as ex
from shelfwise.operators import history as hs
from shelfwise.operators import market as mk
from shelfwise.operators import parsing as ps
from shelfwise.operators import scoring as sc
from shelfwise.operators import snapshots as sn
from shelfwise.operators import targets as tg
from shelfwise.sources import readers


@pytest.fixture(scope="module")
def sample():
    """Random groups, one of which holds a third of all rows, with ties, NULLs and a long tail."""
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abcdefgh"), n))
    v = np.round(np.exp(rng.normal(2, 2, n)), 2)
    v[rng.random(n) < 0.1] = np.nan
    v[rng.random(n) < 0.1] = 5.0
    return pd.DataFrame({"i": range(n), "g": g, "v": v, "w": rng.integers(-5, 5, n).astype(float)})


def spark_df(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))


def test_quantiles_match_pandas(spark, sample):
    wanted = {"q33": ("v", 0.33), "q50": ("v", 0.5), "q66": ("v", 0.66), "w20": ("w", 0.2), "w80": ("w", 0.8)}
    got = ds.quantiles(spark_df(spark, sample), ["g"], wanted).toPandas().set_index("g").sort_index()
    by = sample.groupby("g")
    for name, (c, p) in wanted.items():
        np.testing.assert_allclose(got[name], by[c].quantile(p).sort_index(), rtol=1e-12)
    whole = ds.quantiles(spark_df(spark, sample), [], {"m": ("v", 0.5)}).first().m
    assert whole == pytest.approx(sample.v.median())


def test_quantiles_of_small_sets(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    r = ds.quantiles(df, [], {"a": ("x", 0.33), "b": ("x", 0.2), "c": ("x", 0.8), "d": ("x", 0.5)}).first()
    assert [round(x, 6) for x in (r.a, r.b, r.c, r.d)] == [1.99, 1.6, 5.6, 3.0]


def test_percent_ranks_match_pandas(spark, sample):
    out = ds.add_ranks(spark_df(spark, sample), ["g"], "v", percent="p", rank_desc="d", rank_asc="a").toPandas().sort_values("i").reset_index(drop=True)
    by = sample.groupby("g")["v"]
    np.testing.assert_allclose(out.p, by.rank(pct=True), rtol=1e-12)
    np.testing.assert_array_equal(out.d.astype(float), by.rank(ascending=False, method="min"))
    np.testing.assert_array_equal(out.a.astype(float), by.rank(method="min"))


def test_percent_rank_fixture(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 3.0), (3, None), (4, 2.0)], "i int, x double")
    got = [r.p for r in ds.add_ranks(df, [], "x", percent="p").orderBy("i").collect()]
    assert got == [0.875, 0.25, 0.875, None, 0.5]
    small = [r.p for r in df.select("i", ds.small_percent_rank("x").alias("p")).orderBy("i").collect()]
    assert small == got


def test_min_max_edges(spark):
    df = spark.createDataFrame([("c", 2.0), ("c", 2.0), ("n", None), ("x", 1.0), ("x", 3.0)], "g string, v double")
    got = {(r.g, r.v): r.m for r in ds.min_max(df, ["g"], {"m": "v"}).collect()}
    assert got == {("c", 2.0): 1.0, ("n", None): 0.0, ("x", 1.0): 0.0, ("x", 3.0): 1.0}


def test_positions_count_values_up_to_the_target(spark, sample):
    df = spark_df(spark, sample)
    t = spark.createDataFrame([("t1", "hot", 5.0), ("t2", "a", 7.31), ("t3", "b", -1.0)], "t string, g string, x double")
    got = {r.t: r.s for r in ds.positions(t, df, ["g"], "v", "x", "s").collect()}
    for k, g, x in (("t1", "hot", 5.0), ("t2", "a", 7.31), ("t3", "b", -1.0)):
        v = sample[sample.g == g].v.dropna()
        assert got[k] == pytest.approx((v <= x).mean())


def test_group_limit_runs_before_the_shuffle(spark, sample):
    plan = dd.keep_one(spark_df(spark, sample), ["g"], [F.col("v").desc(), F.col("i").asc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dedupe_is_idempotent_and_total(spark, sample):
    order = [F.col("v").desc_nulls_last(), F.col("i").asc()]
    once = dd.keep_one(spark_df(spark, sample), ["g"], order)
    assert once.count() == sample.g.nunique() == dd.keep_one(once, ["g"], order).count()


def test_similar_products_against_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 1500
    p = pd.DataFrame({
        "sku": [str(i) for i in range(n)], "title": [f"t{i}" for i in range(n)], "brand": "b", "category": np.where(rng.random(n) < 0.7, "hot", "cold"),
        "price": np.round(rng.random(n) * 50 + 1, 2), "weight_g": rng.integers(1, 60, n) * 10.0, "flavor": rng.choice(["x", "xy", ""], n), "package_type": rng.choice(["bag", ""], n), "has_promotion": True,
    })
    p["unit_price"] = p.price / p.weight_g
    t = pd.DataFrame({"target_id": ["a", "b", "c", "d"], "category": ["hot", "cold", "hot", "cold"], "price": [20.0, 3.0, 44.0, 9.0], "weight_g": [100.0, 40.0, 2.0, 590.0], "flavor": ["x", "", "y", "x"], "package_type": ["bag", "bag", "", ""], "brand": "b"})
    got = sc.similar_products(spark.createDataFrame(t), spark.createDataFrame(p), k=7).toPandas()
    for r in t.itertuples():
        c = p[p.category == r.category].copy()
        c["gap"] = (c.weight_g - r.weight_g).abs() / r.weight_g
        u = r.price / r.weight_g
        bonus = (c.flavor.str.contains(r.flavor, regex=False) * 0.2 if r.flavor else 0) + (c.package_type.str.contains(r.package_type, regex=False) * 0.1 if r.package_type else 0)
        c["d"] = c.gap + (c.unit_price - u).abs() - bonus
        near = c[c.gap <= 1]
        c = c if len(near) < min(5, len(c)) else near
        want = c.assign(r6=(c.d + 1e-7).round(6), u6=(c.unit_price + 1e-7).round(6)).sort_values(["r6", "u6", "sku"]).head(7).sku.tolist()
        assert got[got.target_id == r.target_id].sort_values("rank").sku.tolist() == want


def test_contained_pairs_against_brute_force(spark):
    texts = ["三只松鼠坚果", "Brand#12 ring", "a", "松鼠", "brand#1", ""]
    terms = ["松鼠", "三只松鼠", "Brand#1", "Brand#12", "a", "鼠坚", "zz"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    d = spark.createDataFrame([(x,) for x in terms], "w string")
    got = {(r.k, r.w) for r in ex.contained_pairs(t, "k", "t", d, "w").collect()}
    assert got == {(i, w) for i, x in enumerate(texts) for w in terms if w in x}
    assert ex.contained_pairs(t, "k", "t", d.where("false"), "w").count() == 0
    folded = {(r.k, r.w) for r in ex.contained_pairs(t, "k", "t", d, "w", ignore_case=True).collect()}
    assert folded == {(i, w) for i, x in enumerate(texts) for w in terms if w.lower() in x.lower()}


def test_contained_pairs_with_many_terms_of_one_prefix_and_a_long_text(spark):
    terms = [f"Brand#{i}" for i in range(5000)]
    texts = ["x" * 50_000 + "Brand#4321!" + "y" * 50_000, "Brand#49999", "none"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    pairs = ex.contained_pairs(t, "k", "t", spark.createDataFrame([(w,) for w in terms], "w string"), "w")
    assert {(r.k, r.w) for r in pairs.collect()} == {(i, w) for i, x in enumerate(texts) for w in terms if w in x}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "regexp_extract_all" not in plan  # no window of a text leaves its row


def test_products_at_any_depth(spark):
    import json

    def wrap(depth):
        inner = {"skuId": str(depth), "name": f"n{depth}", "jdPrice": "1.5"}
        for k in range(depth):
            inner = {"k": inner} if k % 2 else [0, inner]
        return json.dumps(inner)

    df = spark.createDataFrame([(d, wrap(d)) for d in (0, 1, 5, 6, 12)] + [(99, "no json"), (98, None)], "k int, j string")
    from shelfwise.operators import parsing as ps

    assert {(r.k, r.item_id) for r in ps.nested_products(df, "k", "j").collect()} == {(d, str(d)) for d in (0, 1, 5, 6, 12)}


def test_reviews_on_single_lines_and_whole_texts(spark):
    from shelfwise.operators import parsing as ps
    from shelfwise.operators import reviews as rv

    text = "2024-05-01 5星\n口感很好，包装也不错\n2024-05-02 1星\n收到时已经破损了，不满意"
    rows = ps.parse_reviews(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()
    assert {(str(r.date), r.score) for r in rows} == {("2024-05-01", 5), ("2024-05-02", 1)}
    head = "a" * 200
    df = spark.createDataFrame([("i", head + "1"), ("i", head + "2"), ("i", head + "1")], "k string, t string")
    assert rv.distinct_reviews(df, ["k"], "t").count() == 2 and rv.distinct_reviews(df, ["k"], "t", chars=100).count() == 1


def test_staging_needs_a_shared_folder_off_a_local_master(spark, monkeypatch):
    from types import SimpleNamespace

    from shelfwise.sources import staging

    fake = lambda master, named=None, context=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: context))
    assert staging.shared_folder(fake("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    assert staging.shared_folder(fake("yarn", None, "hdfs://c")) == "hdfs://c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(fake("yarn"))


def _snapshots(spark):
    old = spark.createDataFrame([("1", "t", "s", "p", 49.9, 60.0, 10.0, "100+"), ("2", "t", "s", "p", 5.0, 6.0, 7.0, "9+"), ("3", "t", "s", "p", 1.0, 2.0, 3.0, "1+")], "sku string, title string, shop string, promotion string, price double, original_price double, comments double, sales_text string")
    new = spark.createDataFrame([("1", "t2", "", "p", 50.9, 61.0, 9.0, "100万+"), ("2", "t", "s", "p", 5.00001, None, 8.0, "9+"), ("4", "n", "s", "p", 2.0, 3.0, 1.0, "1+")], old.schema)
    return old, new


def test_merge_and_change_log(spark):
    old, new = _snapshots(spark)
    log = {(r.sku, r.field): r for r in sn.change_log(old, new).collect()}
    assert set(log) == {("1", "title"), ("1", "price"), ("1", "sales_text"), ("2", "reviews")}
    r = log["1", "price"]
    assert (r.old_value, r.new_value, r.change_type, round(r.change_amount, 6)) == ("49.9", "50.9", "up", 1.0)
    assert r.change_desc == "价格上涨 1.00 (+2.0%)" and log["2", "reviews"].change_desc == "评论数增长 1"
    m = {r.sku: r for r in sn.merge_snapshots(old, new).collect()}
    assert {k: v.state for k, v in m.items()} == {"1": "matched", "2": "matched", "3": "not_seen", "4": "new"}
    assert (m["1"].price, m["1"].price_history, m["1"].shop, m["1"].comments) == (50.9, 49.9, "s", 10.0)
    assert (m["2"].price, m["2"].original_price, m["2"].comments, m["2"].review_growth) == (5.0, 6.0, 8.0, 1.0)
    c = sn.coverage(old, new).first()
    assert (c.matched, c.new_only, c.not_seen, c.total) == (2, 1, 1, 4)
    assert sn.change_log(old, old).count() == 0


def test_trend_points_forms(spark):
    rows = [("a", '[[1717200000000,19.9,"满99减10"],[1717300000000,18.8,""],[1717300000000,18.8,""],[1,0,""]]'), ("b", '[{"timestamp":1,"price":2.5,"promo":"x"}]'), ("c", "oops"), ("d", "{}")]
    df = spark.createDataFrame(rows, "k string, trend string")
    got = hs.trend_points(df, "k", "trend").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 2, "b": 1}
    assert [r.n for r in df.select("k", hs.point_count("trend").alias("n")).orderBy("k").collect()] == [4, 1, 0, 0]


def test_trend_points_odd_times_and_promos(spark):
    blanks = '[[1717200000000,19.9,"x"],["1717200000000","19.90"," x\u3000"],[1717200000000.4,19.9,"\\tx"],[1717200000000,19.9,"a b"],[1717200000000,19.9]]'
    late = '[[1e300,5,"far"],[9223372036854775807,5,"far"],["NaN",5,"none"],[-9000000000000000,5,"first"],[9000000000000000,5,"last"]]'
    objects = '[{"timestamp":1e300,"price":5,"promo":"far"},{"price":5},{"timestamp":7,"price":5,"promo":"\xa0y\u2003"},{"timestamp":7,"price":5.0,"promo":"y"}]'
    df = spark.createDataFrame([("blanks", blanks), ("late", late), ("objects", objects)], "k string, trend string")
    got = hs.trend_points(df, "k", "trend").select("k", F.unix_millis("ts").alias("ms"), "price", "promo").collect()
    assert sorted(map(tuple, got)) == [
        ("blanks", 1717200000000, 19.9, ""), ("blanks", 1717200000000, 19.9, "a b"), ("blanks", 1717200000000, 19.9, "x"),
        ("late", -9000000000000000, 5.0, "first"), ("late", 9000000000000000, 5.0, "last"), ("objects", 7, 5.0, "y"),
    ]


def test_trend_strings_write_shared_parts_once(spark):
    from shelfwise.plans import pricing

    rows = [("2023-03-01", 9.5, 10.0, "满99减10"), ("2024-03-01", 12345678.0, 12345678.0, "")]
    df = spark.createDataFrame(rows, "d string, price double, original_price double, promotion string").select(F.to_date("d").alias("ship_date"), "price", "original_price", "promotion")
    out = pricing._trend_strings(df)
    assert [r.trend for r in out.orderBy("ship_date").collect()] == [
        "[" + ",".join(f'{{"timestamp":1677628800000,"price":{p},"promo":"满99减10"}}' for p in ("9.5", "0", "10.0", "9.5")) + "]",
        "[" + ",".join(f'[1709251200000,{p},""]' for p in ("1.2345678E7", "0", "1.2345678E7", "1.2345678E7")) + "]",
    ]
    # a time per form, not one per point
    assert out._jdf.queryExecution().optimizedPlan().toString().count("unix_seconds") == 2


def test_quota_windows(spark):
    df = spark.createDataFrame([("2024-06-01 23:30:00",), ("2024-06-02 05:59:00",), ("2024-06-02 06:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    got = [(r.w.scope, str(r.w.start)) for r in df.select(tg.limit_window("ts").alias("w")).collect()]
    assert got == [("night_window", "2024-06-01 23:00:00"), ("night_window", "2024-06-01 23:00:00"), ("calendar_day", "2024-06-02 00:00:00")]


def test_conform_and_live_columns(spark):
    df = spark.createDataFrame([("1", "x", None), ("2", None, None), (None, None, None)], "SKU string, Name string, void string")
    out = readers.conform(df, {"sku": {"required": True}, "title": {"aliases": ["name"], "default": "-"}, "price": {"type": "double", "default": 0.0}})
    assert [tuple(r) for r in out.collect()] == [("1", "x", 0.0), ("2", "-", 0.0), (None, "-", 0.0)]
    with pytest.raises(readers.MissingColumnError):
        readers.conform(df, {"brand": {"required": True}})
    live = readers.live_columns(df)
    assert live.columns == ["SKU", "Name"] and live.count() == 2


def test_review_blocks_and_payloads(spark):
    text = "5星 2024-05-01\n很好吃的坚果下次再买\n点赞 3\n\n5星 2024-05-01\n很好吃的坚果下次再买\n\n差评 2024/5/2 包装破损味道不好\n真的很差劲啊"
    rows = ps.parse_reviews(spark.createDataFrame([("i", text)], "k string, t string"), "k", "t").orderBy("ordinal").collect()
    assert [(r.score, str(r.date), r.content, r.like_count) for r in rows] == [(5, "2024-05-01", "很好吃的坚果下次再买", 3), (1, "2024-05-02", "真的很差劲啊", 0)]
    bad = spark.createDataFrame([("x", "<!DOCTYPE html>"), ("y", 'cb({"data":{"comments":[{"commentData":"不错的东西","commentScore":"4"}]}});')], "k string, p string")
    got = ps.comment_payloads(bad, "k", "p").collect()
    assert [(r.k, r.score, r.content) for r in got] == [("y", 4, "不错的东西")]


def test_tercile_band_edges(spark):
    df = spark.createDataFrame([("two", 1.0), ("two", 2.0), *[("many", float(i)) for i in range(1, 11)], ("many", None)], "category string, price double")
    got = {(r.category, r.price): r.price_band for r in mk.tercile_bands(df).collect()}
    assert got["two", 1.0] == "中价" and got["many", None] == "未知"
    assert [got["many", float(i)] for i in (1, 3, 4, 6, 7, 10)] == ["低价", "低价", "中价", "中价", "高价", "高价"]


def test_ranks_with_nan_and_far_values(spark):
    values = [1.0, float("nan"), 2.0, None, 2.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    got = [r.p for r in ds.add_ranks(df, ["g"], "v", percent="p").orderBy("i").collect()]
    want = pd.Series([1.0, np.nan, 2.0, np.nan, 2.0]).rank(pct=True).tolist()
    assert [None if np.isnan(w) else pytest.approx(w) for w in want] == got
    far = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("_v"), F.lit(1).alias("_c"))
    both = far.unionByName(spark.createDataFrame([("g", 1e12, 1), ("h", 3.0, 2)], "g string, _v double, _c int"))
    _, totals = ds._binned(both, ["g"])
    assert totals.agg(F.max("_tot")).first()[0] < 600
    assert ds.running_counts(both, ["g"]).where("g = 'g' AND _cum <> least(_v, 20000) + 1").count() == 0


def test_months_of_a_rolling_low_are_calendar_months(spark):
    import datetime as dt

    from shelfwise.operators import history

    days = ["2022-01-30", "2022-01-31", "2022-02-28", "2024-02-29", "2024-03-01", "2024-03-31"]
    rows = [("x", dt.date.fromisoformat(d), float(i + 1)) for i, d in enumerate(days)]
    daily = spark.createDataFrame(rows, "sku string, day date, low double").withColumn("price_sum", F.col("low")).withColumn("n", F.lit(1))
    low = {str(r.day): r.rolling_low for r in history.windowed_lows(daily, "sku").collect()}
    # 25 months before 2024-02-29 is 2022-01-29, before 2024-03-01 it is 2022-02-01, before 2024-03-31 it is 2022-02-28
    assert low["2024-02-29"] == 1.0 and low["2024-03-01"] == 3.0 and low["2024-03-31"] == 3.0
    last = {str(r.day): r.rolling_low for r in history.windowed_lows(daily, "sku", low_months=1).collect()}
    assert last["2022-02-28"] == 1.0 and last["2024-03-31"] == 4.0  # from 01-28, from 02-29


def test_payloads_and_texts_are_read_inside_their_row(spark):
    from shelfwise.operators import history, parsing

    df = spark.createDataFrame([(1, "{}")], "k int, t string")
    for read in (parsing.rank_products, parsing.rank_tabs, parsing.nested_products, parsing.parse_reviews, history.price_details):
        assert "Exchange" not in read(df, "k", "t")._jdf.queryExecution().executedPlan().toString(), read.__name__
    nested = spark.createDataFrame([(1, '{"b":[{"skuId":7,"name":"x"},{"sku":"8","title":"z"}],"c":{"skuId":"7","name":"y"}}'), (2, "no json"), (3, None)], "k int, t string")
    assert sorted((r.k, r.item_id, r.title) for r in parsing.nested_products(nested, "k", "t").collect()) == [(1, "7", "y"), (1, "8", "z")]


def test_price_details_are_read_by_column(spark):
    from shelfwise.plans import pages

    plan = pages.price_detail_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # no lambda is interpreted and no pattern is run per block
    assert "MapInArrow" in plan and "lambdafunction" not in plan and "regexp_extract" not in plan


def test_price_details_of_odd_texts(spark):
    texts = {
        "glued": "2024-1-2025-1-2026-1-5 ¥5\n2024.1.12025.1.2 7元", "days": "2024-1-59元 2024-2-30 ¥1 2024-13-1 ¥1 2024-0-1 ¥1 2024-2-29 ¥2",
        "parted": "2024-1-5 到手价\nNaN\n8 3元\n", "label": "2024-1-5 ¥9 优惠券\u3000：\n \n新人  专享，满5", "late": "2024-1-5 ¥9 满意优惠券：新，折扣;8折 满9", "bare": "2024-1-5 ¥9 优惠券 \n ，8折",
        "gap": "2024-1-5 到手\xa0：\n\u3000￥ 9.5 网页价格 \x85 10", "first": "2024-1-5 1.2.3元 ¥4", "sign": "2024-1-5 ¥ 4 1.5元", "none": "2024-1-5 到手价 页面价 3 满3",
        "same": "2024-1-5 ¥5.0\n2024年01月05日 5元\n2024/1/5 ¥5 8折", "marks": "\x002024-1-5\x00\x01 ¥5\x00\x01满3\x01", "head": "¥5 满3", "blank": "", "null": None,
        "huge": "2024-1-5 ¥" + "9" * 400 + " 页面价 1",
    }
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {}
    for r in hs.price_details(df.select(F.struct("k").alias("k"), "t"), "k", "t").collect():
        got.setdefault(r.k.k, []).append((str(r.date), r.final_price, r.page_price, r.coupon))
    assert {k: sorted(rows) for k, rows in got.items()} == {
        "glued": [("2025-01-02", 7.0, None, ""), ("2026-01-05", 5.0, None, "")], "days": [("2024-02-29", 2.0, None, "")], "parted": [("2024-01-05", 8.0, None, "")],
        "label": [("2024-01-05", 9.0, None, "新人 专享")], "late": [("2024-01-05", 9.0, None, "8折 满9")], "bare": [("2024-01-05", 9.0, None, "8折")],
        "gap": [("2024-01-05", 9.5, 10.0, "")], "first": [("2024-01-05", 2.3, None, "")], "sign": [("2024-01-05", 4.0, None, "")],
        "same": [("2024-01-05", 5.0, None, ""), ("2024-01-05", 5.0, None, "8折")], "huge": [("2024-01-05", float("inf"), 1.0, "")], "marks": [("2024-01-05", 5.0, None, "满3\x01")],
    }
    firsts = hs.price_details(df, "k", "t", limit=1).where("k IN ('glued', 'same')").orderBy("k").collect()
    assert [(r.k, str(r.date), r.coupon) for r in firsts] == [("glued", "2026-01-05", ""), ("same", "2024-01-05", "")]
    assert hs.price_details(df.where("k = 'head'"), "k", "t").count() == hs.price_details(df.limit(0), "k", "t").count() == 0
