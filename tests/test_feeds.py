"""Keyed tables and streaming feeds over several files."""

from pyspark.sql import functions as F

from shelfwise.sources import readers, sinks
from shelfwise.streaming import feeds


def test_keyed_table_upsert_and_replay(spark, tmp_path):
    t = sinks.KeyedTable(spark, str(tmp_path / "t"), ["k"], ["ts"])
    mk = lambda rows: spark.createDataFrame(rows, "k string, ts int, v string")
    assert t.upsert(mk([("a", 1, "old"), ("b", 1, "b")]), 0)
    assert t.upsert(mk([("a", 2, "new"), ("b", 0, "late"), ("c", 1, "c")]), 1)
    assert not t.upsert(mk([("a", 9, "replayed")]), 1)
    assert {(r.k, r.v) for r in t.read().collect()} == {("a", "new"), ("b", "b"), ("c", "c")}


def test_streamed_upserts_equal_the_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, i % 7, i * 37 % 100) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k int, ts int")
    df.repartition(5).write.parquet(src)
    t = sinks.KeyedTable(spark, str(tmp_path / "t"), ["k"], ["ts", "id"])
    feeds.run_available(feeds.read_stream(spark, src, max_files=1), str(tmp_path / "cp"), each=feeds.upsert_into(t))
    want = {k: max((ts, i) for i, kk, ts in rows if kk == k)[1] for k in range(7)}
    assert {r.k: r.id for r in t.read().collect()} == want


def test_change_capture_over_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "sku string, price double, comments double, sales_text string, ts int"
    for i, price in enumerate([10.0, 12.0, 12.0, 9.0]):
        spark.createDataFrame([("x", price, 0.0, "", i), ("y", 5.0, 0.0, "", i)], schema).coalesce(1).write.mode("append").parquet(src)
    t = sinks.KeyedTable(spark, str(tmp_path / "t"), ["sku"], ["ts"])
    feeds.run_available(feeds.read_stream(spark, src, max_files=1), str(tmp_path / "cp"), each=feeds.capture_changes(t, str(tmp_path / "log"), "sku", ["ts"], texts=()))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [(r.sku, r.change_type, r.change_amount) for r in log.orderBy("batch_id").collect()] == [("x", "up", 2.0), ("x", "down", -3.0)]


def test_csv_round_trip_with_bom(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.write_csv(spark.createDataFrame([("1", "甲,乙"), ("2", "")], "sku string, title string").coalesce(1), path)
    back = spark.read.option("header", True).csv(path)
    assert [c.lstrip("﻿") for c in back.columns] == ["sku", "title"] and back.count() == 2


def test_snapshot_partition_and_report(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.0)], "sku string, price double")
    path = str(tmp_path / "s")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        sinks.write_snapshot(df, path, day)
    assert spark.read.parquet(path).count() == 2
    lines = sinks.report_lines(spark.createDataFrame([("a", "m", 1.0)], "section string, metric string, value double"))
    sinks.write_report(lines, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["## a", "- m: 1.0"]
    md = sinks.markdown_rows(df).first().line
    assert md == "| 1 | 2.0 |"


def test_dictionary_and_chunks(spark, tmp_path):
    (tmp_path / "d.json").write_text('{" 1 ": "坚果", "": "x"}', encoding="utf8")
    d = readers.read_dictionary(spark, str(tmp_path / "d.json"))
    assert [tuple(r) for r in d.collect()] == [("1", "坚果")]
    out = readers.translate(spark.createDataFrame([("1",), ("9",)], "c string"), "c", d)
    assert sorted(r.c for r in out.collect()) == ["9", "坚果"]
    (tmp_path / "p.json").write_text('[["b","l2","l3",1.5,"t","7"],["b","l2","l3","bad","t","8"]]', encoding="utf8")
    got = readers.read_product_chunks(spark, str(tmp_path / "p.json")).select("sku", "price").collect()
    assert [tuple(r) for r in got] == [("7", 1.5), ("8", None)]


def test_stream_dedup_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.createDataFrame([(i, f"text {i % 10}", i) for i in range(50)], "id int, text string, s int")
    df.select(F.lit("item").alias("item_id"), "text", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts")).repartition(3).write.parquet(src)
    out = feeds.distinct_reviews(feeds.read_stream(spark, src, max_files=1), ["item_id"], "text", "ts")
    feeds.run_available(out, str(tmp_path / "cp"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_files_of_several_charsets_in_one_call(spark, tmp_path):
    from shelfwise.sources import readers

    rows = 'id,note\n1,"甜味 糖\n二行"\n2,"say ""hi"""\n3,plain\n'
    (tmp_path / "a b.csv").write_bytes(rows.encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes(rows.encode("utf-8"))
    (tmp_path / "c.csv").write_bytes((rows + "4,𠀀€\n").encode("gb18030"))
    (tmp_path / "d.csv").write_bytes(rows.encode("gbk"))
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "f.csv").write_bytes("id,note\n5,caf\xe9 \x80\xff\n".encode("latin-1"))  # valid in none: the last charset is taken
    found = {r["file"].rsplit("/", 1)[1]: r["charset"] for r in readers.file_charsets(spark, str(tmp_path)).collect()}
    assert found == {"a%20b.csv": "UTF-8", "b.csv": "UTF-8", "c.csv": "GB18030", "d.csv": "GB18030", "f.csv": "GBK"}
    got = sorted((r["id"], r["note"]) for r in readers.read_csv_routed(spark, str(tmp_path), ["id", "note"]).collect() if r["id"] != "5")
    assert got == sorted([("1", "甜味 糖\n二行"), ("2", 'say "hi"'), ("3", "plain")] * 4 + [("4", "𠀀€")])
    (tmp_path / "none").mkdir()
    assert readers.read_csv_routed(spark, str(tmp_path / "none"), ["id", "note"]).count() == 0


def test_a_batch_touches_only_its_buckets(spark, tmp_path):
    t = sinks.KeyedTable(spark, str(tmp_path / "t"), ["k"], ["ts"], buckets=8, max_deltas=2, keep=2)
    mk = lambda rows: spark.createDataFrame(rows, "k int, ts int, v string")
    t.upsert(mk([(k, 0, f"v{k}") for k in range(64)]), 0)
    first = {f: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / f).glob("*.parquet")) for f in t.files()}
    assert len(first) == 8
    want = {k: f"v{k}" for k in range(64)}
    for batch in range(1, 8):  # one key over and over: its bucket is compacted, the others never are
        t.upsert(mk([(5, batch, f"new{batch}")]), batch)
        want[5] = f"new{batch}"
        assert {r.k: r.v for r in t.read().collect()} == want
    now = t.files()
    untouched = [f for f in first if f in now]
    assert len(untouched) == 7 and all(first[f] == sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / f).glob("*.parquet")) for f in untouched)
    assert len(now) <= 7 + 3
    # old manifests and the files only they name are gone
    assert len(list((tmp_path / "t").glob("manifest-*"))) == 2
    on_disk = {str(p) for p in (tmp_path / "t").glob("delta-*/_bucket=*")}
    assert len(on_disk) <= 7 + 5 and set(now) <= on_disk
    before = sorted(map(str, (tmp_path / "t").rglob("*")))
    assert not t.upsert(mk([(5, 99, "replayed")]), 7) and sorted(map(str, (tmp_path / "t").rglob("*"))) == before
    assert t.compact(force=True) and len(t.files()) == 8 and {r.k: r.v for r in t.read().collect()} == want


def test_keyed_table_nulls_ties_new_columns_and_empty_batches(spark, tmp_path):
    t = sinks.KeyedTable(spark, str(tmp_path / "t"), ["k"], ["ts"])
    assert t.upsert(spark.createDataFrame([], "k string, ts int, v string"), 0) and t.exists() and t.files() == []
    t.upsert(spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), ("x", None, None)], "k string, ts int, v string"), 1)
    t.upsert(spark.createDataFrame([(None, 1, "c", 7)], "k string, ts int, v string, extra int"), 2)
    assert {tuple(r) for r in t.read().select("k", "ts", "v", "extra").collect()} == {(None, 1, "c", 7), ("x", None, None, None)}


def test_repeats_beyond_any_watermark_are_dropped(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    days = [(0, "a", "good"), (1, "a", "bad"), (30, "a", "good"), (31, "b", "good"), (31, "b", "good"), (32, None, None), (64, None, None), (65, "a", "bad")]
    for d, item, text in days:
        one = spark.createDataFrame([(d, item, text)], "day int, item_id string, text string")
        one.select("item_id", "text", F.timestamp_seconds(F.col("day") * 86400 + 1_700_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(src)
    seen = sinks.KeyedTable(spark, str(tmp_path / "seen"), ["item_id", "review_key"])
    feeds.run_available(feeds.read_stream(spark, src, max_files=1), str(tmp_path / "cp"), each=feeds.distinct_ever(seen, out, "text", "ts"))
    read = lambda: sorted((str(r.item_id), str(r.text)) for r in spark.read.parquet(out).collect())
    want = [("None", "None"), ("a", "bad"), ("a", "good"), ("b", "good")]
    assert read() == want
    # a lost checkpoint replays the batches; those that are done change nothing
    feeds.run_available(feeds.read_stream(spark, src, max_files=1), str(tmp_path / "cp2"), each=feeds.distinct_ever(seen, out, "text", "ts"))
    assert read() == want


def test_tables_of_one_file_and_of_part_files_stream_alike(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows.toPandas().to_parquet(tmp_path / "single.parquet")
    for name in ("documents", "single"):
        feeds.run_available(feeds.table_stream(spark, f"{tmp_path}/{name}.parquet"), str(tmp_path / f"cp_{name}"), str(tmp_path / f"out_{name}"))
        assert spark.read.parquet(str(tmp_path / f"out_{name}")).count() == 6
