"""Sinks: CSV with BOM, dated snapshots, keyed tables kept by version, text reports, keyword lists."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.dedupe import keep_one


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV folder, header included; the BOM goes in front of the first header of every part file."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_days(df: DataFrame, path: str) -> None:
    """Rows by their ``snapshot_date``; a day that ``df`` holds is replaced, all others stay. A large day is split over tasks, small ones share them."""
    df.hint("rebalance", "snapshot_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def write_snapshot(df: DataFrame, path: str, snapshot_date: str) -> None:
    """One dated snapshot; a rerun of the day replaces just that partition."""
    (
        df.withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class KeyedTable:
    """Table with one row per key, kept as delta files per bucket of keys, with numbered manifests.

    An upsert writes a delta that holds its own rows only, a file per bucket it touches; no other file is read or
    rewritten. Readers take the newest row per key over the deltas of each bucket. A bucket with more than
    ``max_deltas`` deltas is compacted into one, on its own. Files and manifests that the last ``keep`` manifests do
    not name are removed, so a reader has that many writes to finish.

    A manifest appears by one atomic rename, so readers see a complete state and a crash leaves the previous one;
    ``batch_id`` makes a replayed micro-batch a no-op. ``buckets`` is fixed by the first write: choose it so that a
    bucket's rows fit a few tasks. NULL is a key like any other. Columns may come later; older rows have NULL there.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 16, max_deltas: int = 8, keep: int = 3):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), list(keys), list(order)
        self.buckets, self.max_deltas, self.keep = buckets, max_deltas, max(1, keep)

    def _manifest_paths(self) -> list:
        _, fs, pattern = _fs(self.spark, f"{self.root}/manifest-*")
        return sorted((f.getPath() for f in fs.globStatus(pattern) or []), key=lambda p: p.getName())

    def _load(self, path) -> dict:
        _, fs, _ = _fs(self.spark, self.root)
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _manifest(self) -> dict:
        """The manifest in force: ``number``, last ``batch``, ``buckets`` and ``deltas``, the buckets that each delta still serves."""
        paths = self._manifest_paths()
        return self._load(paths[-1]) if paths else {"number": 0, "batch": -1, "buckets": self.buckets, "deltas": {}}

    def exists(self) -> bool:
        return bool(self._manifest_paths())

    def last_batch(self) -> int:
        return self._manifest()["batch"]

    def files(self) -> list[str]:
        """Folders that the manifest in force names, one per bucket and delta."""
        return [f"{self.root}/{d}/_bucket={b}" for d, held in self._manifest()["deltas"].items() for b in held]

    def _newest(self, df: DataFrame) -> DataFrame:
        sequence = [F.col("_seq").desc()] if "_seq" in df.columns else []
        rest = [F.col(f"`{c}`").desc_nulls_last() for c in sorted(df.columns) if c not in self.keys + self.order + ["_seq"]]
        # rows of keys alone are all the same
        return keep_one(df, self.keys, [F.col(c).desc_nulls_last() for c in self.order] + sequence + rest or [F.lit(0)])

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self._newest(self.spark.read.option("mergeSchema", True).parquet(*folders))

    def read(self) -> DataFrame:
        folders = self.files()
        if not folders:
            raise FileNotFoundError(f"{self.root} holds no rows yet")
        return self._read(folders).drop("_seq")

    def upsert(self, rows: DataFrame, batch_id: int | None = None) -> bool:
        """Add ``rows``; the newest row per key wins (by ``order``, then the later write)."""
        m = self._manifest()
        if batch_id is not None and batch_id <= m["batch"]:
            return False
        m["number"] += 1
        m["batch"] = m["batch"] if batch_id is None else batch_id
        self._add(m, self._newest(rows).withColumn("_seq", F.lit(m["number"]).cast("bigint")))
        self._publish(m)
        self.compact()
        return True

    def _add(self, m: dict, rows: DataFrame) -> None:
        """Write rows as a delta of the manifest ``m``."""
        n, delta = m["buckets"], f"delta-{m['number']:012d}-{uuid.uuid4().hex}"
        placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int"))
        placed.repartition(n, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{delta}")
        _, fs, made = _fs(self.spark, f"{self.root}/{delta}/_bucket=*")
        held = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.globStatus(made) or [])
        if held:
            m["deltas"][delta] = held

    def compact(self, force: bool = False) -> list[int]:
        """Merge the deltas of every bucket that has more than ``max_deltas`` (more than one if forced); the buckets rewritten."""
        m = self._manifest()
        per_bucket = Counter(b for held in m["deltas"].values() for b in held)
        full = sorted(b for b, c in per_bucket.items() if c > (1 if force else self.max_deltas))
        if full:
            chosen = set(full)
            merged = self._read([f"{self.root}/{d}/_bucket={b}" for d, held in m["deltas"].items() for b in held if b in chosen])
            kept = {d: [b for b in held if b not in chosen] for d, held in m["deltas"].items()}
            m["deltas"] = {d: held for d, held in kept.items() if held}
            m["number"] += 1
            self._add(m, merged)
            self._publish(m)
        self._vacuum()
        return full

    def _vacuum(self) -> None:
        """Remove manifests before the last ``keep``, and older files that none of those name: superseded ones and what crashed writers left."""
        paths = self._manifest_paths()
        kept = [self._load(p) for p in paths[-self.keep :]]
        named = {(d, b) for m in kept for d, held in m["deltas"].items() for b in held}
        _, fs, pattern = _fs(self.spark, f"{self.root}/delta-*/_bucket=*")
        for f in fs.globStatus(pattern) or []:
            delta, bucket = f.getPath().getParent().getName(), int(f.getPath().getName().split("=")[1])
            if int(delta.split("-")[1]) < kept[0]["number"] and (delta, bucket) not in named:
                fs.delete(f.getPath(), True)
        for p in paths[: -self.keep]:
            fs.delete(p, False)

    def _publish(self, m: dict) -> None:
        jvm, fs, target = _fs(self.spark, f"{self.root}/manifest-{m['number']:012d}")
        staged = jvm.org.apache.hadoop.fs.Path(f"{self.root}/next-{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(json.dumps(m).encode())
        out.close()
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, False)
            raise RuntimeError(f"another writer moved {self.root} to manifest {m['number']}")


def write_report(lines: DataFrame, path: str, columns: Sequence[str] = ("section", "ordinal"), text: str = "line") -> None:
    """Report rows to one text file. Reports hold a line per metric, so one writer task is enough."""
    lines.orderBy(*columns).select(text).coalesce(1).write.mode("overwrite").text(path)


def report_lines(metrics: DataFrame, section: str = "section", metric: str = "metric", value: str = "value") -> DataFrame:
    """Long metric table to printable lines, a heading row per section."""
    head = metrics.select(section).distinct().select(
        F.col(section).alias("section"), F.lit("").alias("ordinal"), F.concat(F.lit("## "), F.col(section)).alias("line")
    )
    body = metrics.select(
        F.col(section).alias("section"),
        F.col(metric).alias("ordinal"),
        F.concat(F.lit("- "), F.col(metric), F.lit(": "), F.coalesce(F.col(value).cast("string"), F.lit("-"))).alias("line"),
    )
    return head.unionByName(body)


def markdown_rows(df: DataFrame) -> DataFrame:
    """Every row as a Markdown table row; cells in column order."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_keywords(df: DataFrame, path: str, column: str) -> None:
    df.select(column).where(F.col(column) != "").distinct().write.mode("overwrite").option("header", True).csv(path)
