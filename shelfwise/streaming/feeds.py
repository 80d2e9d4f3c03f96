"""Incremental feeds: review de-duplication, keyed upserts, quota windows, alerts, change capture."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import quality as ql
from shelfwise.operators.dedupe import keep_one
from shelfwise.operators.snapshots import change_log
from shelfwise.sources.sinks import KeyedTable


def read_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """Files of a folder that match ``pattern`` as a stream, with the schema of what is there now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return read_stream(spark, path, "*")
    return read_stream(spark, str(place.getParent()), place.getName())


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need TIMESTAMP; files written without a zone load as TIMESTAMP_NTZ."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def distinct_reviews(stream: DataFrame, keys: Sequence[str], text: str, time: str, delay: str = "7 days", chars: int | None = None) -> DataFrame:
    """First arrival of every ``(keys, text)``; state holds a hash per review and expires with the watermark.

    The text counts whole, or ``chars`` of its head (the published form has 100).
    """
    own = F.substring(text, 1, chars) if chars else F.col(text)
    return stream.withWatermark(time, delay).withColumn("review_key", F.sha2(own, 256)).dropDuplicatesWithinWatermark([*keys, "review_key"])


def distinct_ever(seen: KeyedTable, out: str, text: str, time: str, chars: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the first arrival of every ``(seen.keys, text)``, however late a repeat comes.

    ``seen`` is keyed by the columns that name the item and ``review_key``, the hash of the text (or of ``chars`` of its head); it holds keys
    only, so a batch is one anti-join by key and the stream itself keeps no state. The rows of a batch are one
    folder named by its id and ``seen`` moves last: a replay after a crash in between repeats the same rows, one after it does nothing.
    NULL keys and texts are values; among repeats in a batch the earliest stays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= seen.last_batch():
            return
        own = F.substring(text, 1, chars) if chars else F.col(text)
        keyed = batch.withColumn("review_key", F.sha2(own, 256))
        rest = [F.col(c).asc_nulls_first() for c in batch.columns if c != time]
        new = keep_one(keyed, seen.keys, [F.col(time).asc_nulls_last(), *rest])
        if seen.files():
            known = seen.read().select(*[F.col(k).alias(f"_{k}") for k in seen.keys])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in seen.keys]
            new = new.join(known, same, "left_anti")
        folder = f"{out}/batch_id={batch_id}"
        new.write.mode("overwrite").parquet(folder)
        written = batch.sparkSession.read.schema(new.schema).parquet(folder)
        seen.upsert(written.select(*seen.keys), batch_id)

    return write


def quota_windows(stream: DataFrame, time: str, quota: int, delay: str = "7 hours", start_hour: int = 23, end_hour: int = 6) -> DataFrame:
    """Rows per night or day window of a crawler and the rest of its quota.

    One tumbling day that opens at ``start_hour`` holds a night and the following calendar day; late rows
    are accepted for ``delay``.
    """
    hour = F.hour(time)
    scope = F.when((hour >= start_hour) | (hour < end_hour), "night_window").otherwise("calendar_day")
    day = F.window(time, "1 day", startTime=f"{start_hour} hours")
    counts = stream.withWatermark(time, delay).groupBy(day.alias("w"), scope.alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    opened = F.when(F.col("scope") == "night_window", F.col("w.start")).otherwise(F.col("w.start") + F.make_dt_interval(hours=F.lit(24 - start_hour)))
    return counts.select("scope", opened.alias("window_start"), "n", F.greatest(F.lit(quota) - F.col("n"), F.lit(0)).alias("remaining"))


def feed_alerts(stream: DataFrame, time: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Alert rules over the feed metrics of every event-time window."""
    windowed = stream.withWatermark(time, delay).withColumn("w", F.window(time, width))
    return ql.alerts(ql.feed_metrics(windowed, ["w"]), ["w"]).select(F.col("w.start").alias("window_start"), "metric", "value", "threshold", "message")


def upsert_into(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that keeps the newest row per key; a replayed batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id)

    return write


def capture_changes(table: KeyedTable, log_path: str, key: str, order: Sequence[str], **log_options) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that logs field changes against the current table, then upserts the batch.

    The log of a batch is one folder named by its id, so a replay overwrites the same rows.  The table
    moves last: a crash in between repeats both steps on the same table version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = keep_one(batch, [key], [F.col(c).desc_nulls_last() for c in order])
        if table.exists():
            log = change_log(table.read(), newest, key, **log_options)
            log.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        table.upsert(newest, batch_id)

    return write


def run_available(stream: DataFrame, checkpoint: str, path: str | None = None, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process what is there and stop; to a Parquet folder, or through ``each`` batch by batch."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).start()
    q.awaitTermination()
