"""Places of rows in a total order without a window over all of them, and staged tables that are dropped once they are read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources import staging

WITHIN = (1 << 33) - 1


def staged(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table in the shared folder, and what removes it when no plan reads it any more."""
    spark = df.sparkSession
    path = staging.new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: staging.drop(spark, path)


def positions(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their places 0, 1, 2 ... by ``order`` (nulls first, strings by their bytes) in a new column ``name``.

    Rows are dealt by range and sorted within their partition; a partition's first place is the number of rows before it, from a table
    with one row per partition. One key may hold any share of the rows: the order has more columns than the key, and a range splits it.
    Rows equal in all of ``order`` take neighbouring places in any order. An empty table stays empty.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = staging.stage(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(WITHIN).alias("__at")))
    sizes = table.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("__part", (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__begin"))
    # As many rows as partitions, whatever the table holds.
    return table.join(F.broadcast(begins), "__part").withColumn(name, F.col("__begin") + F.col("__at")).drop("__part", "__at", "__begin")
