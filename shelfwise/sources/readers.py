"""Scans: all-string CSV, typed CSV, JSON dictionaries and chunked product arrays."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumnError(ValueError):
    """A required column is absent under every accepted name."""


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv_strings(spark: SparkSession, path, columns: Sequence[str], encoding: str = "UTF-8", blank_nulls: bool = True, line_breaks: bool = False) -> DataFrame:
    """CSV with a header, every column as text; with ``line_breaks`` a quoted cell may hold some, and then a file is one task.

    The encoding is an argument of the job: a wrong charset does not raise in Spark.  gb18030 and gbk
    need ``spark.sql.legacy.javaCharsets=true`` on the session.
    """
    df = (
        spark.read.schema(string_schema(columns))
        .option("header", True)
        .option("encoding", encoding)
        .option("multiLine", line_breaks)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    first = columns[0]
    return (df.na.fill("") if blank_nulls else df).withColumn(first, F.regexp_replace(first, "^﻿", ""))


#: Fixed order: the charsets that files are tried with; the last one is taken where none fits.
CHARSETS = ("UTF-8", "GB18030", "GBK")
#: Bytes, one character each, of lines that are valid: one, two or four bytes a character, and two at most.
_TWO = "[\\x81-\\xfe][\\x40-\\x7e\\x80-\\xfe]"
_VALID = {"GB18030": f"^(?:[\\x00-\\x7f]|{_TWO}|[\\x81-\\xfe][0-9][\\x81-\\xfe][0-9])*+$", "GBK": f"^(?:[\\x00-\\x80]|{_TWO})*+$"}


def file_charsets(spark: SparkSession, path, charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """``file, charset``: the first of ``charsets`` in which every line of the file is valid, else the last.

    No line feed is part of a longer character in any of them, so lines are checked where they are read: large files stay splittable, and one
    small row per split is shuffled. Files without a line have no row.
    """
    lines = spark.read.text(path)  # its strings are the file's bytes, not looked at
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    valid = {c: F.expr("is_valid_utf8(value)") if c == "UTF-8" else raw.rlike(_VALID[c]) for c in charsets}
    seen = lines.groupBy(F.input_file_name().alias("file")).agg(*(F.bool_and(v).alias(c) for c, v in valid.items()))
    return seen.select("file", F.coalesce(*(F.when(F.col(c), F.lit(c)) for c in charsets), F.lit(charsets[-1])).alias("charset"))


def read_csv_routed(spark: SparkSession, path, columns: Sequence[str], charsets: Sequence[str] = CHARSETS, line_breaks: bool = True, **kw) -> DataFrame:
    """CSV files of several charsets in one table, every column as text: one scan per charset that occurs.

    The driver learns the files' names and charsets, as it does to plan any scan. Sets ``spark.sql.legacy.javaCharsets``, without which Spark knows
    no charset of these but UTF-8. Files without a line add no rows; without any file with lines the table is empty.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    by_charset: dict[str, list[str]] = {}
    for row in file_charsets(spark, path, charsets).orderBy("file").collect():
        # names come percent-encoded, the reader wants plain ones
        by_charset.setdefault(row["charset"], []).append(unquote(row["file"]))
    parts = [read_csv_strings(spark, files, columns, charset, line_breaks=line_breaks, **kw) for charset, files in sorted(by_charset.items())]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], string_schema(columns))


def read_csv_typed(spark: SparkSession, path, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """CSV with an explicit schema; dirty cells become NULL."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)


def read_dictionary(spark: SparkSession, path, key: str = "id", value: str = "name") -> DataFrame:
    """JSON object files ``{id: name}`` as a two-column table, blank keys dropped."""
    raw = spark.read.option("wholetext", True).text(path)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    return pairs.select(F.trim("k").alias(key), F.trim("v").alias(value)).where(F.col(key) != "")


PRODUCT_FIELDS = ["brand", "level2", "category", "price", "title", "sku"]


def product_tuples(raw: DataFrame, column: str = "value") -> DataFrame:
    """Rows holding a JSON array of positional products to typed columns."""
    item = raw.select(F.explode(F.from_json(column, "array<array<string>>")).alias("p"))
    cols = [F.try_element_at("p", F.lit(i)).alias(n) for i, n in enumerate(PRODUCT_FIELDS, 1)]
    return item.select(*cols).withColumn("price", F.col("price").try_cast("double"))


def read_product_chunks(spark: SparkSession, path) -> DataFrame:
    """Chunk files, each a JSON array of positional products."""
    return product_tuples(spark.read.option("wholetext", True).text(path))


def resolve_name(df: DataFrame, aliases: Sequence[str], ignore_case: bool = True) -> str | None:
    """First alias present in the frame."""
    present = {(c.lower() if ignore_case else c): c for c in reversed(df.columns)}
    for a in aliases:
        hit = present.get(a.lower() if ignore_case else a)
        if hit is not None:
            return hit
    return None


def conform(df: DataFrame, spec: Mapping[str, Mapping], ignore_case: bool = True) -> DataFrame:
    """Project to a fixed schema.

    ``spec`` maps a target name to ``{"aliases": [...], "type": "double", "default": None, "required":
    False, "clean": fn}``; ``clean`` is applied to the source column before the ``try_cast``.
    """
    out: list[Column] = []
    missing: list[str] = []
    for target, rule in spec.items():
        source = resolve_name(df, [target, *rule.get("aliases", [])], ignore_case)
        dtype = rule.get("type", "string")
        if source is None:
            if rule.get("required"):
                missing.append(target)
                continue
            out.append(F.lit(rule.get("default")).cast(dtype).alias(target))
            continue
        c = F.col(f"`{source}`")
        clean = rule.get("clean")
        c = clean(c) if clean else c
        if dict(df.dtypes)[source] != dtype or clean:
            c = c.try_cast(dtype)
        if rule.get("default") is not None:
            c = F.coalesce(c, F.lit(rule["default"]).cast(dtype))
        out.append(c.alias(target))
    if missing:
        raise MissingColumnError(f"required columns absent: {', '.join(missing)}; found {df.columns}")
    return df.select(*out)


def live_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value, then rows without a single value.

    One aggregate row comes back to the driver: it decides the schema, so it cannot stay lazy.
    """
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if counts[c]]
    return df.select(*[F.col(f"`{c}`") for c in keep]).na.drop(how="all")


def null_counts(df: DataFrame) -> DataFrame:
    """Values per column as rows ``(column, non_null)``: the aggregate behind :func:`live_columns`."""
    agg = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return agg.unpivot([], agg.columns, "column", "non_null")


def translate(df: DataFrame, column: str, dictionary: DataFrame, key: str = "id", value: str = "name", into: str | None = None) -> DataFrame:
    """Dictionary lookup, identity when unknown. Spark broadcasts the dictionary when its size allows."""
    d = dictionary.select(F.col(key).alias("_k"), F.col(value).alias("_v")).dropDuplicates(["_k"])
    joined = df.join(d, F.trim(F.col(column)) == F.col("_k"), "left")
    return joined.withColumn(into or column, F.coalesce("_v", F.trim(F.col(column)), F.lit(""))).drop("_k", "_v")
