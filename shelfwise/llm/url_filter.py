"""URL filters: a blocked Bloom filter of listed keys, then an exact hash join. DataFrame functions only.

A key is ``host|directory`` for a rule and ``canonical URL`` for a listed page. A filter block is one row of eight 64-bit words; a key
sets one bit in each word of its block. URLs whose keys pass the filter, few of them by chance, meet the exact keys in a hash join.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.staging import stage

WORDS = 8
KEYS_PER_BLOCK = 24
#: Tables of at most so many rows (72 bytes a filter block, a URL a key) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query, fragment, a leading ``www.`` and closing slashes don't tell pages apart."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def directory(path: Column, depth: Column) -> Column:
    """The path up to its ``depth``-th slash; one slash for depth 0."""
    return F.concat(F.call_function("substring_index", path, F.lit("/"), depth), F.lit("/"))


def bits(key: Column) -> tuple[Column, list[Column]]:
    """A key's hash for its block, and its bit in each word."""
    spread = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    return F.xxhash64(key), [F.call_function("shiftleft", one, F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows ``block, w0 .. w7`` of a column ``key``."""
    place, own = bits(F.col("key"))
    return keys.select(F.pmod(place, F.lit(blocks)).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(own))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def possible(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Candidates whose ``key`` may be listed; none that is listed is lost."""
    place, own = bits(F.col("key"))
    held = bloom if blocks > BROADCAST_ROWS else F.broadcast(bloom)
    met = candidates.withColumn("block", F.pmod(place, F.lit(blocks))).join(held, "block")
    for i, b in enumerate(own):
        met = met.filter(F.col(f"w{i}").bitwiseAND(b) != 0)
    return met.drop("block", *(f"w{i}" for i in range(WORDS)))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``rules`` has ``host, path, verdict``: a rule fits its host and all subdomains where the path starts with its own; an empty or null path
    fits the whole host, and a null host fits none. The rule of the
    most characters wins, then the longer host, then the rule's text. Without a rule, a URL whose canonical form is among the
    canonical forms of ``listed.url`` is blocked, any other allowed. Null URLs and such without ``://`` have an empty host and path and are
    allowed; pages may repeat, other columns are ignored, and an empty table gives no rows.
    """
    rules = rules.filter("host is not null").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct().withColumn("labels", count_of(F.col("host"), ".") + 1).withColumn("depth", count_of(F.col("path"), "/"))
    rules = rules.withColumn("key", F.concat("host", F.lit("|"), directory(F.col("path"), F.col("depth"))))
    # Rules come in few shapes (labels of the host, slashes of the path): a URL has one key per shape, however long it is.
    shapes = [F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["depth"]).alias("depth")) for r in rules.select("labels", "depth").distinct().orderBy("labels", "depth").collect()]
    host, path = parts(F.col("url"))
    listed_host, listed_path = parts(F.col("listed_url"))
    names = listed.select(F.col("url").alias("listed_url")).filter("listed_url is not null").select(F.concat(F.lit("="), canonical(listed_host, listed_path)).alias("key")).distinct()
    exact = stage(rules.select("key", F.concat("host", "path").alias("rule"), F.col("path").alias("rule_path"), F.col("host").alias("rule_host"), "verdict").unionByName(names, allowMissingColumns=True))
    n = exact.count()
    blocks = max(1, math.ceil(n / KEYS_PER_BLOCK))

    urls = pages.select(F.col(url_col).alias("url")).filter("url is not null").distinct().select("url", host.alias("host"), path.alias("path")).filter("host != '' or path != ''")
    of_rules = F.transform(F.array(*shapes), lambda s: F.when((count_of(F.col("host"), ".") + 1 >= s.labels) & (count_of(F.col("path"), "/") >= s.depth), F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s.labels), F.lit("|"), directory(F.col("path"), s.depth)))) if shapes else F.array().cast("array<string>")
    keys = F.concat(of_rules, F.array(F.concat(F.lit("="), canonical(F.col("host"), F.col("path")))))
    candidates = urls.select("url", "path", F.explode(keys).alias("key")).filter("key is not null")
    passed = possible(candidates, bloom_filter(exact.select("key"), blocks), blocks)
    hits = passed.join(F.broadcast(exact) if n <= BROADCAST_ROWS else exact.hint("shuffle_hash"), "key").filter(F.col("rule").isNull() | F.col("path").startswith(F.col("rule_path")))
    order = F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), F.col("rule"), F.col("verdict"))
    best = stage(hits.groupBy("url").agg(F.max(F.when(F.col("rule").isNotNull(), order)).alias("best"), F.max(F.col("rule").isNull()).alias("listed")))

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).join(best, "url", "left")
    return rows.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")).alias("verdict"))


def spam_pages(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs on hosts with a label that begins with ``spam``: a list to block that grows with the pages."""
    host, _ = parts(F.col(url_col))
    return pages.select(F.col(url_col).alias("url")).filter(host.rlike(r"(^|\.)spam"))
