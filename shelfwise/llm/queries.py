"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import language, licenses, merkle, near_dedup, packing, perplexity, piece_bpe, quotient_dedup, resample, simple8b, suffix_tree, url_filter, word_pieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_piece_bpe")
def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip_digests(documents(spark, sf_dir))


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; their source stands for the host, their stated language for the markup's."""
    return language.with_language(documents(spark, sf_dir)).select("doc_id", F.col("lang").alias("declared"), "language.predicted", "language.posterior", F.col("language.accepted").alias("kept"))


@query("page_languages")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for raw pages: the language of the ``html`` tag, the host of the address and its suffix."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("markup", F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1), F.lit("")))
    visible = pages.withColumn("visible", F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[#\w]+;", " "))
    judged = language.with_language(visible, "visible", F.col("markup"), F.nullif(url_filter.parts(F.col("url"))[0], F.lit("")))
    return judged.select("page_id", "markup", "language.predicted", "language.posterior", F.col("language.accepted").alias("kept"))


@query("op3_minhash_dedup")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir)).drop("row")


@query("op4_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query(
    "op5_url_filter",
    r"""
    with rules(rule_host, rule_path, rule_verdict) as (
      values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
    ),
    rests as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    parsed as (
      select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
      from rests
    ),
    forms as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') as form from parsed),
    listed as (select distinct form from forms where regexp_matches(host, '(^|\.)spam')),
    fitting as (
      select page_id, host, path, form, rule_host || rule_path as rule, rule_verdict,
             row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last, length(rule_host) desc) as n
      from forms left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
    )
    select page_id, host, path, rule, coalesce(rule_verdict, case when listed.form is not null then 'block' else 'allow' end) as verdict
    from fitting left join listed on fitting.form = listed.form where n = 1
    """,
)
def filtered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), url_filter.spam_pages(pages))


@query("op6_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"]
    return perplexity.with_quality(documents(spark, sf_dir)).select("doc_id", *(f"quality.{n}" for n in names))


@query("op7_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@query(
    "op8_exact_dedup",
    r"""
    with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
    select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
           doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
    from d
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient_dedup.exact_groups(documents(spark, sf_dir)).drop("row")


@query("op9_token_counts")
def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pieces.token_counts(documents(spark, sf_dir))


@query("op10_simple8b_tokens")
def simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(documents(spark, sf_dir))


#: CRC-32 of a column of bytes, by its table of 256 entries.
CRC_TABLE = """
    crc_steps(b, k, v) as (
      select range, 0, range from range(256)
      union all select b, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc_steps where k < 8
    ),
    crc_table as (select list(v order by b) as crc from crc_steps where k = 8)
"""


def crc_sql(text: str) -> str:
    """The CRC-32 of a string expression where ``crc_table`` is joined."""
    bytes_ = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || hex(encode({text}))[(2 * i + 1):(2 * i + 2)])::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8)), 4294967295)"


@query(
    "op11_merkle_manifest",
    f"""
    with recursive {CRC_TABLE},
    fields as (
      select *, case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end || case when source is null then '-' else strlen(source) || ':' || source end
                || case when lang is null then '-' else strlen(lang) || ':' || lang end as head,
             case when text is null then '-' else strlen(text) || ':' || text end as tail,
             coalesce({crc_sql("doc_id::varchar")} % 7 = 0, false) as chosen
      from documents, crc_table
    ),
    leaves as (
      select doc_id, lang, sha256(head || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end || tail) as leaf,
             sha256(head || case when n_chars is null then '-' else strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1) end || tail) as changed, chosen
      from fields
    ),
    placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves),
    trees as (select lang, row_number() over (order by lang nulls first) - 1 as t, count(*) over () as n from (select distinct lang from leaves)),
    grown(lang, level, i, n, h) as (
      select lang, 0, i, n, leaf from placed
      union all select lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from grown where n > 1 group by lang, level, i // 2, n
    ),
    subroots as (select t, trees.n, trees.lang, h as subroot, level as height from grown join trees on grown.lang is not distinct from trees.lang where grown.n = 1),
    above(level, i, n, h) as (
      select 0, t, n, subroot from subroots
      union all select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from above where n > 1 group by level, i // 2, n
    ),
    top as (select h as root, level as height from above where n = 1),
    nodes as (
      select t, level, i, h from grown join trees on grown.lang is not distinct from trees.lang where grown.n > 1
      union all select -1, level, i, h from above where n > 1
    ),
    ways as (select placed.*, subroots.t, subroot, subroots.height as own_height, root, top.height + subroots.height as height from placed join subroots on placed.lang is not distinct from subroots.lang, top),
    steps as (
      select rn, step, case when step < own_height then t else -1 end as tree, case when step < own_height then step else step - own_height end as level,
             case when step < own_height then i >> step else t >> (step - own_height) end as here
      from (select *, row_number() over () as rn from ways) w, range(64) r(step) where step < height
    ),
    met as (select rn, step, here, h from steps left join nodes on tree = t and steps.level = nodes.level and nodes.i = xor(here, 1)),
    folded(rn, step, h) as (
      select row_number() over (), 0, case when chosen then changed else leaf end from ways
      union all select f.rn, f.step + 1, sha256(case when here % 2 = 1 then m.h || f.h else f.h || coalesce(m.h, '') end) from folded f join met m on f.rn = m.rn and f.step = m.step
    ),
    proofs as (select rn, sha256(coalesce(string_agg(h, '' order by step), '')) as proof_sha256 from met group by rn)
    select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = root as verified
    from (select *, row_number() over () as rn from ways) w join folded f on w.rn = f.rn and f.step = w.height left join proofs p on p.rn = w.rn
    """,
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(documents(spark, sf_dir))


@query(
    "op12_importance_resampling",
    f"""
    with recursive {CRC_TABLE},
    texts as (select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
    own as (select kind, id, row_number() over () as rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
    runs as (
      select kind, rn, unnest(w) as f from own
      union all select kind, rn, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from own
      union all select kind, rn, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from own
    ),
    counted as (select kind, rn, f, count(*) as n from runs group by all),
    hashed as (select f, {crc_sql("f")} % 10000 as bucket from (select distinct f from counted), crc_table),
    buckets as (select bucket, sum(n) filter (kind = 0) as s, sum(n) filter (kind = 1) as t from counted join hashed using (f) group by bucket),
    totals as (select sum(s) as all_s, sum(t) as all_t from buckets),
    gains as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (coalesce(all_s, 0) + 10000))::double / ((coalesce(s, 0) + 1) * (coalesce(all_t, 0) + 10000))::double))::bigint as gain from buckets, totals),
    weighed as (
      select id as doc_id, len(w) as n_words, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) as n_features, coalesce(weight, 0)::bigint as weight
      from own left join (select rn, sum(n * gain) as weight from counted join hashed using (f) join gains using (bucket) where kind = 0 group by rn) using (rn) where kind = 0
    ),
    scored as (select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from weighed),
    ranked as (select *, row_number() over (order by n_words < 20, score desc, doc_id nulls first) as place, count(*) filter (n_words >= 20) over () as eligible from scored)
    select doc_id, n_features, weight, score, case when place <= 5 * eligible // 100 then place end as rank from ranked
    """,
)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_suffix_tree")
def suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(documents(spark, sf_dir), suffix_tree.seventh(F.col("doc_id")))
