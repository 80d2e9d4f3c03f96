"""The views of :mod:`shelfwise.sources.views` as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from shelfwise.sources.views import _PROMOTIONS


def cents(e: str) -> str:
    return f"(floor(({e}) * 100 + 0.5) / 100)"


def rnd(e: str, digits: int = 4) -> str:
    """SQL form of :func:`shelfwise.functions.text.stable_round`."""
    s = 10**digits
    return f"(floor((({e}) + 1e-7) * {s} + 0.5) / {s})"


_PROMO = "[" + ", ".join(f"'{p}'" for p in _PROMOTIONS) + "]"


def promo(d: str) -> str:
    return f"({_PROMO})[CAST(floor({d} * 100 + 0.5) AS INT) + 1]"


def bands(c: str, bounds, labels, closed: str = "left", null_label: str = "未知") -> str:
    op = "<" if closed == "left" else "<="
    whens = " ".join(f"WHEN {c} {op} {b} THEN '{x}'" for b, x in zip(bounds, labels))
    return f"CASE WHEN {c} IS NULL THEN '{null_label}' {whens} ELSE '{labels[-1]}' END"


STORE_TYPE = "CASE WHEN regexp_matches(shop, '京东自营|自营旗舰店|自营店|京东超市|京东生鲜') THEN '京东自营' ELSE '第三方店铺' END"
PROMO_KIND = (
    "CASE WHEN promotion = '' THEN '无促销' WHEN regexp_matches(promotion, '券|礼金') THEN '优惠券/礼金' "
    "WHEN regexp_matches(promotion, '满|减|每') THEN '满减' WHEN regexp_matches(promotion, '直降|特价|秒杀|折') THEN '限时特价/折扣' "
    "WHEN contains(promotion, '包邮') THEN '包邮' ELSE '其他促销' END"
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "part_c": ((), f"""
        SELECT p_partkey, p_name AS title, p_brand AS brand, p_type AS level2,
               p_type || ' ' || split_part(p_name, ' ', 2) AS category, split_part(p_name, ' ', 1) AS flavor,
               CAST(p_size * 10 AS DOUBLE) AS weight_g, {cents('p_retailprice / p_size')} AS price
        FROM part"""),
    "catalog": (("part_c",), f"""
        SELECT *, price / weight_g AS unit_price, greatest((original_price - price) / original_price, 0.0) AS discount_rate
        FROM (
          SELECT CAST(p_partkey AS VARCHAR) AS sku, title, brand, level2, category, flavor, weight_g, price,
                 {cents('price / (1 - coalesce(d, 0.0))')} AS original_price,
                 coalesce(sales, 0.0) AS sales, coalesce(comments, 0.0) AS comments, coalesce(shops, 0) AS shops,
                 'Supplier ' || coalesce(CAST(shop_key AS VARCHAR), '?') AS shop,
                 {promo('coalesce(d, 0.0)')} AS promotion, coalesce(d, 0.0) > 0 AS has_promotion,
                 CASE WHEN weight_g >= 300 THEN '箱装' WHEN weight_g >= 100 THEN '袋装' ELSE '' END AS package_type,
                 weight_g > 400 AS is_gift, CAST(crawl_time AS DATE) AS crawl_date
          FROM part_c LEFT JOIN (
            SELECT l_partkey, sum(l_quantity) AS sales, CAST(count(*) AS DOUBLE) AS comments, count(DISTINCT l_suppkey) AS shops,
                   min(l_suppkey) AS shop_key, max(l_shipdate) AS crawl_time,
                   arg_max(l_discount, row(l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) AS d
            FROM lineitem GROUP BY l_partkey) s ON p_partkey = l_partkey)"""),
    "offers": (("part_c",), f"""
        SELECT CAST(l_partkey AS VARCHAR) AS sku, title, brand, level2, category, flavor, weight_g, s_name AS shop_key,
               s_name || CASE WHEN s_nationkey < 8 THEN '京东自营旗舰店' WHEN s_nationkey < 16 THEN '专营店' ELSE '店铺' END AS shop,
               {cents('l_extendedprice / l_quantity / 100')} AS price,
               {cents(cents('l_extendedprice / l_quantity / 100') + ' / (1 - l_discount)')} AS original_price,
               l_quantity AS sales, floor(l_tax * 100 + 0.5) AS comments, {promo('l_discount')} AS promotion, l_discount AS discount,
               CAST(l_shipdate AS DATE) AS ship_date, l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_extendedprice AS amount
        FROM lineitem JOIN (SELECT * EXCLUDE (price) FROM part_c) ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""),
    "listing": (("offers",), """
        SELECT CASE l_returnflag WHEN 'A' THEN sku || '.0' WHEN 'R' THEN ' ' || sku || ' ' ELSE sku END AS item_id,
               '【' || level2 || '】' || brand || ' ' || title || ' ' || CAST(CAST(weight_g AS INT) AS VARCHAR) || 'g*' || CAST(q AS VARCHAR) || '袋' AS title,
               '￥' || money AS price, '原价 ' || money || ' 元' AS original_price, promotion AS promotion_tag,
               CAST(CAST(comments AS INT) AS VARCHAR) || '万+' AS review_count,
               CASE l_returnflag WHEN 'N' THEN CAST(q AS VARCHAR) || '+' WHEN 'A' THEN CAST(q * 100 AS VARCHAR) || '+'
                    ELSE CAST(q // 10 AS VARCHAR) || '.' || CAST(q % 10 AS VARCHAR) || '万+' END AS sales_text,
               ' ' || shop || '　' AS shop_name, 'Goods > ' || level2 || ' > ' || split_part(category, ' ', 2) AS category_breadcrumb,
               '//item.jd.com/' || lpad(sku, 9, '1') || '.html?from=list' AS detail_url, CAST(ship_date AS VARCHAR) AS crawl_time,
               year(ship_date) AS crawl_year, l_orderkey, l_linenumber, l_suppkey, amount, sku, q, shop, level2, category, brand, weight_g
        FROM (SELECT *, CAST(sales AS INT) AS q, CAST(floor(price * 100 + 0.5) AS BIGINT) AS c,
                     CASE WHEN c // 100 >= 1000 THEN CAST(c // 100000 AS VARCHAR) || ',' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0')
                          ELSE CAST(c // 100 AS VARCHAR) END || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS money FROM offers)"""),
    "snap_last": (("offers",), """
        SELECT * FROM offers
        QUALIFY row_number() OVER (PARTITION BY sku ORDER BY ship_date DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, sales DESC, amount DESC) = 1"""),
    "snap_old": (("offers",), """
        SELECT * REPLACE (sku || '@' || year(ship_date) AS sku) FROM offers WHERE year(ship_date) < (SELECT max(year(ship_date)) FROM offers)
        QUALIFY row_number() OVER (PARTITION BY offers.sku, year(ship_date) ORDER BY ship_date DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, sales DESC, amount DESC) = 1"""),
    "snap_new": (("offers",), """
        SELECT * REPLACE (sku || '@' || (year(ship_date) - 1) AS sku) FROM offers WHERE year(ship_date) > (SELECT min(year(ship_date)) FROM offers)
        QUALIFY row_number() OVER (PARTITION BY offers.sku, year(ship_date) ORDER BY ship_date DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, sales DESC, amount DESC) = 1"""),
    "feed": ((), """
        SELECT event_id, ts, user_id AS item_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'access_blocked'
               WHEN 'view' THEN 'no_result' ELSE 'success' END AS status, value, CAST(json_extract_string(props, '$.k') AS INT) AS cards
        FROM events"""),
    "reviews": ((), """
        SELECT d.doc_id, d.text, d.lang, d.source AS item_id, d.n_chars, coalesce(toxic = 1 OR quality = 0, false) AS negative
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "questions": ((), "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id, text FROM conversations WHERE role = 'user'"),
    "banded": (("catalog",), """
        SELECT * EXCLUDE (q1, q2, med, dd), CASE WHEN dd < 3 THEN '中价'
                 WHEN q1 >= q2 THEN CASE WHEN price < med THEN '低价' WHEN price > med THEN '高价' ELSE '中价' END
                 WHEN price <= q1 THEN '低价' WHEN price <= q2 THEN '中价' ELSE '高价' END AS price_band
        FROM catalog JOIN (SELECT category, quantile_cont(price, 0.33) AS q1, quantile_cont(price, 0.66) AS q2, median(price) AS med,
                                  count(DISTINCT price) AS dd FROM catalog GROUP BY category) USING (category)"""),
}


def with_views(names: Sequence[str], body: str) -> str:
    """Prefix ``body`` with the named views and what they need, in dependency order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    return f"WITH {ctes}\n{body}" if not body.upper().startswith("WITH ") else f"WITH {ctes},\n{body[5:]}"
