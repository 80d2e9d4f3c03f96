"""Product addresses: extraction, canonical form, product id, query rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.tags import string_array
from shelfwise.functions.text import col, let, rx, strip

_TAIL = r"[^\s\"'<>，。；、]+"
_HOSTS = r"item\.jd\.com|item\.m\.jd\.com|3\.cn|u\.jd\.com|jd\.com|m\.jd\.com|item\.taobao\.com|detail\.tmall\.com|e\.tb\.cn"
# listed one by one, the characters of a class are looked up in one table
_PLAIN = "".join(f"\\x{i:02x}" for i in range(0x21, 0x7F) if chr(i) not in "\"'<>")
_ID_KEYS = ["sku", "skuId", "wareId", "itemId", "productId", "id"]


def url_candidate(c) -> Column:
    """First address in a shared text; a text without blanks is its own candidate."""

    def searched(t: Column) -> Column:
        return F.coalesce(
            rx(t, rf"(?i)(https?://{_TAIL})"),
            rx(t, rf"(//{_TAIL})"),
            rx(t, rf"(?i)((?:{_HOSTS})/{_TAIL})"),
            F.when(~t.rlike(r"(?U)\s"), t).otherwise(F.lit("")),
        )

    def of(c: Column) -> Column:
        # most cells are one address and nothing else
        whole = c.rlike(rf"^(?:https?:)?//[{_PLAIN}]++\z") & (~F.startswith(c, F.lit("//")) | ~F.contains(c, F.lit("://")))
        return F.when(whole, c).otherwise(let(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]+", " ")), searched))

    return of(F.col(c)) if isinstance(c, str) else let(c, of)


def with_scheme(u: Column) -> Column:
    return let(
        u,
        lambda u: F.when(u == "", u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u)),
    )


def canonical_url(c, id_hosts: str = r"taobao\.com|tmall\.com", id_param: str = "id") -> Column:
    """Absolute address; on ``id_hosts`` only the product id parameter survives."""

    def trim(u: Column) -> Column:
        base = F.regexp_extract(u, r"^([^?#]*)", 1)
        ident = F.regexp_extract(u, rf"[?&]{id_param}=([^&#]+)", 1)
        kept = let(ident, lambda i: F.when(i != "", F.concat(base, F.lit(f"?{id_param}="), i)).otherwise(base))
        return F.when(url_host(u).rlike(id_hosts), kept).otherwise(u)

    return let(with_scheme(url_candidate(c)), trim)


def fetchable_url(c) -> Column:
    """Canonical address with everything outside the printable ASCII set percent-encoded; '' for bare numbers."""

    def quote(u: Column) -> Column:
        runs = F.regexp_extract_all(u, F.lit(r"([\x21-\x7e]+|[^\x21-\x7e]+)"), F.lit(1))
        encoded = F.transform(runs, lambda r: F.when(r.rlike(r"^[\x21-\x7e]"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))))
        return F.when(u.rlike(r"^https://\d{6,}$"), F.lit("")).otherwise(F.array_join(encoded, ""))

    return let(canonical_url(c), quote)


def product_id(c, min_digits: int = 6, canonical: Column | None = None) -> Column:
    """Product number of an address: query keys, then path forms, then any long digit run; ``canonical`` is its canonical form if that is known already."""
    d = rf"(\d{{{min_digits},}})"

    def pick(x: Column) -> Column:
        t, query, path = x["t"], x["query"], x["path"]
        keyed = [F.when(F.contains(query, F.lit(f"{k}=")), rx(query, rf"(?:^|&){k}=[^&]*?{d}")) for k in _ID_KEYS]
        pathed = [rx(path, p) for p in (rf"/{d}\.html", rf"/product/{d}", rf"/item/{d}", rf"/{d}(?:/|$)")]
        return F.coalesce(F.when(t.rlike(rf"^{d}$"), t), F.when(query != "", F.coalesce(*keyed)), *pathed, rx(t, d), F.lit(""))

    def split(u: Column, t: Column) -> Column:
        return F.struct(
            t.alias("t"), F.regexp_extract(u, r"\?([^#]*)", 1).alias("query"), F.regexp_extract(u, r"(?i)^https?://[^/?#]*([^?#]*)", 1).alias("path")
        )

    t = strip(F.coalesce(col(c), F.lit("")))
    return let(let(t, lambda t: let(canonical_url(t) if canonical is None else canonical, lambda u: split(u, t))), pick)


def url_host(c) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?i)^https?://([^/?#]*)", 1))


def set_query_params(c, values: dict[str, str]) -> Column:
    """Rewrite query parameters, keeping the order of the others and the fragment."""
    u = col(c)
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    fragment = F.when(F.contains(u, F.lit("#")), F.regexp_extract(u, r"(#.*)$", 1)).otherwise("")

    def rewrite(pairs: Column) -> Column:
        seen = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
        kept = F.transform(pairs, lambda p: _override(p, values))
        return F.array_join(F.concat(kept, F.transform(F.array_except(string_array(list(values)), seen), lambda k: _override(k, values))), "&")

    return F.concat(base, F.lit("?"), let(F.filter(F.split(query, "&"), lambda p: p != ""), rewrite), fragment)


def _override(pair: Column, values: dict[str, str]) -> Column:
    key = F.substring_index(pair, "=", 1)
    out = None
    for k, v in values.items():
        lit = F.lit(f"{k}={v}")
        out = F.when(key == k, lit) if out is None else out.when(key == k, lit)
    return out.otherwise(pair) if out is not None else pair
