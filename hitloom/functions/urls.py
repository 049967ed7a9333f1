"""URLs and query strings as column expressions. Regular expressions, since java.net.URI refuses what browsers send."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that never belong in a stored page address (fixed values).
EXCLUDED_PARAMS = (
    "utm_campaign", "utm_source", "utm_medium", "utm_content", "utm_term", "utm_id", "utm_source_platform", "utm_creative_format",
    "utm_marketing_tactic", "gclid", "dclid", "gbraid", "wbraid", "srsltid", "fbclid", "msclkid",
)
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas don't share subexpressions otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode(c: Column, plus: bool = True) -> Column:
    """Percent-decoded; null if malformed. plus: + stands for a blank."""
    return F.when(c.rlike("[%+]" if plus else "%"), F.try_url_decode(c if plus else F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)


def host(url: Column) -> Column:
    """Host without user info, port and the brackets of IPv6; "" if there is none."""
    name = F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", "")
    return F.when(name.startswith("["), F.regexp_extract(name, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(name, ":[0-9]*$", ""))


def path(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    return decode(raw, plus=False)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_param(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded; "" if absent."""
    return param_of_query(query(url), name)


def param_of_query(q: Column, name: str) -> Column:
    first = F.get(F.filter(F.split(q, "&"), lambda p: decode(F.substring_index(p, "=", 1)) == name), F.lit(0))
    return F.coalesce(let(first, lambda p: decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("")))), F.lit(""))


def after_mark(p: Column) -> Column:
    """What follows the first = of a pair; "" if it has none."""
    return F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, F.lit("=")) + 1)).otherwise(F.lit(""))


def parse_query(q: Column) -> Column:
    """map<string, array<string>>: all values of each key in order; malformed pairs are left out."""
    parts = F.filter(F.split(F.coalesce(q, F.lit("")), "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))

    def pair(p: Column) -> Column:
        made = lambda f: F.struct(f(F.substring_index(p, "=", 1)).alias("k"), F.array(f(after_mark(p))).alias("v"))
        return F.when(F.contains(p, F.lit("%")) | F.contains(p, F.lit("+")), made(decode)).otherwise(made(lambda c: c))  # most pairs have nothing to decode

    pairs = F.filter(F.transform(parts, pair), lambda x: x["k"].isNotNull() & F.get(x["v"], F.lit(0)).isNotNull())

    def grouped(p: Column) -> Column:
        repeated = F.map_from_entries(F.transform(F.array_distinct(p["k"]), lambda k: F.struct(k, F.flatten(F.filter(p, lambda x: x["k"] == k)["v"]))))
        return F.when(F.size(F.array_distinct(p["k"])) == F.size(p), F.map_from_entries(p)).otherwise(repeated)

    return let(pairs, grouped)


def first_value(params: Column, name: str) -> Column:
    """First value of a key of such a map; "" if absent, null if the map is null or empty."""
    return F.when(params.isNotNull() & (F.size(params) > 0), F.coalesce(F.get(F.try_element_at(params, F.lit(name)), F.lit(0)), F.lit("")))


def first_value_sql(params: str, name: str) -> str:
    """The same as SQL text over the column `params`."""
    return f"case when {params} is not null and size({params}) > 0 then coalesce(get(try_element_at({params}, '{name}'), 0), '') end"


def strip_params(url: Column, names: tuple[str, ...] = EXCLUDED_PARAMS) -> Column:
    """Without the named parameters; the rest sorted by key and re-encoded. Unchanged if none of them is there."""
    text_of = lambda p: F.coalesce(decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))), F.lit(""))
    parts = F.transform(F.filter(F.split(query(url), "&"), lambda p: p != ""), lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), text_of(p).alias("v")))
    base, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)

    def rebuilt(p: Column) -> Column:
        kept = F.filter(p, lambda x: ~F.coalesce(x["k"].isin(*names), F.lit(False)))
        kept = F.array_sort(kept, lambda a, b: F.when(a["k"] < b["k"], F.lit(-1)).when(a["k"] > b["k"], F.lit(1)).otherwise(F.lit(0)))
        text = F.array_join(F.transform(kept, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
        return F.when(F.exists(p, lambda x: x["k"].isin(*names)), F.concat(base, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")), tail)).otherwise(url)

    # One search of the text tells most addresses apart that hold none of the names.
    may = url.rlike("[?&](" + "|".join(re.escape(n) for n in names) + ")=|%") if names else F.lit(False)
    return F.when(F.contains(url, F.lit("?")) & may, let(parts, rebuilt)).otherwise(url)


_HEX2 = "%[0-9A-Fa-f]{2}"
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*+:"
_PATH = rf"[^%?#]*+(?:{_HEX2}[^%?#]*+)*+"
_USER = rf"(?:(?:[A-Za-z0-9\-._:~!$&'()*+,;=@]|{_HEX2})*@)?"
_HOST = r"""(?:\[[^\]/?#]*\](?::[0-9]*)?|(?:[A-Za-z0-9\-_.~!$&'()*+,;=<>"\u0080-\uffff]|%[89A-Fa-f][0-9A-Fa-f]|%25)*+(?::[0-9]*)?)"""
#: What counts as an address: no control characters, whole escapes in path and fragment, a host of allowed characters with a port of digits, no
#: colon in the first part of a path unless it ends a scheme. The query is not looked at.
_READABLE = (
    rf"^(?![\s\S]*[\x00-\x1f\x7f])(?:{_SCHEME}(?!/)[^#]*+|(?:(?:{_SCHEME})?//{_USER}{_HOST}(?=[/?#]|$)|(?:{_SCHEME})?(?=/(?!/))|(?=///)|(?=[^:/?#]*+(?:[/?#]|$)))"
    rf"{_PATH}(?:\?[^#]*+)?)(?:#[^%]*+(?:{_HEX2}[^%]*+)*+)?$"
)


def readable(url: Column) -> Column:
    """Can the address be parsed at all?"""
    return url.rlike(_READABLE)


def without_www(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def normalize_label(v: Column) -> Column:
    """Lower case, blanks to hyphens, separators removed."""
    return F.trim(F.translate(F.lower(v), " /\\?&=#", "-"))
