"""Casts of request parameters and money arithmetic. "" and null stay apart unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest stored string, in characters.
MAX_CHARS = 8096
TRUE_WORDS = ("true", "yes", "y", "on", "1", "t")
FALSE_WORDS = ("false", "no", "n", "off", "0", "f")


def int_or_null(v: Column) -> Column:
    """Base-10 integer without blanks around it, else null."""
    return F.when(v.rlike("^[+-]?[0-9]+$"), v.try_cast("bigint"))


def int_or_zero(v: Column) -> Column:
    return F.coalesce(int_or_null(v), F.lit(0).cast("bigint"))


def float_or_null(v: Column) -> Column:
    """Decimal floating-point syntax without type suffixes, else null. Hexadecimal floats give null."""
    return F.when(v.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), v.try_cast("double")).when(
        F.lower(v).rlike("^[+-]?(inf|infinity|nan)$"), v.try_cast("double")
    )


def bool_or_null(v: Column) -> Column:
    word = F.lower(F.trim(v))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def str_or_null(v: Column) -> Column:
    return F.when(v != "", F.left(v, F.lit(MAX_CHARS)))


def bankers_round(x: Column, places: int = 2) -> Column:
    """Half to even on the binary value, the integer part truncated toward zero."""
    scale = float(10**places)
    scaled = x * F.lit(scale)
    whole = scaled.cast("bigint").cast("double")
    rest = scaled - whole
    even = F.pmod(whole, F.lit(2.0)) == 0
    return F.when(rest == 0.5, F.when(even, whole).otherwise(whole + 1)).when(rest >= 0.5, whole + 1).otherwise(whole) / F.lit(scale)


CASTS = {"str": str_or_null, "int": int_or_null, "float": float_or_null, "bool": bool_or_null, "raw": lambda v: v}
TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "raw": "string"}

#: The same casts as SQL text over {v}: a table of many columns is built from text much faster than from objects.
CAST_SQL = {
    "str": f"case when {{v}} <> '' then left({{v}}, {MAX_CHARS}) end",
    "int": "case when {v} rlike '^[+-]?[0-9]+$' then try_cast({v} as bigint) end",
    "float": "case when {v} rlike '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' or lower({v}) rlike '^[+-]?(inf|infinity|nan)$' then try_cast({v} as double) end",
    "bool": "case when lower(trim({v})) in (" + ", ".join(f"'{w}'" for w in TRUE_WORDS) + ") then true when lower(trim({v})) in (" + ", ".join(f"'{w}'" for w in FALSE_WORDS) + ") then false end",
    "raw": "{v}",
}
