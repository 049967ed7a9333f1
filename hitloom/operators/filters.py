"""Traffic filters: conditions as Spark SQL text over an event's fields."""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addresses


@dataclass(frozen=True)
class Condition:
    """name, kind ("exclude" or "allow"), test mode, expression."""

    name: str
    kind: str
    expression: str
    test_mode: bool = False


@contextmanager
def nulls_for_errors(spark: SparkSession):
    """Expressions resolved inside give null where they would fail on a row (a text that is no number, a division by 0)."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


#: Quoted text and names, which stay as they are; whole numbers beside a comparison or in BETWEEN.
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`"""
_COMPARED = re.compile(rf"({_QUOTED})|((?<=[<>=])\s*|\bbetween\s+|\band\s+)?(?<![\w.])(\d+)(?![\w.])(?=(\s*[<>=!]|\s+and\b)?)", re.S | re.I)


def as_numbers(expression: str) -> str:
    """The expression with the whole numbers that something is compared with as doubles: Spark then compares text with them as a number
    and doesn't cut the text to a whole number first."""
    return _COMPARED.sub(lambda m: f"{m[2] or ''}{m[3]}D" if m[3] and (m[2] is not None or m[4]) else m[0], expression)


def check_patterns(df: DataFrame) -> None:
    """Raise ValueError for a constant regular expression in df's last projection that can't be compiled. No row is read."""
    compile_ = df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile
    todo = [df._jdf.queryExecution().analyzed().expressions()]
    while todo:
        nodes = todo.pop()
        for i in range(nodes.length()):
            node = nodes.apply(i)
            children = node.children()
            if node.getClass().getSimpleName() in ("RLike", "RegExpReplace", "RegExpExtract", "RegExpExtractAll", "RegExpCount", "RegExpSubStr", "RegExpInStr", "StringSplit") and children.apply(1).foldable():
                pattern = children.apply(1).eval(None)
                try:
                    compile_(pattern.toString()) if pattern is not None else None
                except IllegalArgumentException as e:
                    raise ValueError(f"not a regular expression: {pattern.toString()}") from e
            todo.append(children)


def apply_filters(df: DataFrame, conditions: list[Condition], fields: list[str], functions: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """Drop excluded events; where an allow condition exists, keep only what matches one; exclude beats allow.

    An expression sees the fields, as strings (null: "<nil>"; a field that df lacks: ""), and Spark's functions: startswith, endswith,
    contains, rlike, in_cidr(address, network) and those given (name -> parameters, result, body, of SQL functions). Against a number a
    field counts as a number, fractions included.
    Test-mode matches only tag: traffic_filter_name is the last of them. A condition that isn't true or false, or fails on an event, is
    skipped for it; text that Spark can't parse or resolve, and a constant pattern that isn't one, fail when the plan is built.
    """
    if not conditions:
        return df.withColumn("traffic_filter_name", F.lit(None).cast("string"))
    spark, plain = df.sparkSession, df.columns
    addresses.register(spark)
    for name, (parameters, result, body) in (functions or {}).items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    # The expressions see nothing but the fields; the event's columns stand beside them under names that none has.
    view = {f: F.coalesce(F.col(f).cast("string"), F.lit("<nil>")) if f in plain else F.lit("") for f in fields}
    seen = df.select(*[F.col(f"`{c}`").alias(f"__event_{i}") for i, c in enumerate(plain)], *[c.alias(f) for f, c in view.items()])
    drop, allow, tags = F.lit(False), None, []
    with nulls_for_errors(spark):
        for k, c in enumerate(conditions):
            seen = seen.withColumn(f"__hit_{k}", F.coalesce(F.expr(as_numbers(c.expression)).try_cast("boolean"), F.lit(False)))
            check_patterns(seen)
    for k, c in enumerate(conditions):
        matched = F.col(f"__hit_{k}")
        if c.test_mode:
            tags.append(F.when(matched, F.lit(c.name)))
        elif c.kind == "exclude":
            drop |= matched
        else:
            allow = matched if allow is None else allow | matched
    name = F.coalesce(*reversed(tags)) if tags else F.lit(None).cast("string")
    kept = seen.where(~drop & (F.lit(True) if allow is None else allow))
    return kept.select(*[F.col(f"__event_{i}").alias(c) for i, c in enumerate(plain)], name.alias("traffic_filter_name"))
