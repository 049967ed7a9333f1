"""Quality rules with adaptive thresholds.

Each document's whole text gives counts (words, symbols, marks, repeated lines and word windows). Thresholds are not
fixed: for every language and source a mergeable quantile sketch of each ratio is built (counts of logarithmic
buckets, so sketches merge by adding and quantiles have a bounded relative error) over the documents that pass the base rules.
A quartile is known to lie within its bucket: the upper one is taken at the bucket's upper edge, the lower one at its lower edge, so a
document that equals its group's quartile is never outside it. A document fails where a ratio lies more than RANGES quartile ranges outside its group's quartiles. The thresholds are
joined back and filter. There is no least distance: a ratio that most documents have at 0 (SOMETIMES) has its
sketch over the documents that have it at all.

Quartiles of a group of n documents are drawn towards the quartiles of its language, and those towards the quartiles of
all documents, with the weights n and PRIOR, so there is no size at which a rule changes.

Null text: no words, so base_failed. Null language or source: a group of its own. A group without a document in a sketch has
its language's quartiles, or those of all; where no document has the ratio, it has no threshold.
Repeated rows are judged each for themselves. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, table

COUNTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long", "n_marks": "long"}
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
#: All but marks: ASCII characters of words that are no letters.
_NOT_MARKS = bytes(b for b in range(256) if b >= 128 or b in b" \t\n\v\f\r" or chr(b).isalpha())
#: Relative width of a sketch's buckets, and the value that separates buckets of small ratios.
GAMMA, UNIT = 1.01, 0.01
#: ratio -> its counts
RATIOS = {
    "symbols_a_word": ("n_symbols", "n_words"), "marks_a_char": ("n_marks", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "chars_a_word": ("word_chars", "n_words"),
}
#: Ratios with a lower threshold too, and ratios that most documents have at 0.
BOTH_SIDES, SOMETIMES = ("chars_a_word",), ("symbols_a_word", "dup_line_share", "repeat_share")
#: Quartile ranges outside the quartiles that are allowed, and the documents that a wider group's quartiles count for.
RANGES, PRIOR = 6.0, 100.0


def text_counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: cuts at blanks and \t to \r, nothing else
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n >= 4:
        numbers: dict[bytes, int] = {}
        counter = count()
        ids = np.array([numbers.get(w) if w in numbers else numbers.setdefault(w, next(counter)) for w in words], dtype=np.int64)
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        hit = times[which] > 1
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[i : n - 2 + i] |= hit
        repeated = int(covered.sum())
    return n, chars, symbols, dup_lines, repeated, len(lines), len(data.translate(None, _NOT_MARKS))


def count_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Append COUNTS of each whole text."""
    return map_rows(df, [text], COUNTS, lambda: (lambda texts: list(zip(*map(text_counts, texts))) if texts else [[]] * len(COUNTS)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(c) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0)) for k, (c, of) in RATIOS.items()})


def bucket(x: Column) -> Column:
    return F.round(F.log1p(x / UNIT) / math.log(GAMMA)).cast("int")


def edge(b: Column, side: int) -> Column:
    """The value at the lower (-1) or upper (1) edge of a bucket, and a little beyond, since logarithms are rounded."""
    return F.greatest(F.lit(0.0), (F.pow(F.lit(GAMMA), b + side * (0.5 + 1e-6)) - 1) * UNIT)


def sketches(rated: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: the mergeable sketches, from all documents that pass the base rules."""
    points = F.array(*[F.when(F.lit(k not in SOMETIMES) | (F.col(k) > 0), F.struct(F.lit(k).alias("ratio"), bucket(F.col(k)).alias("bucket"))) for k in RATIOS])
    held = rated.where(~base_failed()).select("lang", "source", F.explode(F.array_compact(points)).alias("p"))
    return held.groupBy("lang", "source", "p.ratio", "p.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches to the groups of `by`; n, q1 and q3 of each group and ratio."""
    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    every = Window.partitionBy(*by, "ratio")
    upto = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(every))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bucket")))
    return ranked.groupBy(*by, "ratio").agg(F.max("total").alias("n"), edge(at(0.25), -1).alias("q1"), edge(at(0.75), 1).alias("q3"))


def of_group(sketch: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """A row for each group of `by`; <prefix><ratio> is a struct of n, q1 and q3."""
    q = quartiles(sketch, by)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("ratio") == k, F.struct("n", "q1", "q3"))).alias(prefix + k) for k in RATIOS])


def drawn(own: Column, wide: Column) -> Column:
    """q1 and q3 of a group, drawn towards those of a wider one."""
    mean = lambda f: (own["n"] * own[f] + PRIOR * wide[f]) / (own["n"] + PRIOR)
    both = F.struct(mean("q1").alias("q1"), mean("q3").alias("q3"))
    plain = lambda c: F.struct(c["q1"].alias("q1"), c["q3"].alias("q3"))
    return F.when(own.isNull(), plain(wide)).when(wide.isNull(), plain(own)).otherwise(both)


def thresholds(rated: DataFrame) -> DataFrame:
    """t_lang, t_source and for each ratio the highest (<ratio>_max) and, of BOTH_SIDES, lowest value (<ratio>_min) that passes."""
    sketch = materialize(sketches(rated))
    every = of_group(sketch.withColumn("one", F.lit(1)), ["one"], "a_").collect()  # one row at most
    all_ = {k: every[0][f"a_{k}"] if every else None for k in RATIOS}
    top = {k: F.struct(*[F.lit(v[f]).alias(f) for f in ("n", "q1", "q3")]) if v else F.lit(None).cast("struct<n:bigint,q1:double,q3:double>") for k, v in all_.items()}
    groups = rated.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).distinct()
    own, wide = of_group(sketch, ["lang", "source"], "o_"), of_group(sketch, ["lang"], "w_").withColumnRenamed("lang", "w_lang")
    joined = groups.join(own, F.col("t_lang").eqNullSafe(F.col("lang")) & F.col("t_source").eqNullSafe(F.col("source")), "left").join(wide, F.col("t_lang").eqNullSafe(F.col("w_lang")), "left")
    out = []
    for k in RATIOS:
        q = drawn(F.col(f"o_{k}"), drawn(F.col(f"w_{k}"), top[k]))
        far = (q["q3"] - q["q1"]) * RANGES
        out.append((q["q3"] + far).alias(f"{k}_max"))
        if k in BOTH_SIDES:
            out.append((q["q1"] - far).alias(f"{k}_min"))
    return joined.select("t_lang", "t_source", *out)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, kept and the ratios, a row for each document."""
    counted = materialize(count_texts(df.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))).drop("text"))
    rated = ratios(counted)
    limits = materialize(thresholds(rated))
    few = limits.limit(20_001).count() <= 20_000
    joined = rated.join(F.broadcast(limits) if few else limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    passes = F.lit(True)
    for k in RATIOS:
        passes &= F.coalesce(F.col(k) <= F.col(f"{k}_max"), F.lit(True))
    for k in BOTH_SIDES:
        passes &= F.coalesce(F.col(k) >= F.col(f"{k}_min"), F.lit(True))
    return joined.select("doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & passes).alias("kept"), *RATIOS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("lang", "source")


QUERIES = {"op6_quality_rules": op6_quality_rules}
