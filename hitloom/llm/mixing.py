"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets. Every source gets a share of the demand by its weight, but never more than `repeat` times its size;
what lies above is shared anew by weight among the others. That fixed point is target = min(cap, level x weight)
for one level, found from the sources sorted by cap / weight.

Curriculum. Over training time t in [0, 1] a source's weight follows the line 1 + slope (2t - 1). Its integral,
times the target, is the source's cumulative demand, target (t + slope (t^2 - t)); a document's place in its
source's stream of words is a point of that demand, and inverting the integral gives the document's position.

The stream of a source is its documents in hash order, again and again; the last one is taken in part, so that the
words taken are the target rounded down. Prefix sums run over hash ranges of a source, so that a hot source spreads:
sizes of spans of SPAN ranges first, then of ranges within a span, then within ranges; no task sums more than a source's spans,
which are its documents divided by RANGE_ROWS x SPAN. A row for each source is what the targets are found from.

Null text has size 0. Null source is a source of its own and the last. Documents of size 0 are taken 0 times and
have no position. Repeated rows are documents of their own, one after the other; they are one row with a number until the end.
Carried columns may have any names; one with a name of the result's is left out. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (-0.5, 0.0, 0.5)
#: Documents of one source that a prefix sum takes at once, on average.
RANGE_ROWS = 500
#: Ranges that the second prefix sum takes at once.
SPAN = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, repeat: float = 2.0, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """source, source_size, target, slope from rows (source, n_docs, source_size); a row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    one = sizes.withColumn("n", nth).select(
        "source", "n_docs", "source_size",
        F.get(F.array(*map(F.lit, weights)), F.col("n")).alias("weight"),
        F.get(F.array(*map(F.lit, slopes)), F.pmod(F.col("n"), F.lit(len(slopes)))).alias("slope"),
    )
    full = one.withColumn("cap", F.col("source_size") * repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("demand", F.sum("source_size").over(every) * share)
    full = full.withColumn("level", (F.col("demand") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # The first source that the level does not fill decides; before it all are full.
    full = full.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return full.select("source", "n_docs", "source_size", "slope", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


#: What mix_sources gives; a carried column of one of these names is left out.
OUT = ("doc_id", "source", "size", "source_size", "target", "taken", "position", "second_position")


def mix_sources(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """OUT and the columns `carry` (but those of OUT's names): the mix, a row for each document.

    position (0 to 1) is the training position of the document's first use, second_position of its second. All columns that
    the work itself needs have names that start with two underscores.
    """
    carry = tuple(c for c in carry if c.lower() not in OUT)
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    own = [named(key).alias("__id"), named(source).alias("__source"), n_words(named(text)).alias("__size")]
    whole = [named(c) for c in (key, text, source, *carry)]
    rows = df.select(*own, F.xxhash64(*whole[:2]).alias("__h"), F.xxhash64(F.lit(1), *whole).alias("__g"), *[named(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    carried = [f"__c{i}" for i in range(len(carry))]
    # Equal rows (by 128 bits of hash) are one, with their number, so they are no hot range.
    alike = ["__h", "__g", "__source", "__id", "__size"]
    sized = materialize(rows.groupBy(*alike).agg(F.count("*").alias("__n")))
    size_of = F.sum(F.col("__size") * F.col("__n"))
    totals = sized.groupBy(F.col("__source").alias("source")).agg(F.sum("__n").alias("n_docs"), size_of.alias("source_size"))
    found = materialize(source_targets(totals, **options))
    sources = found.select(*[F.col(c).alias(f"__s_{c}") for c in found.columns])
    # Ranges of the hash: a source has about n_docs / RANGE_ROWS of them.
    place = (F.shiftrightunsigned(F.col("__h"), 33).cast("double") / float(1 << 31) * F.ceil(F.col("__s_n_docs") / RANGE_ROWS)).cast("long")
    ranged = sized.join(F.broadcast(sources) if few(sources) else sources, F.col("__source").eqNullSafe(F.col("__s_source"))).withColumn("__range", place)
    ranges = ranged.groupBy("__source", "__range").agg(size_of.alias("__range_size"))
    ranges = materialize(ranges.select(F.col("__source").alias("__rs"), F.col("__range").alias("__r"), "__range_size", F.floor(F.col("__range") / SPAN).alias("__span")))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    spans = ranges.groupBy(F.col("__rs").alias("__z"), F.col("__span").alias("__p")).agg(F.sum("__range_size").alias("__span_size"))
    spans = spans.select("__z", "__p", F.coalesce(F.sum("__span_size").over(upto("__z").orderBy("__p")), F.lit(0)).alias("__span_start"))
    starts = ranges.join(spans, F.col("__rs").eqNullSafe(F.col("__z")) & (F.col("__span") == F.col("__p")))
    range_start = F.col("__span_start") + F.coalesce(F.sum("__range_size").over(upto("__rs", "__span").orderBy("__r")), F.lit(0))
    starts = materialize(starts.select("__rs", "__r", range_start.alias("__range_start")))
    within = upto("__source", "__range").orderBy("__h", "__g")
    local = ranged.withColumn("__local", F.coalesce(size_of.over(within), F.lit(0)))
    placed = local.join(starts, F.col("__source").eqNullSafe(F.col("__rs")) & (F.col("__range") == F.col("__r"))).withColumn("__start", F.col("__range_start") + F.col("__local"))
    placed = placed.select(*alike, "__n", "__start", *[c for c in sources.columns if c != "__s_source"])
    if carry:  # one row of each group of equal ones brings what is carried
        alone = rows.groupBy("__h", "__g").agg(*[F.first(c).alias(c) for c in carried])
        placed = alone.join(materialize(placed), ["__h", "__g"])
    each = placed.withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    start, size, total, target = F.col("__start") + F.col("__nth") * F.col("__size"), F.col("__size"), F.col("__s_source_size"), F.col("__s_target")
    goal = F.floor(target)

    def part(goal: Column) -> Column:
        return F.greatest(F.lit(0), F.least(size, goal - start))

    def position(at: Column) -> Column:
        """t with t + slope (t^2 - t) = at / target."""
        u, a = at / target, F.col("__s_slope")
        root = F.sqrt(F.greatest(F.lit(0.0), (1 - a) * (1 - a) + 4 * a * u))
        return F.when(a == 0, u).otherwise(2 * u / (1 - a + root))

    first, second = part(goal), part(goal - total)
    return each.select(
        F.col("__id").alias("doc_id"), F.col("__source").alias("source"), size.alias("size"), total.alias("source_size"), target.alias("target"),
        (first + second).alias("taken"),
        F.when(first > 0, position(start)).alias("position"),
        F.when(second > 0, position(start + total)).alias("second_position"),
        *[F.col(made).alias(c) for made, c in zip(carried, carry)],
    )


def few(sources: DataFrame, limit: int = 10_000) -> bool:
    """Is a row for each source small enough to broadcast?"""
    return sources.limit(limit + 1).count() <= limit


def training_order(mixed: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each use of a document, range-sorted by position."""
    uses = F.filter(F.array("position", "second_position"), lambda p: p.isNotNull())
    return mixed.select("doc_id", "source", *carry, F.posexplode(uses).alias("use", "position")).orderBy("position", F.col("source").asc_nulls_last(), "doc_id", "use")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.drop("source").orderBy(F.col("position").asc_nulls_last(), "doc_id")


QUERIES = {"op9_mix_sources": op9_mix_sources}
