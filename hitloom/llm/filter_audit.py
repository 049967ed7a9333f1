"""Filter interaction audit by inclusion-exclusion.

Five filters judge each whole text. A document's failures are five flags, and for each of the 32 sets of filters the documents
are counted that fail all of them: the sum of the product of the set's flags. These joint counts hold all that any order of
filters does. With J(S) the count of set S,

    kept after the filters T       sum over S within T of (-1)^|S| J(S)           (Moebius inversion)
    fails x and nothing else       sum over S that hold x of (-1)^(|S|-1) J(S)
    removed by x after T           kept(T) - kept(T + x);  redundant: J({x}) less that
    dividend of S (Harsanyi)       (-1)^(|S|-1) J(S), what S adds to the documents removed beyond its parts
    Shapley value of x             sum over S that hold x of dividend(S) / |S|; 120 times that is x's removed over all orders

Flags are made where the text is; only ids, flags and a 128-bit hash of the text travel. A text's copies meet by that hash, and
counts by source, flags and labels are partial before they are shuffled; ids, copies and labels that hold many rows are shared among tasks.

Null text: as an empty one, so a copy of it. Null source: the empty string. Null doc_id: no label, and after all other ids
for E, so of such copies among themselves none fails. Rows of one id and text: none is smaller, none fails E by the other. Of
repeated labels of one id the largest count. Columns but doc_id, text and source are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hot_keys, join_spread, map_rows, materialize, table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
_NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_SIGNS = bytes(b for b in range(256) if b not in b"#$%&*|")
_LAST = (1 << 63) - 1


def failures(text: str | None) -> tuple[int, bytes]:
    """Flags of the filters A to D (bit 0: A), and the text's hash."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: cuts at blanks and \t to \r, nothing else
    flags = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * len(data.translate(None, _NOT_CAPITALS)) > CAPITALS_PERCENT * len(text or ""),
        bool(data.translate(None, _NOT_SIGNS)),
    )
    return sum(on << i for i, on in enumerate(flags)), xxhash.xxh3_128_digest(data)


def flag(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, flags (bit 0: A fails, to bit 4: E) of each row, and __row; what is returned is a table of its own."""
    small = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    judged = map_rows(small, ["text"], {"__flags": "int", "__hash": "binary"}, lambda: lambda texts: list(zip(*map(failures, texts))) if texts else [[], []])
    rows = materialize(judged.select("doc_id", "source", "__flags", "__hash", F.monotonically_increasing_id().alias("__row")))
    n = rows.count()
    rank = F.coalesce("doc_id", F.lit(_LAST))
    copies = materialize(rows.groupBy("__hash").agg(F.min(rank).alias("__least"), F.count("*").alias("__n")).where("__n > 1"))
    found = join_spread(rows, copies, "__hash", "__row", hot_keys(copies, "__hash", n, F.col("__n")), "left")
    copy = F.when(rank > F.col("__least"), COPY).otherwise(0)
    flagged = materialize(found.select("doc_id", "source", (F.col("__flags") + copy).alias("flags"), "__row"))
    discard(rows, copies)
    return flagged


def joint_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, set (bits of its filters), n, good, toxic: of each part, how many documents fail all filters of the set."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    hot = hot_keys(flagged.where("doc_id is not null"), "doc_id", flagged.count())
    with_id, without = flagged.where("doc_id is not null"), flagged.where("doc_id is null")
    every = join_spread(with_id, known, "doc_id", "__row", hot, "left").select("source", "flags", "good", "toxic").unionByName(without.select("source", "flags"), allowMissingColumns=True)
    one = F.lit(1).cast("long")
    patterns = every.groupBy("source", "flags").agg(F.sum(one).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # A set's flag product is 1 where the document fails all of its filters.
    sets = patterns.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(SETS - 1))))
    product = (F.col("flags").bitwiseAND(F.col("set")) == F.col("set")).cast("long")
    return sets.groupBy(F.col("source").alias("part"), "set").agg(*[F.sum(F.col(c) * product).alias(c) for c in ("n", "good", "toxic")])


_SIZE = np.array([bin(s).count("1") for s in range(SETS)])
_SIGN = (-1) ** _SIZE
#: A row for each set of filters T: the signs of the sets within T.
_WITHIN = np.array([[_SIGN[s] if s & t == s else 0 for s in range(SETS)] for t in range(SETS)], dtype=np.int64)
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def walk(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """The rows of one part from its 32 joint counts of all, good and toxic documents."""
    kept, kept_good, kept_toxic = (_WITHIN @ j for j in (n, good, toxic))
    holds = [np.array([bool(s >> i & 1) for s in range(SETS)]) for i in range(len(FILTERS))]
    dividends = -_SIGN * n
    unique = [int(dividends[h].sum()) for h in holds]
    shapley = [int((dividends[h] * (len(_ORDERS) // _SIZE[h])).sum()) for h in holds]
    out = []
    for order in _ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            x = FILTERS.index(letter)
            after = before | 1 << x
            removed = int(kept[before] - kept[after])
            out.append((order, step, int(kept[after]), removed, int(n[1 << x]) - removed, unique[x], int(kept_good[before] - kept_good[after]), int(kept_toxic[before] - kept_toxic[after]), shapley[x]))
            before = after
    return out


COLUMNS = {"part": "string", "filter_order": "string", "step": "int", "kept": "long", "removed": "long", "redundant": "long", "unique_fails": "long", "good_lost": "long", "toxic_lost": "long", "shapley": "long"}


def audit(joint: DataFrame) -> DataFrame:
    """COLUMNS: for each part, order of the filters and step. A part is one row of 32 counts; parts are spread over tasks."""
    cells = F.sort_array(F.collect_list(F.struct("set", "n", "good", "toxic")))  # 32 of a part
    parts = joint.groupBy("part").agg(cells.alias("cells")).select("part", *[F.col(f"cells.{c}").alias(c) for c in ("n", "good", "toxic")])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, *counts in batch.itertuples(index=False):
                made = pd.DataFrame(walk(*(np.asarray(c, dtype=np.int64) for c in counts)), columns=list(COLUMNS)[1:])
                made.insert(0, "part", part)
                yield made

    return parts.mapInPandas(rows, ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items()))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(joint_counts(flag(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


#: Every order is walked through document by document.
SQL = r"""
with d as (select doc_id, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (
  select w.source as part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
    len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d,
    coalesce(w.doc_id > min(w.doc_id) over (partition by text), false) as e
  from w left join l on w.doc_id = l.doc_id
),
fails as (select *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: case x when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end) as failed from f),
v as (select unnest(['A', 'B', 'C', 'D', 'E']) as v),
orders as (
  select p.v || q.v || r.v || s.v || t.v as filter_order from v p, v q, v r, v s, v t
  where len(list_distinct([p.v, q.v, r.v, s.v, t.v])) = 5
),
steps as (select filter_order, step, substr(filter_order, step, 1) as x, substr(filter_order, 1, step - 1) as before from orders, range(1, 6) t(step)),
cells as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by part, failed),
walked as (
  select part, filter_order, cast(step as int) as step, x,
    cast(sum(case when len(list_filter(failed, lambda y: contains(before || x, y))) = 0 then n else 0 end) as bigint) as kept,
    cast(sum(case when list_contains(failed, x) and len(list_filter(failed, lambda y: contains(before, y))) = 0 then n else 0 end) as bigint) as removed,
    cast(sum(case when list_contains(failed, x) and len(list_filter(failed, lambda y: contains(before, y))) > 0 then n else 0 end) as bigint) as redundant,
    cast(sum(case when failed = [x] then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when list_contains(failed, x) and len(list_filter(failed, lambda y: contains(before, y))) = 0 then good else 0 end) as bigint) as good_lost,
    cast(sum(case when list_contains(failed, x) and len(list_filter(failed, lambda y: contains(before, y))) = 0 then toxic else 0 end) as bigint) as toxic_lost
  from cells, steps group by part, filter_order, step, x
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, x) as bigint) as shapley
from walked
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE = {"op13_filter_audit": SQL}
