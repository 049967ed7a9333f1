"""Source divergence audit by joint count histograms.

Of each language, the terms in at least LEAST_DOCS of its documents are kept. A group (language, source) gives each of the V kept
terms the smoothed probability p = 1 + floor(SCALE (count + 1) / (N + V)), N being its occurrences of kept terms; the language
as a whole does likewise. What term t adds to the divergence of p from q is f(p, q) = floor((p - q)^2 / q), in whole numbers.

Pairs. p and q depend on nothing but a term's count in either source, so the sum over the V terms is a sum over the distinct
combinations (count here, count there) of f times the number of terms that have it. Terms that both sources hold are tallied
within each task, from the list of a term's sources, and the tallies added; combinations with a zero follow from each source's
own histogram less the joint one, and (0, 0) from V. f is evaluated once for each combination, and no term is listed with each pair.

Terms. For each group, the terms it uses more than its language does, by f, the first TOP_TERMS of them.

Null text, language and source: empty strings. Groups without terms are groups like others, with p = 1 + floor(SCALE / V)
for every term; where a language keeps no term, its pairs have the value 0. Repeated rows count as often as they occur. Texts are
read whole; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Letters of ASCII in lower case and all else that isn't ASCII; other ASCII separates.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A task hands on what it has counted at so many entries, or so many pairs of counts.
MOST_ENTRIES, MOST_PAIRS = 400_000, 2_000_000
#: Parts that a hot group is cut into before its best terms are found.
DEALS = 64


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def term_counts(docs: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """lang, source, term, n, docs: counts of each task, not yet added up."""
    small = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    names = ["lang", "source", "term", "n", "docs"]

    def flush(times: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in times.items():
            there = held[lang, source]
            terms = list(counts)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                n = len(some)
                text = pa.array(some, type=pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), text, pa.array([counts[t] for t in some], pa.int64()), pa.array([there[t] for t in some], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, held, entries = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                terms, counts, there = terms_of(text), times[lang, source], held[lang, source]
                before = len(counts)
                counts.update(terms)
                there.update(set(terms))
                entries += len(counts) - before
                if entries > most:
                    yield from flush(times, held)
                    times.clear(), held.clear()
                    entries = 0
        yield from flush(times, held)

    return small.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, n, held: a row for each kept term; held has its sources that use it, with their counts."""
    by_source = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("held"))
    return by_term.where(F.col("docs") >= least).drop("docs")


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (count + 1) / (total + kept)) of three columns, in whole numbers."""
    return F.expr(f"1 + (cast(`{count}` + 1 as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))) div (`{total}` + `{kept}`)")


def term_value(p: str, q: str) -> Column:
    """f of two columns."""
    return F.expr(f"((`{p}` - `{q}`) * (`{p}` - `{q}`)) div `{q}`")


def joint_histogram(kept: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """lang, a, b (a < b), ca, cb, n: how many kept terms have these counts above 0 in the sources a and b."""
    names = ["lang", "a", "b", "ca", "cb", "n"]

    def flush(lang: str, numbers: dict[str, int], parts: list) -> Iterator[pa.RecordBatch]:
        sources = np.array(list(numbers), dtype=object)
        rank = np.empty(len(sources), dtype=np.int64)
        rank[np.argsort([s.encode("utf-8", "surrogatepass") for s in sources.tolist()] or [b""], kind="stable")[: len(sources)]] = np.arange(len(sources))
        a, b, ca, cb = (np.concatenate(x) for x in zip(*parts))
        turn = rank[a] > rank[b]
        a, b, ca, cb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, cb, ca), np.where(turn, ca, cb)
        order = np.lexsort((cb, ca, b, a))
        a, b, ca, cb = (x[order] for x in (a, b, ca, cb))
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])])
        n = np.diff(np.r_[new, len(a)])
        for at in range(0, len(new), 50_000):
            i = new[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array(sources[a[i]], pa.string()), pa.array(sources[b[i]], pa.string()), pa.array(ca[i]), pa.array(cb[i]), pa.array(n[at : at + 50_000])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, parts, pairs = defaultdict(dict), defaultdict(list), Counter()
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for lang_at, lang in enumerate(langs.dictionary.to_pylist()):
                held = batch.column(1).filter(pc.equal(langs.indices, lang_at))
                sizes = np.diff(held.offsets.to_numpy())
                found = held.flatten()
                named, own = found.field(0).dictionary_encode(), found.field(1).to_numpy(zero_copy_only=False)
                known = numbers[lang]
                ids = np.array([known.setdefault(s, len(known)) for s in named.dictionary.to_pylist()], dtype=np.int64)[named.indices.to_numpy()]
                starts = np.cumsum(sizes) - sizes
                for k in np.unique(sizes).tolist():  # terms of k sources are the rows of a matrix
                    rows = starts[sizes == k]
                    for at in range(k - 1):
                        step = max(1, most // (k - 1))
                        for low in range(0, len(rows), step):
                            left = rows[low : low + step] + at
                            right = (left[:, None] + np.arange(1, k - at)).ravel()
                            left = np.repeat(left, k - 1 - at)
                            parts[lang].append((ids[left], ids[right], own[left], own[right]))
                            pairs[lang] += len(left)
                            if pairs[lang] > most:
                                yield from flush(lang, known, parts.pop(lang))
                                pairs[lang] = 0
        for lang, some in parts.items():
            yield from flush(lang, numbers[lang], some)

    local = kept.where("size(held) > 1").select("lang", "held").mapInArrow(run, "lang string, a string, b string, ca long, cb long, n long")
    return local.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n"))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the parts `pair` (other sources of the language) and `term` (its own terms)."""
    groups = materialize(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct())
    kept = materialize(kept_terms(docs, least))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    uses = kept.select("lang", "term", F.col("n").alias("lang_count"), F.inline("held")).withColumnRenamed("n", "count")
    histogram = materialize(uses.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")))
    sizes = histogram.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("total"), F.sum("terms").alias("used"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sized = materialize(groups.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").select("lang", "source", *map(zero, ("v", "lang_n", "total", "used"))))

    # Part `term`. A hot group's rows are dealt out, and the best of each part meet.
    p = uses.join(sized, ["lang", "source"]).withColumn("p", probability("count", "total", "v")).withColumn("q", probability("lang_count", "lang_n", "v"))
    terms = p.where("p > q").select("lang", "source", F.col("term").alias("item"), term_value("p", "q").alias("value"))
    best = [F.col("value").desc(), "item"]
    dealt = terms.withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(DEALS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "deal").orderBy(*best))).where(F.col("rank") <= top)
    terms = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).where(F.col("rank") <= top)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # Part `pair`. The cells of each pair a < b: those of terms in both, and what they take from the cells with a zero.
    joint = joint_histogram(kept)
    n, none = F.col("n"), F.lit(0).cast("long")
    cell = lambda ca, cb, n: F.struct(ca.alias("ca"), cb.alias("cb"), n.alias("n"))
    both = joint.select("lang", "a", "b", F.inline(F.array(cell(F.col("ca"), F.col("cb"), n), cell(F.col("ca"), none, -n), cell(none, F.col("cb"), -n), cell(none, none, n))))
    a, b = sized.select("lang", F.col("source").alias("a"), F.col("v"), F.col("used").alias("used_a")), sized.select("lang", F.col("source").alias("b"), F.col("used").alias("used_b"))
    pairs = a.join(b, "lang").where("a < b")  # one for each row of the result
    own_a = pairs.join(histogram.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("count").alias("ca"), none.alias("cb"), F.col("terms").alias("n"))
    own_b = pairs.join(histogram.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", none.alias("ca"), F.col("count").alias("cb"), F.col("terms").alias("n"))
    neither = pairs.select("lang", "a", "b", none.alias("ca"), none.alias("cb"), (F.col("v") - F.col("used_a") - F.col("used_b")).alias("n"))
    cells = both.unionByName(own_a).unionByName(own_b).unionByName(neither).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n")).where("n > 0")
    ends = sized.select("lang", F.col("source").alias("a"), "v", F.col("total").alias("na")), sized.select("lang", F.col("source").alias("b"), F.col("total").alias("nb"))
    cells = cells.join(ends[0], ["lang", "a"]).join(ends[1], ["lang", "b"]).withColumn("p", probability("ca", "na", "v")).withColumn("q", probability("cb", "nb", "v"))
    total = lambda x, y: F.sum(term_value(x, y).cast("decimal(38,0)") * n.cast("decimal(18,0)"))
    valued = cells.groupBy("lang", "a", "b").agg(total("p", "q").cast("long").alias("ab"), total("q", "p").cast("long").alias("ba"))
    ways = pairs.join(valued, ["lang", "a", "b"], "left").select("lang", F.inline(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.coalesce("ab", none).alias("value")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.coalesce("ba", none).alias("value")),
    )))
    pair = ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best)).alias("rank"))
    out = materialize(pair.unionByName(terms))
    discard(groups, kept, histogram, sized)
    return out


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


#: Every kept term with every pair of sources.
SQL = r"""
with d as (
  select row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
),
t as (select n, lang, source, unnest(terms) as term from d),
groups as (select distinct lang, source from d),
kept as (select lang, term, count(*) as lang_count from t group by lang, term having count(distinct n) >= 3),
v as (select lang, count(*) as v, sum(lang_count) as lang_n from kept group by lang),
uses as (select t.lang, t.source, t.term, count(*) as c from t join kept k on t.lang = k.lang and t.term = k.term group by all),
sizes as (select lang, source, sum(c) as total from uses group by all),
cells as (
  select g.lang, g.source, k.term, coalesce(u.c, 0) as c, k.lang_count, v.v, v.lang_n, coalesce(s.total, 0) as total
  from groups g join kept k on g.lang = k.lang join v on v.lang = g.lang left join sizes s on s.lang = g.lang and s.source = g.source
  left join uses u on u.lang = g.lang and u.source = g.source and u.term = k.term
),
ps as (
  select *, 1 + (1000000000::hugeint * (c + 1)) // (total + v)::hugeint as p, 1 + (1000000000::hugeint * (lang_count + 1)) // (lang_n + v)::hugeint as q
  from cells
),
sums as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value from ps x join ps y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (
    select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value, row_number() over (partition by lang, source order by (p - q) * (p - q) // q desc, term) as rank
    from ps where c > 0 and p > q
  ) where rank <= 200
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked
"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLE = {"op12_source_divergence": SQL}
