"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, connected components.

Shingles are runs of five words (letters, digits and non-ASCII, lower-cased); a text of fewer words is one
shingle. Each shingle is a Poisson process of arrivals at the signature's registers, with the shingle's weight as its
rate; a register keeps its earliest arrival, and a shingle stops once its next arrival is later than all of them
(early termination). Two registers agree with the probability-Jaccard similarity of the weighted sets.

A link is defined by the plain sets, whose similarity the weighted one undercuts where shingles repeat. So a text with repeated
shingles gets a second signature, of weights 1, and the bands of both: two texts of set similarity 0.8 share none of 32 bands of
6 registers with probability 6e-5, however often their shingles repeat. Without repeats the two signatures are the same.

Texts with the same word sequence are one node from the start. Bands of registers put nodes in buckets. From large buckets
those nodes go that can have no link there: too many of their shingles stand in no other node of a large bucket. In each
bucket all are compared with the node whose shingles most others hold, which needs no pairs within the bucket;
links are verified exactly (Jaccard of the shingle sets >= threshold), and components formed. Then, in buckets that still
hold more than one component, every pair across components that lengths allow is verified too, so no link
between different components is lost; pairs within one component would change nothing.

Buckets, nodes and classes that hold many rows are shared among tasks at every join. Signatures weigh shingles by their number;
links are defined, and verified, by the plain Jaccard similarity of the sets.

Result: a row for each document with class_id, the least doc_id of its class. Null and empty texts have no shingle
and are classes of their own row (class_id = doc_id). Null ids: class_id is the least non-null id, null if there is
none. Nodes and shingles are 64- and 32-bit hashes. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, discard, hot_keys, join_spread, map_rows, materialize, mix, table

BANDS, ROWS = 32, 6
WORDS, THRESHOLD = 5, 0.8
#: Nodes of a bucket above which those without a chance of a link are taken out of it first.
LARGE = 4
#: Parts by which the shingles of such nodes are counted, to bound what two of them have in common.
PARTS = 32
#: Row numbers of a bounded table: up to so many are broadcast, and the rows that they name stay where they are.
FEW_ROWS = 1 << 21
_SEPARATE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PRIME = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def shingles_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes and their counts, of a row of word hashes."""
    size = max(1, len(codes) - WORDS + 1) if len(codes) else 0
    if not size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rolled = np.zeros(size, dtype=np.uint64)
    for i in range(min(WORDS, len(codes))):
        rolled = rolled * _PRIME + mix(codes[i : i + size])
    return np.unique(mix(rolled), return_counts=True)


def probminhash(items: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The item that each register keeps. Arrivals are drawn in blocks, for as long as an item can still win."""
    time, kept = np.full(registers, np.inf), np.zeros(registers, dtype=np.uint64)
    left, rate, now, drawn = items, weights.astype(np.float64), np.zeros(len(items)), 0
    while len(left):
        block = max(1, -(-6 * registers // len(left)))
        steps = mix(left)[:, None] + np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
        bits = mix(steps)
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        at = now[:, None] + np.cumsum(gaps, axis=1) / rate[:, None]
        useful = at < time.max()
        when, where = at[useful], (mix(bits[useful]) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, where, when)
        won = time[where] == when
        kept[where[won]] = np.broadcast_to(left[:, None], at.shape)[useful][won]
        drawn, now = drawn + block, at[:, -1]
        on = now < time.max()
        left, rate, now = left[on], rate[on], now[on]
    return kept


class Signer:
    """Of a text: node, number of shingles, band keys, shingles."""

    def __init__(self, bands: int, rows: int, weighted: bool):
        self.bands, self.rows, self.weighted = bands, rows, weighted
        self.code = WordCache(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> tuple:
        words = words_of(text)
        if not words:
            return None, 0, [], []
        codes = np.fromiter(map(self.code.__getitem__, words), dtype=np.uint64, count=len(words))
        items, counts = shingles_of(codes)
        keys = self.keys(items, np.ones(len(items)))
        if self.weighted and counts.max() > 1:
            keys = np.unique(np.concatenate([keys, self.keys(items, 1.0 + np.log(counts))]))
        node = xxhash.xxh3_64_intdigest(b" ".join(words))
        small = np.unique((items >> np.uint64(32)).astype(np.uint32)).view(np.int32)
        return node - (1 << 64) * (node >> 63), len(small), keys.view(np.int64), small

    def keys(self, items: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A key of each band."""
        kept = probminhash(items, weights, self.bands * self.rows).reshape(self.bands, self.rows)
        keys = mix(np.arange(self.bands, dtype=np.uint64))
        for i in range(self.rows):
            keys = mix(keys * _PRIME + kept[:, i])
        return keys


SIGNED = {"node": "long", "n": "int", "bands": "array<long>", "shingles": "array<int>"}


def sign(df: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    def factory():
        one = Signer(bands, rows, weighted)
        return lambda texts: list(zip(*map(one, texts))) if texts else [[]] * 4

    return map_rows(df, [text], SIGNED, factory)


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node connected with it) for links (a, b): labels spread to neighbours, then jump to
    their label's label, until nothing changes (a label can only fall, so that ends). Hubs and common labels are shared among tasks."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    hubs = materialize(hot_keys(both, "b", both.count()))
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    n = label.count()
    while True:
        near = join_spread(both, label.select(F.col("node").alias("b"), "comp"), "b", "a", hubs).groupBy("a").agg(F.min("comp").alias("near"))
        spread = label.select("node", "comp").join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        spread = materialize(spread)
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        common = materialize(hot_keys(spread, "comp", n))
        new = materialize(join_spread(spread, up, "comp", "node", common, "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        settled = new.where("was <> comp").isEmpty()
        discard(spread, label, common)
        label = new
        if settled:
            discard(both, hubs)
            return label


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b), a materialized table, whose shingle sets have at least this Jaccard similarity; materialized. A node of many
    pairs is shared among tasks."""
    n = pairs.count()
    many_a, many_b = (materialize(hot_keys(pairs, side, n)) for side in ("a", "b"))
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    joined = join_spread(pairs, left, "a", "b", many_a)
    joined = join_spread(joined, right, "b", "a", many_b).where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    common = F.size(F.array_intersect("sa", "sb"))
    found = materialize(joined.where(common >= threshold * (F.col("na") + F.col("nb") - common)).select("a", "b"))
    discard(many_a, many_b)
    return found


def linkable(sets: DataFrame, threshold: float) -> DataFrame:
    """node, shared, holders, parts: those that can have a link within these sets, how many of their shingles others hold
    too, by how many nodes these are held, and shared by the shingles' remainder modulo PARTS.

    A link needs that to be at least the threshold of all, so what is left out has none.
    """
    held = sets.select("node", "n", F.explode("shingles").alias("s"))
    common = materialize(held.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"))
    hot = materialize(hot_keys(common, "s", sets.agg(F.sum("n")).collect()[0][0] or 0, F.col("c")))
    part = join_spread(held, common, "s", "node", hot).groupBy("node").agg(
        F.count("*").alias("shared"), F.sum("c").alias("holders"), F.max("n").alias("n"),
        F.array(*[F.count_if(F.pmod("s", F.lit(PARTS)) == i).cast("short") for i in range(PARTS)]).alias("parts"),
    )
    found = materialize(part.where(F.col("shared") >= F.col("n") * threshold).drop("n"))
    discard(common, hot)
    return found


def rows_named(wide: DataFrame, named: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """Those rows of wide whose __row is among named (a materialized table). Texts' shingles are about as large as the texts: they are shuffled
    for that only where more than `few` rows are named."""
    return wide.join(F.broadcast(named) if named.count() <= few else named, "__row", "left_semi")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_id and the columns `carry` for every row."""
    threshold -= 1e-9  # a similarity that equals the threshold counts, whatever its last bit
    signed = materialize(sign(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *carry), "text", bands, rows, weighted).drop("text").withColumn("__row", F.monotonically_increasing_id()))
    with_words = signed.where("node is not null")
    # One row stands for each node: that with the least id (null ids last). It is found by its own number, so rows of one id are no hot key.
    rank = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank")
    first = with_words.groupBy("node").agg(F.min(F.struct(rank, "__row")).alias("o"))
    owners = materialize(first.select("node", "o.rank", "o.__row"))
    banded = with_words.join(owners.select("__row"), "__row", "left_semi").select("node", "bands")
    in_bucket = materialize(banded.select("node", F.explode("bands").alias("bucket")))
    n_held = in_bucket.count()
    shared = materialize(in_bucket.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1"))
    hot = materialize(hot_keys(shared, "bucket", n_held, F.col("held"), steady=True))
    members = materialize(join_spread(in_bucket, shared, "bucket", "node", hot))
    discard(in_bucket)
    involved = materialize(members.select("node").distinct().join(owners, "node").select("__row"))
    sets = materialize(rows_named(with_words.select("__row", "node", "n", "shingles"), involved).drop("__row"))

    # Large buckets: a node whose shingles are mostly its own there can have no link there.
    likely = linkable(sets.join(members.where(F.col("held") > LARGE).select("node").distinct(), "node"), threshold)
    sized = materialize(members.join(sets.select("node", "n"), "node"))
    discard(members)
    large = sized.where(F.col("held") > LARGE).join(likely, "node")
    least_n = large.groupBy("bucket").agg(F.min("n").alias("least_n"))
    # In common at most `shared`; the other has as many shingles as the bucket's smallest at least.
    large = join_spread(large, least_n, "bucket", "node", hot).where(F.col("shared") * (1 + threshold) >= threshold * (F.col("n") + F.col("least_n")))
    small = sized.where(F.col("held") <= LARGE).withColumns({"shared": F.col("n").cast("long"), "holders": F.lit(0).cast("long"), "parts": F.lit(None).cast("array<smallint>")})
    members = materialize(small.unionByName(large.drop("least_n")).select("bucket", "node", "n", "shared", "holders", "parts"))
    discard(sized, likely)

    # Each bucket's node whose shingles most others hold is compared with the others.
    middle = members.groupBy("bucket").agg(F.max(F.struct("holders", -F.col("node"), "node"))["node"].alias("middle"))
    tried = join_spread(members, middle, "bucket", "node", hot).where("middle <> node").select(F.least("middle", "node").alias("a"), F.greatest("middle", "node").alias("b")).distinct()
    tried = materialize(tried)
    links = verify(tried, sets, threshold)
    comps = components(links)

    # Buckets that still hold several components.
    labelled = materialize(members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket")
    rest = materialize(join_spread(labelled, mixed, "bucket", "node", hot))
    x = rest.select("bucket", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("parts").alias("px"))
    y = rest.select("bucket", F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("parts").alias("py"))
    # Two nodes have at most the lesser count of each part in common.
    most = F.coalesce(F.aggregate(F.zip_with("px", "py", lambda p, q: F.least(p, q).cast("int")), F.lit(0), lambda t, v: t + v), F.least("nx", "ny"))
    crowded = materialize(hot_keys(rest, "bucket", rest.count()))
    across = join_spread(x, y, "bucket", "x", crowded).where((F.col("cx") < F.col("cy")) & (F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold) & (most * (1 + threshold) >= threshold * (F.col("nx") + F.col("ny"))))
    # Verifying reads the pairs four times: written once, they are made once, and no plan holds this join four times.
    across = materialize(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    more = verify(across, sets, threshold)
    if not more.isEmpty():
        old, comps = comps, components(links.union(more))
        discard(old)
    discard(sets, involved, members, tried, links, labelled, rest, crowded, across, more, hot)

    named = materialize(owners.join(comps.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    least = named.groupBy("comp").agg(F.min("rank").alias("class_rank"))
    large_classes = materialize(hot_keys(named, "comp", owners.count()))
    classes = join_spread(named, least, "comp", "node", large_classes).select("node", F.nullif("class_rank", F.lit((1 << 63) - 1)).alias("class_id"))
    # What the result is read from: ids and nodes alone, so that signatures and shingles need not stay on disk.
    classes, docs = materialize(classes), materialize(signed.select("doc_id", "node", "__row", *carry))
    discard(signed, owners, comps, shared, named, large_classes)
    copies = materialize(hot_keys(docs.where("node is not null"), "node", docs.count()))
    return join_spread(docs, classes, "node", "__row", copies, "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), *carry)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_duplicates": op8_near_duplicates}
