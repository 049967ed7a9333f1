"""Approximate nearest neighbours by cosine, with stable projections in few dimensions.

Unit vectors are projected on DIMS Gaussian directions: the squared projected distance of two vectors is their squared
distance times a chi-square variable. A kd-tree over the projections (splits from a bounded sample) cuts all rows
into cells. A query visits cells in the order of their boxes' distances: its own, which bounds its k-th distance; then the
NEAR_CELLS next, which tighten the bound; then all others that the chi-square test doesn't exclude. In a block of a
cell, candidates come in rings of growing projected distance and are verified on the vectors, until the test says that
what is left would, with probability SURE, have come before: P(chi2 <= projected distance^2 / k-th distance^2) >= SURE.

Cells are dealt out in blocks of bounded rows (by id), so copies of one vector spread. Each round sends every row once, and a
query once to each block that it visits.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no part. Vectors
of different lengths never meet; the LENGTHS most frequent lengths are searched by tree, rows of all others exactly. Rows
with the query's id are no candidates of it; other repeated rows are. Rows of one id with equal vectors are one query; each
different vector of an id is a query with k neighbours and ranks of its own. Scores are
computed in double precision, component by component, on the original vectors, so equal vectors tie exactly, and
ties go to the smaller id. Only the id and vector columns are read, whatever others are called. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

DIMS, SURE, K, EVERY = 8, 0.995, 5, 50
SAMPLE = 16_384
LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 512, 16_384, 256
#: Numbers that a block, or the tree's sample, holds at most (long vectors have smaller blocks).
BLOCK_FLOATS = 1 << 21
CELLS = 4096
#: Cells that a query visits after its own, before its bound is taken anew for all others.
NEAR_CELLS = 8
#: Ends of the rings of candidates, by number.
RINGS = (32, 128, 512, 2048, 8192)
#: Share of a block from which on a ring is verified by one matrix product; below it pair by pair, STEP pairs at a time.
DENSE, STEP = 0.1, 65_536
#: Vector lengths that get a tree each.
LENGTHS = 64


def directions(size: int) -> np.ndarray:
    return np.random.default_rng([size, 11]).standard_normal((size, DIMS))


def chi_square(x: np.ndarray) -> np.ndarray:
    """P(chi2 with DIMS degrees of freedom <= x), for even DIMS."""
    half = np.minimum(x / 2, 700.0)
    return 1.0 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(DIMS // 2))


class Tree:
    """A complete kd-tree over projections; cells are numbered from 0."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, n = depth, 1 << depth
        self.axis, self.split = np.zeros(n, dtype=np.int64), np.zeros(n)
        low, high = np.full((2 * n, DIMS), -np.inf), np.full((2 * n, DIMS), np.inf)
        held = {1: points}
        for node in range(1, n):
            own = held.pop(node)
            axis = int(np.argmax(own.var(0))) if len(own) else node % DIMS
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.split[node] = axis, cut
            left = own[:, axis] <= cut
            held[2 * node], held[2 * node + 1] = own[left], own[~left]
            for child in (2 * node, 2 * node + 1):
                low[child], high[child] = low[node], high[node]
            high[2 * node, axis] = low[2 * node + 1, axis] = cut
        self.low, self.high = low[n:], high[n:]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[rows, self.axis[node]] > self.split[node])
        return node - (1 << self.depth)

    def bounds(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a projected point from each cell's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        return (gap * gap).sum(1)


def cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Of pairs of rows, component by component, so that a pair's value doesn't depend on its place."""
    dot, norm, own = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
    for j in range(rows.shape[1]):
        x, y = rows[:, j], queries[:, j]
        dot += x * y
        norm += x * x
        own += y * y
    return dot / (np.sqrt(norm) * np.sqrt(own))


def unit(rows: np.ndarray) -> np.ndarray:
    big = np.abs(rows).max(1, keepdims=True)
    rows = rows / big
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


@functools.lru_cache(maxsize=1)
def reach() -> float:
    """The chi-square quantile at SURE."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid)) < SURE else (low, mid)
    return high


class Block:
    """Rows of a cell, ready for queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.units = ids, vectors, unit(vectors)
        self.project = directions(vectors.shape[1])
        self.points = self.units @ self.project
        self.square = (self.points * self.points).sum(1)

    def search(self, q_ids: np.ndarray, q_vectors: np.ndarray, q_bounds: np.ndarray, k: int, far: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query (its place in q_ids), vec_id and score of the k nearest for each query, of those within its known bound;
        and the number of pairs verified.

        q_bounds: a known k-th squared distance (of unit vectors). Candidates come in order of projected distance, in rings
        that grow by RINGS; a query stops before a ring whose projected distance the chi-square test excludes at the k-th
        distance known by then (far: the test's quantile; infinite to exclude none).
        """
        ids, far, n = self.ids, reach() if far is None else far, len(self.ids)
        q_units = unit(q_vectors)
        q_points = q_units @ self.project
        away = np.maximum(self.square[None, :] + (q_points * q_points).sum(1)[:, None] - 2 * q_points @ self.points.T, 0.0)
        away[q_ids[:, None] == ids[None, :]] = np.inf
        ends = [r for r in RINGS if r < n]
        radii = np.sort(np.partition(away, [r - 1 for r in ends], axis=1)[:, [r - 1 for r in ends]], axis=1) if ends else np.zeros((len(q_ids), 0))
        radii = np.hstack([radii, np.full((len(q_ids), 1), np.inf)])
        bound, best = q_bounds.copy(), np.full((len(q_ids), k), np.inf)
        kept, inner, tried = [], np.full(len(q_ids), -1.0), 0
        for ring in range(radii.shape[1]):
            outer = np.minimum(radii[:, ring], far * np.maximum(bound, 1e-12) + 1e-6)
            some = np.flatnonzero(outer > inner)  # queries that the test hasn't stopped
            if not len(some):
                break
            inside = (away[some] > inner[some, None]) & (away[some] <= outer[some, None]) & np.isfinite(away[some])
            q, v = np.nonzero(inside)
            tried += len(q)
            if len(q) > DENSE * inside.size:
                apart = (2 - 2 * q_units[some] @ self.units.T)[inside]
            else:
                apart = np.concatenate([2 - 2 * np.einsum("pd,pd->p", q_units[some[q[i : i + STEP]]], self.units[v[i : i + STEP]]) for i in range(0, len(q), STEP)] or [np.zeros(0)])
            near = apart <= bound[some[q]] + 1e-9
            q, v, apart = some[q[near]], v[near], apart[near]
            kept.append((q, v, apart))
            # The k-th distance of each query with what this ring brought.
            order = np.lexsort((apart, q))
            q, apart = q[order], apart[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            first = place < k
            fresh = np.full((len(q_ids), k), np.inf)
            fresh[q[first], place[first]] = apart[first]
            best = np.sort(np.hstack([best, fresh]), axis=1)[:, :k]
            bound = np.minimum(bound, best[:, k - 1])
            inner = np.maximum(inner, radii[:, ring])
        q, v, apart = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, dtype=np.int64),) * 3
        close = apart <= bound[q] + 1e-9
        q, v = q[close], v[close]
        scores = cosines(self.vectors[v], q_vectors[q])
        order = np.lexsort((ids[v], -scores, q))
        q, v, scores = q[order], v[order], scores[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first], ids[v[first]], scores[first], tried


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


FOUND = "query long, query_id long, vec_id long, score double, tried long"


def search_blocks(rows: DataFrame, queries: DataFrame, blocks: DataFrame, k: int, far: float | None = None) -> DataFrame:
    """rows: cell, vec_id, vec; queries: cell, query (a key of its own), query_id, q_vec, bound - a row for each cell to search; blocks: cell, n_parts.

    A cell's rows are dealt to n_parts blocks, and a query of the cell goes to each of them. A block's rows come to its task
    first and are held (they are bounded), its queries stream past them; so no row is sent twice and no queries are held.
    tried: pairs verified, told by the first row of each batch of queries."""
    sent = F.broadcast(blocks)  # at most CELLS rows a vector length
    none = lambda kind: F.lit(None).cast(kind)
    dealt = rows.join(sent, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "n_parts").cast("long").alias("part"), F.lit(0).alias("kind"), none("long").alias("query"), F.col("vec_id").alias("id"), "vec", none("double").alias("bound"))
    parts = F.sequence(F.lit(0), F.col("n_parts") - 1).cast("array<long>")
    asked = queries.join(sent, "cell").select("cell", F.explode(parts).alias("part"), F.lit(1).alias("kind"), "query", F.col("query_id").alias("id"), F.col("q_vec").alias("vec"), "bound")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if tuple(place[:2, a]) != now:
                    now, held, block = tuple(place[:2, a]), [], None
                piece = batch.slice(a, b - a)
                if not place[2, a]:
                    held.append((piece.column(4).to_numpy(), matrix(piece.column(5))))
                    continue
                if not held:
                    continue
                block = block or Block(*(np.concatenate(x) for x in zip(*held)))
                for at in range(0, piece.num_rows, QUERY_BLOCK):
                    some = piece.slice(at, QUERY_BLOCK)
                    keys, q_ids = some.column(3).to_numpy(), some.column(4).to_numpy()
                    q, ids, scores, tried = block.search(q_ids, matrix(some.column(5)), some.column(6).to_numpy(), k, far)
                    told = np.zeros(len(q), dtype=np.int64)
                    told[:1] = tried
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[q], q_ids[q], ids, scores, told)], names=["query", "query_id", "vec_id", "score", "tried"])

    both = dealt.union(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    return both.mapInArrow(work, FOUND)


def nearest(df: DataFrame, k: int = K, every: int = EVERY, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each distinct row whose id is divisible by `every`."""
    v = F.transform(vector, lambda x: x.cast("double"))
    usable = F.col(key).isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("vec")).where(usable).withColumn("size", F.size("vec"))
    counts = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(LENGTHS + 1).collect()}
    sizes = list(counts)[:LENGTHS]
    found = [nearest_of_size(rows.where(F.col("size") == size).drop("size"), size, counts[size], k, every).withColumn("size", F.lit(size)) for size in sizes]
    if len(counts) > LENGTHS:
        found.append(nearest_exactly(rows.where(~F.col("size").isin(sizes)), k, every))
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("size", "query").orderBy(F.desc("score"), "vec_id")
    out = functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def queries_of(placed: DataFrame, every: int) -> DataFrame:
    """cell, query, query_id, q_vec: the distinct query rows, each with a key of its own."""
    asked = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select("cell", F.col("vec_id").alias("query_id"), F.col("vec").alias("q_vec"))
    return materialize(asked.distinct().withColumn("query", F.monotonically_increasing_id()))


def nearest_exactly(rows: DataFrame, k: int, every: int) -> DataFrame:
    """All pairs within each length, in blocks; a length is a cell."""
    placed = materialize(rows.select("vec_id", "vec", F.col("size").cast("long").alias("cell")))
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / MOST_BLOCK).cast("int").alias("n_parts"))
    asked = queries_of(placed, every)
    found = search_blocks(placed, asked.withColumn("bound", F.lit(float("inf"))), blocks, k, far=float("inf"))
    return found.withColumn("size", F.lit(-1))  # query keys are their own over all these lengths


def nearest_of_size(rows: DataFrame, size: int, n: int, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    block = min(MOST_BLOCK, max(LEAST_BLOCK, n // 64), max(64, BLOCK_FLOATS // size))
    depth = max(0, min(int(math.log2(CELLS)), math.ceil(math.log2(max(1, n / block)))))
    few = max(64, min(SAMPLE, BLOCK_FLOATS // size))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < int(math.ceil((1 << 20) * min(1.0, few / n)))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(few)
    held = matrix(sample.select("vec").toArrow()["vec"])  # at most `few` rows
    tree = Tree(unit(held) @ directions(size) if len(held) else np.zeros((0, DIMS)), depth)
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = sent.value.cell(unit(matrix(batch.column(1))) @ directions(size))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells)], names=["vec_id", "vec", "cell"])

    def route(first: int, last: int | None):
        """Cells of each query by rising bound, from place `first` to `last`, as far as the test doesn't exclude them. `cell` is the query's own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = unit(matrix(batch.column(3))) @ directions(size)
                cell, bounds = batch.column(0).to_numpy(), batch.column(4).to_numpy()
                take, to = [], []
                for i in range(len(points)):
                    lowest = sent.value.bounds(points[i])
                    order = np.argsort(lowest, kind="stable")
                    order = order[order != cell[i]][first:last]
                    go = order[(chi_square(lowest[order] / max(bounds[i], 1e-12)) < SURE) | (lowest[order] <= 1e-9)]
                    take.append(np.full(len(go), i))
                    to.append(go)
                part = batch.take(pa.array(np.concatenate(take).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int64)), *part.columns[1:]], names=["cell", "query", "query_id", "q_vec", "bound"])

        return run

    def bounded(found: DataFrame) -> DataFrame:
        """The queries with the k-th squared distance among what was found; a query has at most k rows a cell block here."""
        ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
        kth = ranked.where(F.col("r") == k).select("query", (2 - 2 * F.col("score")).alias("bound"))
        return asked.join(kth, "query", "left").select("cell", "query", "query_id", "q_vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    placed = materialize(rows.mapInArrow(place, "vec_id long, vec array<double>, cell long"))
    blocks = materialize(placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n_parts")))
    asked = queries_of(placed, every)
    found = materialize(search_blocks(placed, asked.withColumn("bound", F.lit(float("inf"))), blocks, k))
    for first, last in ((0, NEAR_CELLS), (NEAR_CELLS, None)):
        if 1 << depth <= first + 1:
            break
        routed = materialize(bounded(found).mapInArrow(route(first, last), "cell long, query long, query_id long, q_vec array<double>, bound double"))
        found = found.union(materialize(search_blocks(placed, routed, blocks, k)))
    return found


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_nearest_neighbours": op5_nearest_neighbours}
