"""Substring dedup by fixed-block anchors.

A window is WINDOW (13) consecutive words; a word goes if a window over it also stands in a document with a smaller id.

Index and probe. Each document is cut into blocks of BLOCK (7) words, not overlapping; their hashes are the index, a seventh of
the corpus. Any window that a document has holds one of its blocks whole, so whoever repeats it finds that block with
one of its own rolling windows of 7 words. Every rolling window is probed. The hashes of a batch of documents travel packed, a row for each batch
and bin of hashes; a bin is one task, which builds the index of its blocks and lets the probes pass by. A hash counts once for each
batch (repeats within the batch are settled there), so a passage that many documents hold isn't a hot key. The answer is where in
the batch anchors were hit, both of who probed and of the block's own document.

Extend. The windows over a hit are then held against each other in the same way by a 96-bit fingerprint of all 13 words: a bin finds the
least id that has the window and answers everyone else. Covered windows that overlap or touch are one maximal repeat, a span.

Copies of a whole word sequence need none of it: all but those of the least id go as a whole. So work is linear in the words, and no
pairs of documents are made, however many share a passage.

Null and empty texts have no words. Null ids come after all others, and such documents don't remove each other's words, nor do
different texts or repeated rows of one id. A passage that one document alone repeats stays. Texts of fewer than 13 words stay. Only
the id and text columns are read, whatever others are called. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, discard, hot_keys, join_spread, map_rows, materialize, mix, table

WINDOW, BLOCK = 13, 7
#: Bytes of text and documents that are hashed together, and words (in the second round: windows) that a bin has about.
BATCH_BYTES, BATCH_DOCS, BIN_WORDS, BIN_WINDOWS = 6 << 20, 1 << 15, 1 << 21, 1 << 18
#: Bits of the filter that keeps most texts without a hit out of a shuffle; what it lets pass by mistake finds no partner there.
FILTER_BITS = 1 << 23
_LAST = (1 << 63) - 1
_PRIME, _OTHER = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C55)
#: Kinds of packed rows, in the order in which a bin reads them. SHARED ones are hashes of several documents of a batch, which need no answer.
BLOCKS, SHARED_BLOCKS, PROBES, SHARED_PROBES, DOCS, ANSWER = range(6)
PACKED = "bin int, kind int, batch long, hashes binary, ids binary, at binary"
_CLEANED = pa.schema([("__id", pa.int64()), ("__hash", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_ARROW = pa.schema([("bin", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary()), ("at", pa.binary())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: cuts at blanks and \t to \r, nothing else


def rolled(codes: np.ndarray, size: int, prime: np.uint64 = _PRIME) -> np.ndarray:
    """A hash of each `size` codes in a row."""
    out = np.zeros(max(0, len(codes) - size + 1), dtype=np.uint64)
    for i in range(size):
        out = out * prime + codes[i : i + len(out)]
    return mix(out)


def pack_places(at: np.ndarray) -> bytes:
    """Ascending places as steps of 16 bits, or of 32 where one is wider."""
    steps = np.diff(at, prepend=0)
    return steps.astype("<u2" if steps.max(initial=0) < 1 << 16 else "<u4").tobytes()


def places(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4"), dtype=np.int64)


class Batch:
    """Documents that are hashed together: their words' codes in a row."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, codes: list[np.ndarray]):
        self.ids, self.keys, self.sizes = ids, keys, np.array([len(c) for c in codes], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = mix(np.concatenate(codes)) if codes else np.zeros(0, dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(codes)), self.sizes)
        self.within = np.arange(len(self.codes)) - self.starts[self.doc]

    def inside(self, size: int) -> np.ndarray:
        """Where a window of this size starts within a document."""
        n = max(0, len(self.codes) - size + 1)
        return self.within[:n] + size <= self.sizes[self.doc[:n]]


def batches_of(rows: Iterator[pa.RecordBatch], code: WordCache, most: int = BATCH_DOCS) -> Iterator[tuple[Batch, pa.RecordBatch]]:
    """Rows id, hash, text, ... by batches; documents of fewer words than a window stay out."""
    for rb in rows:
        sizes = pc.fill_null(pc.binary_length(rb.column(2)), 0).to_numpy(zero_copy_only=False)
        low = 0
        while low < rb.num_rows:
            high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low : low + most]), BATCH_BYTES, "right")))
            part = rb.slice(low, high - low)
            low = high
            found = [np.fromiter(map(code.__getitem__, w), dtype=np.uint64, count=len(w)) for w in map(words_of, part.column(2).to_pylist())]
            long = np.array([len(c) >= WINDOW for c in found])
            if long.any():
                part = part.filter(pa.array(long))
                yield Batch(part.column(0).to_numpy(), part.column(1).to_numpy(), [c for c in found if len(c) >= WINDOW]), part


def cut(kinds: np.ndarray, bins: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """kind, bin and the entries (indexes) of each, by place."""
    order = np.lexsort((at, bins, kinds))
    k, b = kinds[order], bins[order]
    edges = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, dtype=np.int64)
    for low, high in zip(edges, np.r_[edges[1:], len(order)]):
        yield int(k[low]), int(b[low]), order[low:high]


def anchors(batch: Batch, bits: int) -> tuple[list, np.ndarray]:
    """Rows (bin, kind, hashes, ids, at) of the batch's blocks and probes, and places that are hit within the batch."""
    x = np.flatnonzero(batch.inside(BLOCK))
    h = rolled(batch.codes, BLOCK)[x]
    order = np.argsort(h, kind="stable")  # places, and so documents, ascend within a hash
    h, x = h[order], x[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=np.int64)
    last = np.r_[first[1:], len(h)]
    shared = batch.doc[x[first]] != batch.doc[x[last - 1]]
    block = np.logical_or.reduceat(batch.within[x] % BLOCK == 0, first) if len(first) else np.zeros(0, dtype=bool)
    kinds = np.where(block, BLOCKS, PROBES) + shared  # the SHARED kind stands after its own
    own, at = h[first], x[first]
    bins, short = (own >> np.uint64(64 - bits)).astype(np.int64), (own >> np.uint64(32 - bits)).astype(np.uint32)
    rows = [(b, k, short[i].tobytes(), b"", b"" if k in (SHARED_BLOCKS, SHARED_PROBES) else pack_places(at[i])) for k, b, i in cut(kinds, bins, at)]
    return rows, np.sort(x[np.repeat(shared, last - first)])


def answer_anchors(rows: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """batch and places that are hit, of one bin's rows (kind, batch, hashes, ids, at) by kind."""
    held: list[tuple[int, np.ndarray, np.ndarray | None]] = []
    index = None
    for kind, batch, hashes, _, at in rows:
        h = np.frombuffer(hashes, dtype=np.uint32)
        if kind <= SHARED_BLOCKS:
            held.append((batch, h, places(at, len(h)) if kind == BLOCKS else None))
            continue
        if index is None:
            index, times = np.unique(np.concatenate([e[1] for e in held]) if held else np.zeros(0, dtype=np.uint32), return_counts=True)
            hit = times > 1
        there = np.minimum(np.searchsorted(index, h), max(0, len(index) - 1))
        found = index[there] == h if len(index) else np.zeros(len(h), dtype=bool)
        hit[there[found]] = True
        if kind == PROBES and found.any():
            yield batch, places(at, len(h))[found]
    if held and index is None:
        index, times = np.unique(np.concatenate([e[1] for e in held]), return_counts=True)
        hit = times > 1
    for batch, h, at in held:
        if at is not None and (own := hit[np.searchsorted(index, h)]).any():
            yield batch, at[own]


def fingerprints(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    return rolled(batch.codes, WINDOW), (rolled(batch.codes ^ _OTHER, WINDOW, _OTHER) >> np.uint64(32)).astype(np.uint32)


def like(batch: Batch, hashes: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Which places have the hash of a hit of their own document."""
    own = mix(hashes ^ mix(batch.doc[: len(hashes)].astype(np.uint64)))
    return np.isin(own, own[hits])


def windows(batch: Batch, bits: int, hits: np.ndarray) -> tuple[list, np.ndarray]:
    """Likewise for the windows that hold an anchor which was hit."""
    hit = like(batch, rolled(batch.codes, BLOCK), hits) & batch.inside(BLOCK)
    upto = np.concatenate([[0], np.cumsum(hit)])
    fit = batch.inside(WINDOW)
    n, over = len(fit), WINDOW - BLOCK + 1
    x = np.flatnonzero(fit & (upto[over : over + n] > upto[:n]))
    h, g = (f[x] for f in fingerprints(batch))
    doc = batch.doc[x]
    order = np.lexsort((doc, batch.ids[doc], g, h))
    h, g, x, doc = h[order], g[order], x[order], doc[order]
    ids = batch.ids[doc]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(h) else np.zeros(0, dtype=bool)
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else ids
    one = np.flatnonzero((ids == least) & (new | np.r_[True, doc[1:] != doc[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    at, own = x[one], h[one]
    bins = (own >> np.uint64(64 - bits)).astype(np.int64)
    rows = [(b, k, own[i].tobytes() + g[one][i].tobytes(), ids[one][i].tobytes(), pack_places(at[i])) for k, b, i in cut(np.zeros(len(one), dtype=np.int64), bins, at)]
    return rows, np.sort(x[ids > least])


def answer_windows(rows: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """batch and places of those windows that a smaller id has too."""
    held = [(batch, np.frombuffer(hashes, dtype="<u8", count=len(ids) // 8), np.frombuffer(hashes, dtype="<u4", offset=len(ids)), np.frombuffer(ids, dtype="<i8"), at) for _, batch, hashes, ids, at in rows]
    if not held:
        return
    h, g, ids = (np.concatenate([e[i] for e in held]) for i in (1, 2, 3))
    order = np.lexsort((ids, g, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
    covered = np.zeros(len(h), dtype=bool)
    covered[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    start = 0
    for batch, own, _, _, at in held:
        mine = covered[start : start + len(own)]
        start += len(own)
        if mine.any():
            yield batch, places(at, len(own))[mine]


def record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def exchange(docs: DataFrame, bins: int, rows_of: Callable, answers: Callable, most: int = BATCH_DOCS) -> DataFrame:
    """__key (id, hash of the text) and at (places in the text, array<int>): the answers to what rows_of makes of each batch.

    docs: __id, __hash, text and maybe at. One shuffle takes the packed rows to their bins, another the answers back to their batch, where
    a row says which documents it has.
    """
    bits = bins.bit_length() - 1

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, nth = WordCache(xxhash.xxh3_64_intdigest), TaskContext.get().partitionId(), 0
        for batch, part in batches_of(rows, code, most):
            if part.num_columns > 3:
                hits = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), np.diff(hits.offsets.to_numpy()))
                made, here = rows_of(batch, bits, batch.starts[owner] + hits.flatten().to_numpy())
            else:
                made, here = rows_of(batch, bits)
            name = xxhash.xxh3_64_intdigest(np.concatenate([batch.ids, batch.keys, [task, nth]]).tobytes()) >> 1  # the same if the task runs again
            nth += 1
            out = [(b, k, name, hashes, ids, at) for b, k, hashes, ids, at in made]
            out.append((name % bins, DOCS, name, batch.keys.tobytes(), batch.ids.tobytes(), batch.starts.astype("<u4").tobytes() + here.astype("<u4").tobytes()))
            for low in range(0, len(out), 1000):
                yield record(out[low : low + 1000])

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[tuple] = []

        def asked() -> Iterator[tuple]:
            for rb in rows:
                for _, kind, *rest in zip(*(rb.column(i).to_pylist() for i in range(6))):
                    if kind == DOCS:
                        passed.append((0, kind, *rest))
                    else:
                        yield kind, *rest

        for batch, at in answers(asked()):
            yield record([(0, ANSWER, batch, b"", b"", at.astype("<u4").tobytes())])
        for row in passed:
            yield record([row])

    def by_document(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for keys, ids, at, more in zip(*(rb.column(i).to_pylist() for i in range(4))):
                keys, ids, at = np.frombuffer(keys, dtype="<i8"), np.frombuffer(ids, dtype="<i8"), np.frombuffer(at, dtype="<u4")
                starts = at[: len(keys)].astype(np.int64)
                hits = np.unique(np.concatenate([at[len(keys) :], *(np.frombuffer(m, dtype="<u4") for m in more or [])])).astype(np.int64)
                doc = np.searchsorted(starts, hits, "right") - 1
                own, first = np.unique(doc, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(hits)].astype(np.int32)), pa.array((hits - starts[doc]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(keys[own]), lists], names=["__id", "__hash", "at"])

    sent = docs.mapInArrow(ask, PACKED).repartitionById(bins, "bin").sortWithinPartitions("kind").mapInArrow(answer, PACKED)
    kept = materialize(sent.drop("bin"))
    back = kept.where(F.col("kind") == ANSWER).groupBy("batch").agg(F.collect_list("at").alias("more"))
    every = kept.where(F.col("kind") == DOCS).join(back, "batch", "left").select("hashes", "ids", "at", "more")
    hits = materialize(every.mapInArrow(by_document, "__id long, __hash long, at array<int>").select(F.struct("__id", "__hash").alias("__key"), "at"))
    discard(kept)
    # Rows that were repeated have several rows of hits; they are put together without a list of all.
    twice = hits.groupBy("__key").count().where("count > 1").select("__key")
    again = materialize(hits.join(twice, "__key", "left_semi").select("__key", F.explode("at").alias("at")).distinct().groupBy("__key").agg(F.collect_list("at").alias("at")))
    return hits.join(again.select("__key"), "__key", "left_anti").unionByName(again)


def keyed(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """__id, __hash, text and at of those documents that have hits."""
    chunk, one = F.expr(f"cast(pmod(xxhash64(__key), {FILTER_BITS}L) div 64 as int)"), F.expr("shiftleft(1L, cast(pmod(xxhash64(__key), 64L) as int))")
    filled = hits.groupBy(chunk.alias("__chunk")).agg(F.bit_or(one).alias("__bits"))  # FILTER_BITS / 64 rows at most
    near = docs.withColumn("__chunk", chunk).join(F.broadcast(filled), "__chunk").where(F.col("__bits").bitwiseAND(one) != 0)
    return near.select("__key", "text").join(hits.hint("shuffle_hash"), "__key").select("__key.__id", "__key.__hash", "text", "at")


def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of __id, __hash, text, at (covered windows): the spans of words that go, and the digest of what stays."""
    code = WordCache(xxhash.xxh3_64_intdigest)
    for batch, part in batches_of(rows, code):
        hits = part.column(3)
        owner = np.repeat(np.arange(part.num_rows), np.diff(hits.offsets.to_numpy()))
        gone = like(batch, fingerprints(batch)[0], batch.starts[owner] + hits.flatten().to_numpy()) & batch.inside(WINDOW)
        edge = np.zeros(len(batch.codes) + 1, dtype=np.int64)
        np.add.at(edge, np.flatnonzero(gone), 1)
        np.add.at(edge, np.flatnonzero(gone) + WINDOW, -1)
        covered = np.cumsum(edge)[:-1] > 0
        for i, text in enumerate(part.column(2).to_pylist()):
            own = covered[batch.starts[i] : batch.starts[i] + batch.sizes[i]]
            turns = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            kept = b" ".join([w for w, c in zip(words_of(text), own.tolist()) if not c])
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
            yield pa.RecordBatch.from_pylist([{"__id": int(batch.ids[i]), "__hash": int(batch.keys[i]), "spans": spans, "n_removed": int(own.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}], schema=_CLEANED)


def summary(text: str | None) -> tuple[int, str]:
    words = words_of(text)
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def bins_for(n: int, size: int, spark: SparkSession) -> int:
    """A power of 2."""
    return 1 << (max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // size)) - 1).bit_length()


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", batch_docs: int = BATCH_DOCS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (start and end in words, the end not included) of every row.

    batch_docs: documents that are hashed together at most."""
    spark = df.sparkSession
    plain = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = plain.withColumn("__key", F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("__id"), F.xxhash64("text").alias("__hash")))
    count = lambda texts: list(zip(*map(summary, texts))) if texts else [[], []]
    rows = materialize(map_rows(docs, ["text"], {"n_words": "long", "__sha": "string"}, lambda: count).drop("text").withColumn("__row", F.monotonically_increasing_id()))
    n, n_words = rows.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).collect()[0]
    long = F.col("n_words") >= WINDOW
    same = materialize(rows.where(long).groupBy("__sha").agg(F.min("__key.__id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    found = join_spread(rows, same, "__sha", "__row", hot_keys(same, "__sha", n, F.col("n")), "left")
    rows_known = materialize(found.withColumn("copy", F.coalesce(F.col("__key.__id") > F.col("least"), F.lit(False))).select("doc_id", "n_words", "__sha", "__key", "__row", "copy"))
    discard(rows, same)

    parts = lambda d: d.select("__key.__id", "__key.__hash", "text")
    anchored = exchange(parts(docs), bins_for(n_words, BIN_WORDS, spark), anchors, answer_anchors, batch_docs)
    copies = rows_known.where("copy").select("__key").distinct()
    anchored = materialize(anchored.join(copies, "__key", "left_anti"))
    n_windows = anchored.agg(F.coalesce(F.sum(F.size("at").cast("long")), F.lit(0))).collect()[0][0]
    covered = materialize(exchange(keyed(docs, anchored), bins_for(n_windows, BIN_WINDOWS, spark), windows, answer_windows, batch_docs))
    spans = "array<struct<start:int,end:int>>"
    cleaned = keyed(docs, covered).mapInArrow(remove, f"__id long, __hash long, spans {spans}, n_removed long, kept_sha256 string")
    cleaned = materialize(cleaned.select(F.struct("__id", "__hash").alias("__key"), "spans", "n_removed", "kept_sha256"))
    per_key = cleaned.dropDuplicates(["__key"])  # repeated rows have equal results
    joined = join_spread(rows_known, per_key, "__key", "__row", hot_keys(rows_known, "__key", n), "left")
    nothing = F.array().cast(spans)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    out = joined.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "__sha")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )
    out = materialize(out)
    discard(anchored, covered, cleaned, rows_known)
    return out


def kept_text(text: str | None, spans: list[dict] | None) -> str:
    """A text's words without those in spans, joined by one space."""
    words = words_of(text)
    for s in reversed(spans or []):
        del words[s["start"] : s["end"]]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


QUERIES = {"op11_substring_dedup": op11_substring_dedup}

#: Every window of every document, by its words.
ORACLE = {
    "op11_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from starts),
least as (select g, min(doc_id) as first_id from win group by g),
covered as (select win.doc_id, win.i from win join least on win.g = least.g where least.first_id < win.doc_id),
gone as (select distinct doc_id, i + k as p from covered, range(0, 13) r(k)),
words as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
kept as (
  select words.doc_id, string_agg(words.w[words.p], ' ' order by words.p) as text
  from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p where gone.p is null group by words.doc_id
),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(removed.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id left join removed on removed.doc_id = d.doc_id
"""
}
