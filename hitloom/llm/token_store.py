"""Token-id files with keyed access.

A store is a folder of shards. Documents are range-partitioned by id, so shards follow each other in id
order. Each shard is a payload file (raw ids, unsigned 16 or 32 bit, document after document) and an index
file: a minimal perfect hash over the shard's keys (levels of collision-free bits, position by rank) and, by
hash position, the key's stored 32-bit fingerprint, the offset of its ids and their number. A lookup takes
constant time: bounds of shards -> hash position -> fingerprint -> payload slice.

Files are written under a name of the attempt's own and renamed, so a repeated task leaves the same files.
The folder must be one that all executors reach (any that pyarrow.fs opens).

Null text: the end id alone. Null id: sorted first, found under the key of null. Repeated ids are told apart by
their occurrence number, repeated rows likewise, also across shards. An empty table makes an empty store. Ids take 16 bits
where the whole vocabulary fits, else 32; a width that is too small for the vocabulary is an error.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import STEP, materialize, mix, new_folder, table

END_ID = 2
#: A shard is closed at so many ids or documents; this bounds a task's memory.
SHARD_IDS, SHARD_DOCS = 8_000_000, 100_000
MAGIC, HEAD = b"HLTS", struct.Struct("<4sIQQII")  # magic, bytes an id, documents, ids, levels, unused
NULL_KEY = -(1 << 63)
GAMMA = 1.6
#: Documents less than so many bytes apart are read in one piece, up to PIECE bytes at once.
GAP, PIECE = 1 << 16, 1 << 23
#: Ranges of the store whose bounds are broadcast at most.
MOST_PARTS = 100_000
#: Words of a process whose ids are kept, in each of two generations: what was used lately outlives a change.
KEPT_WORDS = 500_000
#: Python's white space beyond the tokenizer's, and letters whose lower case depends on more than themselves.
ODD = re.compile("[\x1c-\x1f\u03a3\u0130]")
#: A full stop or comma behind a letter, at a word's end. The mark comes first, so that the search skips to it and looks back only there.
STOP = re.compile(r"([.,])(?<=[^\W\d_].)(?=\s|$)")


class LibraryEncoder:
    """The tokenizers library, called once for each distinct word of a process.

    The file's pre-tokenizer never joins across white space, so a text's ids are its words' ids in a row.
    Words that a batch of texts brings anew go to the library in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        coded = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, owner = np.asarray(coded.ids, dtype=np.uint32), coded.word_ids
        sizes = np.bincount(np.array(owner, dtype=np.int64), minlength=len(words))
        ends = np.cumsum(sizes) * 4
        data = ids.tobytes()
        return [data[e - 4 * n : e] for e, n in zip(ends.tolist(), sizes.tolist())]

    def words(self, text: str) -> list[str] | None:
        """Lower-case words, or None for a text that the library must see as a whole."""
        if ODD.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)) or any(s in text for s in self.special):
            return None
        # A full stop or comma after a letter is a piece of its own for the pre-tokenizer.
        return STOP.sub(r" \1", text.lower()).split()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [self.words(t or "") for t in texts]
        distinct = set().union(*[words for words in split if words])
        if len(self.recent) > KEPT_WORDS:
            self.older, self.recent = self.recent, {}
        recent, older, fresh = self.recent, self.older, []
        for w in distinct.difference(recent):
            if (ids := older.get(w)) is None:
                fresh.append(w)
            else:
                recent[w] = ids
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            recent.update(zip(some, self.ids(some)))
        find = recent.__getitem__
        return [
            np.asarray(self.library.encode(t, add_special_tokens=False).ids, dtype=np.uint32).tobytes() if words is None else b"".join(map(find, words))
            for t, words in zip(texts, split)
        ]


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def hash_keys(keys: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """One 64-bit hash for a key (int64) and its occurrence number among equal keys."""
    return mix(keys.view(np.uint64) ^ mix(repeats.astype(np.uint64)))


class PerfectHash:
    """Minimal perfect hash: level by level, keys alone on a bit stay there, the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.bits = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
        self.rank = np.concatenate([[0], np.cumsum(self.bits)]).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64)

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys of a shard have one 64-bit hash")
        levels, left = [], hashes
        while len(left):
            size = max(8, int(len(left) * GAMMA))
            at = cls.place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where no level holds it."""
        out, todo = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = self.place(hashes[todo], level, len(bits))
            here = bits[at]
            out[todo[here]] = self.rank[self.base[level] + at[here]]
            todo = todo[~here]
        return out


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def put(path: str, data: list[bytes]) -> None:
    files, at = open_store(path)
    part = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        for x in data:
            out.write(x)
    files.move(part, at)


def number_repeats(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: how many equal ones stand before each."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(keys) else at


class ShardWriter:
    def __init__(self, folder: str, part: int, width: int):
        self.folder, self.part, self.number, self.kind = folder, part, 0, np.uint16 if width == 2 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys, self.sizes, self.data, self.total = [], [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        coded = np.append(np.frombuffer(ids, dtype=np.uint32), END_ID).astype(self.kind)
        self.keys.append(NULL_KEY if key is None else key)
        self.sizes.append(len(coded))
        self.data.append(coded.tobytes())
        self.total += len(coded)

    @property
    def full(self) -> bool:
        return self.total >= SHARD_IDS or len(self.keys) >= SHARD_DOCS

    def close(self) -> dict:
        keys, sizes = np.array(self.keys, dtype=np.int64), np.array(self.sizes, dtype=np.int64)
        hashes = hash_keys(keys, number_repeats(keys))
        found = PerfectHash.build(hashes)
        order = np.empty(len(keys), dtype=np.int64)
        order[found(hashes)] = np.arange(len(keys))
        name = f"shard-{self.part:06d}-{self.number:04d}"
        head = HEAD.pack(MAGIC, self.kind().itemsize, len(keys), self.total, len(found.levels), 0)
        levels = [np.array([len(x) for x in found.levels], dtype=np.int64).tobytes(), np.packbits(found.bits).tobytes()]
        starts = np.cumsum(sizes) - sizes
        by_place = [(hashes >> np.uint64(32)).astype(np.uint32)[order], starts[order], sizes[order].astype(np.uint32)]
        put(f"{self.folder}/{name}.ids", self.data)
        put(f"{self.folder}/{name}.idx", [head, *levels, *(x.tobytes() for x in by_place), keys.tobytes()])
        row = {"part": self.part, "shard": self.number, "name": name, "first_key": int(keys[0]), "last_key": int(keys[-1]), "n_docs": len(keys), "n_ids": self.total}
        self.number += 1
        self.clear()
        return row


MANIFEST = "part int, shard int, name string, first_key long, last_key long, n_docs long, n_ids long"


def id_width(path: str, width: int | None) -> int:
    """Bytes an id: the least of 2 and 4 that the vocabulary's largest id fits in."""
    library = library_encoder(path).library
    largest = max(library.get_vocab(with_added_tokens=True).values(), default=0)
    need = 2 if max(largest, END_ID) < 1 << 16 else 4
    if width is not None and (width not in (2, 4) or width < need):
        raise ValueError(f"ids up to {largest} don't fit in {width} bytes")
    return width or need


def write_store(df: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", width: int | None = None) -> DataFrame:
    """Encode and write all documents; gives the manifest, a row for each shard with start (ids before it).

    The texts are shuffled, not their ids, which are larger; order within an id is by the text's hash, then the row's place.
    """
    kind, width = MANIFEST, id_width(path, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, rows = library_encoder(path), []
        out = ShardWriter(folder, TaskContext.get().partitionId(), width)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for k, ids in zip(part.column(0).to_pylist(), code(part.column(1).to_pylist())):
                    out.add(k, ids)
                    if out.full:
                        rows.append(out.close())
        if out.keys:
            rows.append(out.close())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    files, at = open_store(folder)
    files.create_dir(at, recursive=True)
    docs = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row"))
    order = (F.col("k"), F.xxhash64("t"), F.col("row"))  # equal rows may part anywhere
    sent = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = materialize(sent.mapInArrow(run, kind))
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """One shard, read back; ids are fetched slice by slice."""

    def __init__(self, folder: str, name: str):
        files, at = open_store(f"{folder}/{name}")
        with files.open_input_stream(f"{at}.idx") as src:
            data = src.read()
        magic, self.width, n, self.n_ids, levels, _ = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError(f"{name}: not a token store")
        pos = HEAD.size

        def take(kind, count: int) -> np.ndarray:
            nonlocal pos
            out = np.frombuffer(data, dtype=kind, count=count, offset=pos)
            pos += out.nbytes
            return out

        sizes = take(np.int64, levels)
        bits = np.unpackbits(take(np.uint8, -(-int(sizes.sum()) // 8)), count=int(sizes.sum())).astype(bool)
        self.find = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]) if levels else [])
        self.marks, self.starts, self.sizes, self.keys = take(np.uint32, n), take(np.int64, n), take(np.uint32, n), take(np.int64, n)
        self.in_order = np.sort(self.starts)
        self.file = files.open_input_file(f"{at}.ids")

    def lookup(self, keys: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """found, start and size for each key, by hash position and fingerprint."""
        hashes = hash_keys(keys, repeats)
        at = self.find(hashes)
        ok = (at >= 0) & (self.marks[at] == (hashes >> np.uint64(32)).astype(np.uint32)) if len(self.marks) else at >= 0
        if len(self.marks):  # a fingerprint may agree by chance: the keys are stored in payload order
            ok &= self.keys[np.searchsorted(self.in_order, self.starts[at])] == keys
        return ok, np.where(ok, self.starts[at], 0), np.where(ok, self.sizes[at].astype(np.int64), 0)

    def slices(self, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each slice, in the order given, which must rise; neighbours are read in one piece."""
        kind = np.uint16 if self.width == 2 else np.uint32
        gap, most, at, n = GAP // self.width, PIECE // self.width, 0, len(starts)
        ends = starts + sizes
        while at < n:
            last = at
            while last + 1 < n and starts[last + 1] - ends[last] <= gap and ends[last + 1] - starts[at] <= most:
                last += 1
            low = int(starts[at])
            piece = np.frombuffer(self.file.read_at(int(ends[last] - low) * self.width, low * self.width), dtype=kind)
            for i in range(at, last + 1):
                yield piece[starts[i] - low : ends[i] - low]
            at = last + 1


def read_store(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each fetched by its key."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(folder, name)
                found, starts, sizes = shard.lookup(shard.keys, number_repeats(shard.keys))
                if not found.all():
                    raise ValueError(f"{name}: a key is not found under its own fingerprint")
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.slices(starts, sizes)]
                keys = pa.array(shard.keys, mask=shard.keys == NULL_KEY)
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts + base), pa.array(sizes), pa.array(sums, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("name", "start").repartition("name").mapInArrow(run, kind)


def fetch(keys: DataFrame, manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Keyed access: rows of keys with occurrence and ids (array<long>), once for each document stored under the key, or
    with nulls where there is none.

    The bounds of the store's ranges (one for each task that wrote it, a checked number) are searched for each key; a key then meets the
    shards of its ranges alone.
    """
    wanted = keys.withColumn("__k", F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)))
    bounds = manifest.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("low", "high", "part").limit(MOST_PARTS + 1).collect()
    if len(bounds) > MOST_PARTS:
        raise ValueError(f"the store has more than {MOST_PARTS} ranges")
    parts, lows, highs = (np.array([r[c] for r in bounds], dtype=np.int64) for c in ("part", "low", "high"))

    @F.pandas_udf("array<int>")
    def parts_of(keys: pd.Series) -> pd.Series:
        """Ranges follow each other, so those that may hold a key lie between two places in their sorted bounds."""
        first, last = np.searchsorted(highs, keys.to_numpy(), "left"), np.searchsorted(lows, keys.to_numpy(), "right")
        return pd.Series([parts[i:j].tolist() for i, j in zip(first, last)])

    ranged = wanted.select("__k").distinct().select("__k", F.explode(parts_of("__k")).alias("part"))
    placed = ranged.join(manifest, "part").where(F.col("__k").between(F.col("first_key"), F.col("last_key"))).select("__k", "part", "shard", "name")
    schema = pa.schema([("__k", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()), ("nth", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                for name_of, rows in by_name(batch.slice(at, STEP)):
                    if name_of != name:
                        name, shard = name_of, Shard(folder, name_of)
                    asked, part, number = rows.column(0).to_numpy(), rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
                    nth = np.zeros(len(asked), dtype=np.int64)
                    while len(asked):  # the next occurrence of those keys that had one
                        found, starts, sizes = shard.lookup(asked, nth)
                        asked, nth, starts, sizes = asked[found], nth[found], starts[found], sizes[found]
                        order = np.argsort(starts)
                        for i, ids in zip(order.tolist(), shard.slices(starts[order], sizes[order])):
                            yield pa.RecordBatch.from_pylist([{"__k": int(asked[i]), "part": part, "shard": number, "nth": int(nth[i]), "ids": ids.astype(np.int64)}], schema=schema)
                        nth = nth + 1

    sent = placed.repartition("name").sortWithinPartitions("name", "__k").select("__k", "part", "shard", "name")
    got = sent.mapInArrow(run, "__k long, part int, shard int, nth long, ids array<long>")
    order = Window.partitionBy("__k").orderBy("part", "shard", "nth")
    got = got.withColumn("occurrence", F.row_number().over(order) - 1).drop("part", "shard", "nth")
    return wanted.join(got, "__k", "left").drop("__k")


def by_name(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Runs of rows of one shard's name (column 3)."""
    names, at = batch.column(3).to_pylist(), 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[at]:
            yield names[at], batch.slice(at, i - at)
            at = i


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "store")
    manifest = write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, vocabulary_path())
    return read_store(manifest, folder)


QUERIES = {"op4_token_store": op4_token_store}
