"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows that one Python call handles; bounds the memory of a task with very long texts.
STEP = 256
#: Entries that a per-process word cache holds before it starts anew.
CACHE_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs on this machine (tests),
    a folder of our own; on a cluster that is an error, since executors couldn't read each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='hitloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A name not yet used in the application's own folder, which is deleted when the application's JVM ends."""
    own = f"{shared_dir(spark)}/hitloom-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{own}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it again. Survives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing needs any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(t.folder)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: A key is hot from so many rows on, or from the HOT_KEYS-th part of all rows if that is more: so there are at most HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 256, 10_000


def hot_keys(df: DataFrame, key: str, rows: int, count: Column | None = None, steady: bool = False) -> DataFrame:
    """hot, turns: hot keys of a table of `rows` rows (a bounded table, at most HOT_KEYS), and by how many tasks each is to be shared.

    count: the number of rows that a row of df stands for. steady: always with the key 0, so that plans are the same with hot keys and without (a row
    of null would be filtered out before a join, and an empty table leaves the join out)."""
    limit = max(HOT_ROWS, -(-rows // HOT_KEYS))
    found = df.groupBy(F.col(key).alias("hot")).agg((F.count("*") if count is None else F.sum(count)).alias("n")).where(F.col("n") > limit)
    found = found.select("hot", F.ceil(F.col("n") / limit).cast("int").alias("turns"))
    if steady:
        found = found.union(df.sparkSession.range(1).select(F.lit(0).cast(found.schema["hot"].dataType).alias("hot"), F.lit(1).alias("turns"))).groupBy("hot").agg(F.max("turns").alias("turns"))
    return found


def join_spread(many: DataFrame, one: DataFrame, key: str, spread: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """many joined with one by key, hot keys shared among tasks by the hash of the column `spread`: `one` is repeated for each turn.

    hot: hot_keys, materialized. Both sides read it, so unwritten it would be two more aggregations of a whole table in every plan."""
    hot = F.broadcast(hot)
    dealt = many.join(hot, many[key] == hot["hot"], "left").withColumn("__turn", F.coalesce(F.pmod(F.xxhash64(spread), "turns"), F.lit(0).cast("long"))).drop("hot", "turns")
    every = one.join(hot, one[key] == hot["hot"], "left").withColumn("__turn", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("turns", F.lit(1)).cast("long") - 1))).drop("hot", "turns")
    return dealt.join(every, [key, "__turn"], how).drop("__turn")


def map_rows(df: DataFrame, columns: list[str], outputs: dict[str, str], factory: Callable[[], Callable]) -> DataFrame:
    """Append outputs (name -> DDL type) computed batch by batch from columns.

    factory() runs once per task and gives a function from lists of column values to a list of
    output columns. All other columns pass through unread; one that has an output's name is replaced.
    """
    taken = {name.lower() for name in outputs}
    keep = [f for f in df.schema.fields if f.name.lower() not in taken]
    added = [StructField(name, _parse_datatype_string(kind)) for name, kind in outputs.items()]
    # An input that an output replaces travels under a name of its own.
    sent = df.select(*[F.col(f"`{f.name}`") for f in keep], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(columns)])
    names = [f.name for f in keep] + list(outputs)
    types = [to_arrow_type(f.dataType) for f in added]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                made = work(*[part.column(width + i).to_pylist() for i in range(len(columns))])
                arrays = [part.column(i) for i in range(width)]
                arrays += [pa.array(values, type=kind) for values, kind in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return sent.mapInArrow(run, StructType([*keep, *added]))


class WordCache(dict):
    """word -> value, computed once by make(word); emptied when full, so memory is bounded."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = self.make(word)
        return value


_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def ngram_bins(points: np.ndarray, lengths: tuple[int, ...], bits: int) -> np.ndarray:
    """Hash bins (2**bits of them) of all n-grams of the given lengths, with repeats."""
    out, rolled = [], np.zeros(len(points), dtype=np.uint64)
    shift = np.uint64(64 - bits)
    for n in range(1, max(lengths) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * _M1 + points[n - 1 :] + np.uint64(n)
        if n in lengths:
            mixed = rolled ^ (rolled >> np.uint64(29))
            out.append(((mixed * _GOLD) >> shift).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def training_row(key: str = "doc_id"):
    """True on rows that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0


def within_bins(rows: DataFrame, most: int, *order) -> DataFrame:
    """Of a bounded sample of rows (bins, ...), the first ones by `order` that hold `most` bins together at most."""
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__held", F.sum(F.size("bins").cast("long")).over(upto)).where(F.col("__held") <= most).drop("__held")
