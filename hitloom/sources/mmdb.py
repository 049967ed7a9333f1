"""Geo database files (MMDB) as a Spark source: ranges of addresses of both families with values of their records.

    spark.dataSource.register(mmdb.MmdbSource)
    geo = spark.read.format("mmdb").option("columns", "geo_country=country.names.en,geo_city=city.names.en").load("/data/city.mmdb")
    lookups.ip_ranges(hits, geo)

The file is a binary search tree over the bits of addresses; its leaves point to records. The tree is cut into subtrees, each of which one
task walks; neighbouring networks with one record become one range. A path names the keys (or places of a list) that lead to a
value; what isn't there is null. An IPv4 part in an IPv6 tree comes out as IPv4 addresses, once, and not under its aliases.
"""

from __future__ import annotations

import functools
import ipaddress
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: What stands before the metadata, and the blank between tree and data (fixed values of the format).
MARK, BLANK = b"\xab\xcd\xefMaxMind.com", 16
#: Subtrees that a family's tree is cut into, about, and rows of a batch.
SUBTREES, BATCH = 64, 4096


def _open(path: str) -> bytes:
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        with open(path, "rb") as f:
            return f.read()
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return f.read()


class Database:
    def __init__(self, data: bytes):
        at = data.rfind(MARK)
        if at < 0:
            raise ValueError("not an MMDB file")
        self.data, self.base = data, at + len(MARK)
        self.meta = self.value(self.base)[0]
        self.nodes, self.size = self.meta["node_count"], self.meta["record_size"]
        if self.size not in (24, 28, 32):
            raise ValueError(f"records of {self.size} bits")
        self.base = self.nodes * self.size // 4 + BLANK  # of the data, from here on
        self.bits = 128 if self.meta["ip_version"] == 6 else 32

    def value(self, at: int) -> tuple[object, int]:
        """The value at a place, and the place after it."""
        data, head = self.data, self.data[at]
        kind, at = head >> 5, at + 1
        if kind == 1:
            extra = (head >> 3) & 3
            low = int.from_bytes(data[at : at + extra + 1])
            found = low if extra == 3 else ((head & 7) << (8 * (extra + 1))) + low + (0, 2048, 526336)[extra]
            return self.value(self.base + found)[0], at + extra + 1
        if kind == 0:
            kind, at = data[at] + 7, at + 1
        size = head & 31
        if size > 28:
            n = size - 28
            size, at = int.from_bytes(data[at : at + n]) + (29, 285, 65821)[n - 1], at + n
        if kind == 7 or kind == 11:
            out: dict | list = {} if kind == 7 else []
            for _ in range(size):
                if kind == 7:
                    key, at = self.value(at)
                    out[key], at = self.value(at)
                else:
                    item, at = self.value(at)
                    out.append(item)
            return out, at
        if kind == 14:
            return bool(size), at
        raw, at = data[at : at + size], at + size
        if kind == 2:
            return raw.decode("utf-8"), at
        if kind in (3, 15):
            return struct.unpack(">d" if kind == 3 else ">f", raw)[0], at
        return raw if kind == 4 else int.from_bytes(raw, signed=kind == 8 and size == 4), at

    def children(self, node: int) -> tuple[int, int]:
        width = self.size // 4
        raw = self.data[node * width : (node + 1) * width]
        if self.size == 28:
            return int.from_bytes(raw[:3]) | (raw[3] >> 4) << 24, int.from_bytes(raw[4:]) | (raw[3] & 15) << 24
        half = width // 2
        return int.from_bytes(raw[:half]), int.from_bytes(raw[half:])

    def v4_root(self) -> int:
        node = 0
        for _ in range(self.bits - 32):
            if node >= self.nodes:
                break
            node = self.children(node)[0]
        return node

    def record(self, found: int) -> object:
        return self.value(self.base + found - self.nodes - BLANK)[0]

    def leaves(self, node: int, prefix: int, depth: int, bits: int, skip: int | None) -> Iterator[tuple[int, int, int]]:
        """first and last address, and the record, of each network below a node, in order. skip: a subtree that is left out."""
        todo = [(node, prefix, depth)]
        while todo:
            node, prefix, depth = todo.pop()
            if node == skip or node == self.nodes:
                continue
            if node > self.nodes:
                low = prefix << (bits - depth)
                yield low, low + (1 << (bits - depth)) - 1, node
            elif depth < bits:
                left, right = self.children(node)
                todo += [(right, prefix << 1 | 1, depth + 1), (left, prefix << 1, depth + 1)]

    def subtrees(self, count: int) -> Iterator[tuple[int, int, int, int, int | None]]:
        """leaves' arguments: both families' trees, cut at the depth at which there are `count` nodes or more."""
        root = self.v4_root()
        families = [(root, 32, None)] + ([(0, 128, root)] if self.bits == 128 else [])
        for start, bits, skip in families:
            level = [(start, 0, 0)]
            while len(level) < count and any(n < self.nodes and n != skip for n, _, _ in level) and level[0][2] < bits:
                level = [
                    (child, prefix << 1 | i, depth + 1) if node < self.nodes and node != skip else (node, prefix, depth)
                    for node, prefix, depth in level for i, child in enumerate(self.children(node) if node < self.nodes and node != skip else (node,))
                ]
            yield from ((node, prefix, depth, bits, skip) for node, prefix, depth in level if node != skip and node != self.nodes)


@functools.lru_cache(maxsize=2)
def database(path: str) -> Database:
    return Database(_open(path))


def at_path(record: object, path: list[str]) -> str | None:
    for key in path:
        if isinstance(record, list):
            record = record[int(key)] if key.isdigit() and int(key) < len(record) else None
        else:
            record = record.get(key) if isinstance(record, dict) else None
    return None if record is None else str(record)


@dataclass
class Subtree(InputPartition):
    node: int
    prefix: int
    depth: int
    bits: int
    skip: int | None


class MmdbReader(DataSourceReader):
    def __init__(self, path: str, columns: dict[str, str], subtrees: int):
        self.path, self.columns, self.count = path, columns, subtrees

    def partitions(self) -> list[InputPartition]:
        return [Subtree(*s) for s in database(self.path).subtrees(self.count)]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        held = database(self.path)
        paths, known = [p.split(".") for p in self.columns.values()], {}
        text = lambda n: str(ipaddress.IPv4Address(n) if partition.bits == 32 else ipaddress.IPv6Address(n))

        def ranges() -> Iterator[tuple[int, int, int]]:
            now = None
            for low, high, found in held.leaves(partition.node, partition.prefix, partition.depth, partition.bits, partition.skip):
                if now and now[2] == found and now[1] + 1 == low:
                    now = (now[0], high, found)
                else:
                    if now:
                        yield now
                    now = (low, high, found)
            if now:
                yield now

        rows: list[tuple] = []
        for low, high, found in ranges():
            if found not in known:
                known = known if len(known) < 100_000 else {}
                record = held.record(found)
                known[found] = tuple(at_path(record, p) for p in paths)
            rows.append((text(low), text(high), *known[found]))
            if len(rows) == BATCH:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["lo", "hi", *self.columns])


class MmdbSource(DataSource):
    """Options: columns (name=path of keys, comma-separated) and subtrees."""

    @classmethod
    def name(cls) -> str:
        return "mmdb"

    def columns(self) -> dict[str, str]:
        pairs = [c.split("=", 1) for c in self.options.get("columns", "geo_country=country.names.en").split(",")]
        return {name.strip(): path.strip() for name, path in pairs}

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in ("lo", "hi", *self.columns())])

    def reader(self, schema: StructType) -> MmdbReader:
        return MmdbReader(self.options["path"], self.columns(), int(self.options.get("subtrees", SUBTREES)))
