"""A warehouse sink that commits: rows become segments of NDJSON, sealed by size or age, and a manifest says which of them count.

    spark.dataSource.register(segments.SegmentSink)
    wide.write.format("segments").mode("append").options(path=folder, table="events", segment_bytes=1 << 26).save()
    wide.writeStream.format("segments").options(path=folder, table="events", checkpointLocation=...).start()
    segments.read(spark, folder, "events", schema)

Tasks write segments under names of their own attempt. Only the driver's commit makes them count: it writes one manifest for the job or
micro-batch, under the batch's number, in one step. So a failed task leaves no rows (its segments are in no manifest, and an aborted job deletes
what it knows of), and a micro-batch that is repeated finds its manifest there and adds nothing. Load jobs take the manifests' files.
A segment's path follows the table layout (sources.sinks.table_path). Null fields are written; nested ones as JSON.
"""

from __future__ import annotations

import datetime
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .sinks import table_path

TEMPLATE = "{table}/y={year}/m={month}/d={day}/{segment}{extension}"
SEGMENT_BYTES, SEGMENT_SECONDS = 64 << 20, 300.0


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Sealed(WriterCommitMessage):
    """What a task has written: path below the folder, rows and bytes of each segment."""

    files: list[tuple[str, int, int]] = field(default_factory=list)


def plain(value: object) -> object:
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, bytes):
        return value.hex()
    return str(value)


class Writer:
    """Shared by batch and stream."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.table, self.schema = options["path"], options["table"], schema
        self.template = options.get("template", TEMPLATE)
        self.most, self.age = int(options.get("segment_bytes", SEGMENT_BYTES)), float(options.get("segment_seconds", SEGMENT_SECONDS))

    def write(self, rows: Iterator[pa.RecordBatch]) -> Sealed:
        """Segments end at segment_bytes, or when they have been open for segment_seconds."""
        system, root = _system(self.folder)
        out, held, size, opened = Sealed(), [], 0, time.monotonic()

        def seal() -> None:
            nonlocal held, size, opened
            name = table_path(self.template, self.table, self.schema, None, uuid.uuid4().hex, ".ndjson")
            system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(b"".join(held))
            out.files.append((name, len(held), size))
            held, size, opened = [], 0, time.monotonic()

        for batch in rows:
            for row in batch.to_pylist():
                line = json.dumps(row, default=plain, ensure_ascii=False, separators=(",", ":")).encode() + b"\n"
                held.append(line)
                size += len(line)
                if size >= self.most:
                    seal()
            if held and time.monotonic() - opened >= self.age:
                seal()
        if held:
            seal()
        return out

    def manifest(self, name: str) -> str:
        return f"{_system(self.folder)[1]}/{self.table}/_manifests/{name}.json"

    def seal_job(self, messages: list[Sealed | None], name: str) -> None:
        system, at = _system(self.folder)[0], self.manifest(name)
        if system.get_file_info(at).type != fs.FileType.NotFound:  # the batch was committed before
            self.drop(messages)
            return
        files = [f for m in messages if m for f in m.files]
        system.create_dir(posixpath.dirname(at), recursive=True)
        whole = f"{at}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(whole) as f:
            f.write(json.dumps({"name": name, "files": [{"path": p, "rows": n, "bytes": b} for p, n, b in files]}).encode())
        system.move(whole, at)

    def drop(self, messages: list[Sealed | None]) -> None:
        system, root = _system(self.folder)
        for path, *_ in (f for m in messages if m for f in m.files):
            if system.get_file_info(f"{root}/{path}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/{path}")


class JobWriter(Writer, DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        Writer.__init__(self, options, schema)
        self.job = options.get("job") or uuid.uuid4().hex

    def commit(self, messages: list[Sealed | None]) -> None:
        self.seal_job(messages, f"job-{self.job}")

    def abort(self, messages: list[Sealed | None]) -> None:
        self.drop(messages)


class StreamWriter(Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Sealed | None], batchId: int) -> None:
        self.seal_job(messages, f"batch-{batchId:012d}")

    def abort(self, messages: list[Sealed | None], batchId: int) -> None:
        self.drop(messages)


class SegmentSink(DataSource):
    """Options: path, table, template, segment_bytes, segment_seconds, and job, a name by which a repeated batch job is known."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def writer(self, schema: StructType, overwrite: bool) -> JobWriter:
        if overwrite:
            raise ValueError("segments are only added")
        return JobWriter(dict(self.options), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options), schema)


def sealed_files(folder: str, table: str) -> list[dict]:
    """path, rows and bytes of the segments that count."""
    system, root = _system(folder)
    out = []
    for info in sorted(system.get_file_info(fs.FileSelector(f"{root}/{table}/_manifests", allow_not_found=True)), key=lambda i: i.path):
        if info.path.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                out += json.loads(f.read())["files"]
    return out


def read(spark: SparkSession, folder: str, table: str, schema: StructType) -> DataFrame:
    """The rows of the segments that count."""
    paths = [f"{folder}/{f['path']}" for f in sealed_files(folder, table)]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)
