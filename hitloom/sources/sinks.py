"""Readers and writers: queue folders, Parquet, CSV, warehouses over JDBC, table lifecycle."""

from __future__ import annotations

import datetime
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..plans.columns import missing_columns


def read_queue(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json", files_a_trigger: int = 1000) -> DataFrame:
    """A folder of task files as a stream, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("latestFirst", "false").format(fmt).load(path)


def table_path(template: str, name: str, schema: StructType, sealed: datetime.datetime | None = None, segment: str = "", extension: str = "") -> str:
    """{table}, {schema}, {year}, {month}, {day} of the sealing time (UTC), {segment} and {extension} of a path template; the name is escaped."""
    at = sealed or datetime.datetime.now(datetime.UTC)
    return template.format(table=escape_name(name), schema=fingerprint(schema), year=f"{at:%Y}", month=f"{at:%m}", day=f"{at:%d}", segment=segment, extension=extension)


def tap_requests(requests: DataFrame, path: str, checkpoint: str, every: str = "1 minute"):
    """A second sink beside the pipeline: a stream's raw requests as they came, by day."""
    dated = requests.withColumn("day", F.to_date("server_received_time"))
    return dated.writeStream.partitionBy("day").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def segment_rows(df: DataFrame, segment_bytes: int, sample: int = 10_000) -> int:
    """Rows that make a segment of about so many bytes, judged by the JSON size of the first rows."""
    size = df.limit(sample).select(F.avg(F.octet_length(F.to_json(F.struct("*"))))).collect()[0][0]
    return max(1, int(segment_bytes / size)) if size else 1


def in_table_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """df's columns in the table's order; a differing set of columns is an error that lists both sides."""
    missing, more = [c for c in columns if c not in df.columns], [c for c in df.columns if c not in columns]
    if missing or more:
        raise ValueError(f"the rows lack {missing or 'nothing'}, the table lacks {more or 'nothing'}")
    return df.select(*columns)


def escape_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "_", name)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fingerprint(schema: StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()[:16]


def with_partition(df: DataFrame, stamp=None) -> DataFrame:
    """year, month, day of the writing time, not of the events."""
    now = F.current_timestamp() if stamp is None else stamp
    return df.withColumns({"year": F.date_format(now, "yyyy"), "month": F.date_format(now, "MM"), "day": F.date_format(now, "dd")})


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", rows_a_file: int = 5_000_000, partitioned: bool = False) -> None:
    """Segments end at rows_a_file (see segment_rows for a size); in a stream the trigger's interval ends them by age."""
    df = with_partition(df) if partitioned else df
    order = [c for c in ("property_id", "date_utc", "session_id") if c in df.columns]
    df = df.sortWithinPartitions(*order) if order else df
    out = df.write.mode("append").option("compression", codec).option("maxRecordsPerFile", rows_a_file)
    (out.partitionBy("year", "month", "day") if partitioned else out).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without them."""
    nested = lambda t: isinstance(t, ArrayType | MapType | StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if nested(f.dataType) else F.col(quote(f.name)) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    out = flat(df).write.mode("append").option("header", True).option("nullValue", "").option("emptyValue", "")
    (out.option("compression", "gzip") if gzip else out).csv(path)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a warehouse table, columns in the table's own order by name; a differing set of columns is an error."""
    columns = df.sparkSession.read.options(**options).jdbc(url, table).columns
    in_table_order(flat(df), columns).write.mode("append").options(**options).jdbc(url, table)


def write_json(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON, as load jobs take it."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def ensure_table(spark: SparkSession, name: str, schema: StructType, partition_by: tuple[str, ...] = ()) -> list[str]:
    """Create the table, or add what it lacks; never drop or retype. Gives the added columns; a type conflict is an error that lists all."""
    if not spark.catalog.tableExists(name):
        writer = spark.createDataFrame([], schema).write.format("parquet")
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
        return schema.names
    missing, wrong = missing_columns(schema, spark.table(name).schema)
    if wrong:
        raise ValueError(f"table {name}: " + "; ".join(f"{w.name} is {w.found}, not {w.expected}" for w in wrong))
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'{quote(f.name)} {f.dataType.simpleString()}' for f in missing)})")
    return [f.name for f in missing]


def idempotent_writer(path: str, key: str = "id"):
    """foreachBatch function: a batch's folder is overwritten when the batch is repeated, so retries write nothing twice."""

    def write(df: DataFrame, batch: int) -> None:
        df.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
