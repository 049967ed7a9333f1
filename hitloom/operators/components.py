"""Connected components of a graph of 64-bit nodes, by labels that fall and jump."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which executors must share; where that is unset and all runs on one machine (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='hitloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder there, which is deleted when the application's JVM ends."""
    at = f"{shared_folder(spark)}/hitloom-{kind}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node connected with it, for edges (a, b); repeated edges and loops do no harm.

    Each round gives a node the least label among its neighbours', then its label's label; labels only fall, so it ends, after
    about the logarithm of the longest path. Rows of an edge are spread by its far end; what a hub receives is a partial minimum.
    """
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settled(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        fallen = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        label = settled(fallen.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        changed = not label.where("was <> comp").isEmpty()
        label = label.drop("was")
        if not changed:
            return label
