"""Helpers that several operators share: checkpoints, hashing in SQL, components of a graph."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own if that is unset, which only a local session can use."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="strandline-"))
    return configured or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder now and go on from there.

    What only ``df`` needed (its shuffles, and checkpoints that nothing refers to any more) is then free to go: Spark
    removes it once the driver's JVM has collected its garbage, which is asked for here, as a chain of steps would
    otherwise fill the executors' disks before it happens by itself.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``cut``, for large tables: written as compressed Parquet to the shared folder. Its path too, for ``removed`` once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Steps made in here give Python ``n`` rows at once at most. Rows of whole texts are held several times over, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= n:
        spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def removed(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text, in order, without empty strings; null text has none."""
    spaced = F.coalesce(text, F.lit(""))
    return F.filter(F.split(spaced, SEPARATOR), lambda w: w != "")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of undirected edges: (node, component), the least node of each component.

    Alternates large-star and small-star steps, which take a number of rounds that grows with the
    logarithm of a component's size; the edges never outgrow their first count by more than the nodes.
    Nodes without edges don't appear; self loops and repeated edges do no harm.
    """
    edges = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    edges, seen = cut(edges), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    own = edges.groupBy("u").agg(F.min("v").alias("component"))
    return own.select(F.col("u").alias("node"), "component").union(own.select(F.col("component").alias("node"), "component").distinct())
