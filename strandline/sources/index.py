"""A reference index: k-mers with their places, bucketed by hash, and a manifest that ties them to one reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.errors import IndexError_, OutputError
from strandline.functions.sequence import MOST_PACKED, ambiguous, fingerprint, kmers

VERSION = 2


@dataclass
class Index:
    kmers: DataFrame
    manifest: DataFrame
    k: int


def manifest_of(reference: DataFrame, k: int) -> DataFrame:
    return reference.select("seq_id", "name", F.length("bases").cast("long").alias("length"), ambiguous(F.col("bases")).cast("long").alias("ambiguous"), fingerprint(F.col("bases")).alias("fingerprint"), F.lit(k).alias("k"), F.lit(VERSION).alias("version"))


def build(reference: DataFrame, path: str, k: int = 20) -> None:
    """Write the index of (seq_id, name, bases) to ``path``, which mustn't exist: beside it first, read back and checked there, then renamed."""
    spark = reference.sparkSession
    jvm = spark.sparkContext._jvm
    place, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staging")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place):
        raise OutputError(f"{path} exists")
    try:
        made = kmers(reference, k, packed=k <= MOST_PACKED)
        made.repartition("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}.staging/kmers")
        manifest_of(reference, k).write.mode("overwrite").parquet(f"{path}.staging/manifest")
        load(spark, f"{path}.staging", reference)
        if files.exists(place) or not files.rename(staging, place):
            raise OutputError(f"{path} can't be put in place")
    finally:
        files.delete(staging, True)


def load(spark: SparkSession, path: str, reference: DataFrame | None = None) -> Index:
    """The index under ``path``; an error if it isn't whole, of another version, or not of ``reference``."""
    try:
        manifest = spark.read.parquet(f"{path}/manifest")
        found = spark.read.parquet(f"{path}/kmers")
        heads = manifest.select("k", "version").distinct().collect()
    except Exception as e:
        raise IndexError_(f"{path}: no whole index") from e
    if len(heads) != 1 or heads[0]["version"] != VERSION:
        raise IndexError_(f"{path}: not an index of version {VERSION}")
    k = heads[0]["k"]
    if reference is not None:
        own = manifest_of(reference, k)
        if manifest.exceptAll(own).limit(1).count() or own.exceptAll(manifest).limit(1).count():
            raise IndexError_(f"{path}: the index of another reference")
    return Index(found, manifest, k)
