"""Region and list files: BED, direction tables, and lists of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.errors import InputError
from strandline.operators import intervals

#: The two headers a direction table may have.
DIRECTION_HEADERS = ("block_id\tquery_begin\tquery_end\tstrand", "region_id\tsource_line\tquery_begin\tquery_end\tstrand")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("at", F.monotonically_increasing_id())


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, begin, end, name) of a BED; blank lines, comments, ``track`` and ``browser`` lines are passed over. An InputError if a
    line has fewer than three columns or no stretch, or if stretches of a contig overlap."""
    line = F.regexp_replace("value", "^﻿", "")
    rows = _numbered(spark, path).select(line.alias("value")).where("trim(value) <> '' and not value rlike '^(#|track|browser)'")
    f = F.split("value", "\t")
    parsed = rows.select(f[0].alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("begin"), F.get(f, F.lit(2)).try_cast("long").alias("end"), F.get(f, F.lit(3)).alias("name"))
    if parsed.where("not coalesce(begin >= 0 and begin < end, false)").limit(1).count():
        raise InputError(f"{path}: a line has no contig, begin and end")
    if intervals.overlap_violations(parsed, ["contig"]).limit(1).count():
        raise InputError(f"{path}: regions overlap")
    return parsed


def check_bounds(regions: DataFrame, sequences: DataFrame) -> None:
    """An InputError if a region's contig is none of (name, length) or ends before it does."""
    known = regions.join(sequences.select(F.col("name").alias("contig"), "length"), "contig", "left")
    if known.where("length is null or end > length").limit(1).count():
        raise InputError("a region is of no known contig or ends behind it")


def read_directions(spark: SparkSession, path: str) -> DataFrame:
    """(region_id, query_begin, query_end, strand) of a direction table with either header; an InputError if regions are malformed or overlap."""
    rows = _numbered(spark, path)
    head = rows.orderBy("at").select("value").first()
    if head is None or head[0].rstrip("\r") not in DIRECTION_HEADERS:
        raise InputError(f"{path}: unknown header")
    skip = 0 if head[0].startswith("block_id") else 1
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    body = rows.where(F.col("value") != head[0]).where("value <> ''")
    number = lambda k: F.get(f, F.lit(k)).try_cast("long")
    parsed = body.select(number(0).alias("region_id"), number(1 + skip).alias("query_begin"), number(2 + skip).alias("query_end"), F.get(f, F.lit(3 + skip)).alias("strand"))
    if parsed.where("not coalesce(region_id is not null and query_begin >= 0 and query_begin < query_end and strand in ('+', '-'), false)").limit(1).count():
        raise InputError(f"{path}: a region is malformed")
    if intervals.overlap_violations(parsed.withColumn("all", F.lit(0)), ["all"], "query_begin", "query_end").limit(1).count():
        raise InputError(f"{path}: regions overlap")
    return parsed


def read_query_list(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, path) of a list of queries, in order: a name, white space, a path that may hold spaces. Blank and ``#`` lines
    are passed over; relative paths are relative to the list. An InputError if a name occurs twice or a line has no path."""
    lines = [r[0].strip() for r in _numbered(spark, path).orderBy("at").select("value").collect()]
    folder = path.rpartition("/")[0]
    out: list[tuple[str, str]] = []
    for line in lines:
        if not line or line.startswith("#"):
            continue
        parts = line.split(None, 1)
        name, place = parts[0], parts[1] if len(parts) > 1 else ""
        if not place:
            raise InputError(f"{path}: {name} has no path")
        out.append((name, place if place.startswith("/") or ":" in place.split("/")[0] else f"{folder}/{place}" if folder else place))
    if len({n for n, _ in out}) < len(out):
        raise InputError(f"{path}: a name occurs twice")
    return out
