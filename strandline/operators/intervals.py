"""Operators on half-open intervals (key columns, begin, end), all as windows over the keys or binned joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: Sequence[str], begin: str = "begin", end: str = "end", touch: bool = True) -> DataFrame:
    """The rows with ``island``: which stretch of overlapping (or touching) intervals of their keys each belongs to, from 1."""
    order = Window.partitionBy(*keys).orderBy(begin, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(begin) > reach if touch else F.col(begin) >= reach
    fresh = F.when(reach.isNull() | apart, 1).otherwise(0)
    return rows.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def union(rows: DataFrame, keys: Sequence[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """The union of each key's intervals; touching ones are merged."""
    return islands(rows, keys, begin, end).groupBy(*keys, "island").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("island")


def union_length(rows: DataFrame, keys: Sequence[str], begin: str = "begin", end: str = "end") -> DataFrame:
    return union(rows, keys, begin, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(begin)).alias("covered"))


def complement(rows: DataFrame, extents: DataFrame, keys: Sequence[str], begin: str = "begin", end: str = "end", length: str = "length") -> DataFrame:
    """What of [0, length) of each key in ``extents`` no interval covers."""
    merged = union(rows, keys, begin, end)
    edges = F.array(F.lit(0).cast("long"), F.col(length).cast("long"))
    ends = extents.select(*keys, F.explode(edges).alias(begin)).withColumn(end, F.col(begin) + 0)
    order = Window.partitionBy(*keys).orderBy(begin, end)
    marked = merged.select(*keys, begin, end).union(ends).withColumn("_next", F.lead(begin).over(order))
    return marked.where(F.col("_next") > F.col(end)).select(*keys, F.col(end).alias(begin), F.col("_next").alias(end))


def binned_join(left: DataFrame, right: DataFrame, keys: Sequence[str], condition: Column, left_span: tuple[str, str], right_span: tuple[str, str], width: int = 1024) -> DataFrame:
    """An inner join of intervals with equal keys that overlap, as an equi join on bins of ``width``.

    ``left`` and ``right`` have no column in common but the keys. A pair is met in each bin that both reach into and kept
    in the first of those; so long intervals cost their bins, and no task meets all pairs of a key.
    """
    bins = lambda span: F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor((F.col(span[1]) - 1) / width)))
    a = left.where(F.col(left_span[0]) < F.col(left_span[1])).withColumn("_bin", bins(left_span))
    b = right.where(F.col(right_span[0]) < F.col(right_span[1])).withColumn("_bin", bins(right_span))
    joined = a.join(b, [*keys, "_bin"])
    first = F.floor(F.greatest(F.col(left_span[0]), F.col(right_span[0])) / width)
    overlap = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1]))
    return joined.where(overlap & (F.col("_bin") == first) & condition).drop("_bin")


def intersections(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, left_id, right_id, begin, end): overlaps of the rows (keys, id, begin, end) of two tables."""
    a = left.select(*keys, F.col("id").alias("left_id"), F.col("begin").alias("_lb"), F.col("end").alias("_le"))
    b = right.select(*keys, F.col("id").alias("right_id"), F.col("begin").alias("_rb"), F.col("end").alias("_re"))
    joined = binned_join(a, b, keys, F.lit(True), ("_lb", "_le"), ("_rb", "_re"))
    return joined.select(*keys, "left_id", "right_id", F.greatest("_lb", "_rb").alias("begin"), F.least("_le", "_re").alias("end"))


def self_overlaps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlaps of the intervals of one table, each pair once with the smaller id first."""
    return intersections(rows, rows, keys).where("left_id < right_id")


def contained(rows: DataFrame, keys: Sequence[str], begin: str, end: str, strictly: bool = False) -> Column:
    """Whether another row with the same keys contains the row's interval (and, if ``strictly``, isn't equal to it).

    Among rows that begin no later, one that ends no earlier contains it: a running maximum over the order by begin
    and falling end, so no pairs are made.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(begin), F.col(end).desc())
    if strictly:
        # Equal rows are peers: those before the peers begin earlier, or begin here and end later.
        earlier = F.max(end).over(Window.partitionBy(*keys).orderBy(begin).rangeBetween(Window.unboundedPreceding, -1))
        here = F.max(end).over(Window.partitionBy(*keys, begin))
        return F.coalesce(earlier >= F.col(end), F.lit(False)) | (here > F.col(end))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before >= F.col(end), F.lit(False)) | (F.count("*").over(Window.partitionBy(*keys, begin, end)) > 1)


def covered_by(rows: DataFrame, cover: DataFrame, keys: Sequence[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """The rows with ``covered``: whether one interval of ``cover`` (disjoint, as from ``union``) contains theirs.

    The last interval of the cover that begins no later is the only one that can.
    """
    marks = cover.select(*keys, F.col(begin).alias("_at"), F.col(end).alias("_reach"), F.lit(0).alias("_kind"))
    asked = rows.withColumn("_at", F.col(begin)).withColumn("_kind", F.lit(1))
    both = asked.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_reach", True).over(order))
    return seen.where("_kind = 1").withColumn("covered", F.coalesce(F.col("_last") >= F.col(end), F.lit(False))).drop("_at", "_kind", "_reach", "_last")


def sweep(rows: DataFrame, keys: Sequence[str], bit: str = "bit", begin: str = "begin", end: str = "end", bits: int = 3) -> DataFrame:
    """(keys, begin, end, mask): disjoint cells between the ends of intervals that carry one of ``bits`` bits, with the bits present; cells without any are left out, equal neighbours merged."""
    events = rows.select(*keys, F.explode(F.array(F.struct(F.col(begin).alias("at"), F.col(bit).alias("bit"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.col(bit).alias("bit"), F.lit(-1).alias("step")))).alias("e")).select(*keys, "e.*")
    at = events.groupBy(*keys, "at").agg(*[F.sum(F.when(F.col("bit") == b, F.col("step")).otherwise(0)).alias(f"s{b}") for b in range(bits)])
    order = Window.partitionBy(*keys).orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    mask = sum((F.when(F.sum(f"s{b}").over(run) > 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(bits)), F.lit(0))
    cells = at.withColumn("mask", mask).withColumn("end", F.lead("at").over(order)).where("end is not null")
    fresh = cells.withColumn("_new", F.when(F.lag("mask").over(order) == F.col("mask"), 0).otherwise(1)).withColumn("_cell", F.sum("_new").over(run))
    return fresh.groupBy(*keys, "_cell").agg(F.min("at").alias("begin"), F.max("end").alias("end"), F.first("mask").alias("mask")).where("mask > 0").drop("_cell")


def window_starts(extents: DataFrame, keys: Sequence[str], size: int, step: int, length: str = "length") -> DataFrame:
    """(keys, begin, end): windows of ``size`` every ``step``, from the begin and mirrored from the end; one window for a shorter extent."""
    last = F.greatest(F.col(length) - size, F.lit(0))
    forward = F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))
    starts = F.array_distinct(F.concat(forward, F.transform(forward, lambda p: last - p)))
    rows = extents.where(F.col(length) > 0).select(*keys, F.col(length).alias("_n"), F.explode(starts).alias("begin"))
    return rows.select(*keys, "begin", F.least(F.col("begin") + size, F.col("_n")).alias("end"))


def vote(own_count: Column, other_count: Column, own_length: Column, other_length: Column, least: int = 3, ratio: int = 2) -> Column:
    """Whether one side carries a window: at least ``least`` members, and the other no more than a ``ratio``-th by count and length."""
    return (own_count >= least) & (other_count <= F.floor(own_count / ratio)) & (other_length <= F.floor(own_length / ratio))


def label(forward: Column, reverse: Column, forward_length: Column, reverse_length: Column, least: int = 3, ratio: int = 2) -> Column:
    """``+`` or ``-`` for the side that carries the window, ``?`` if enough speaks for one but it doesn't carry it, ``.`` if too little does."""
    return (
        F.when(vote(forward, reverse, forward_length, reverse_length, least, ratio), F.lit("+"))
        .when(vote(reverse, forward, reverse_length, forward_length, least, ratio), F.lit("-"))
        .when((forward >= least) | (reverse >= least), F.lit("?"))
        .otherwise(F.lit("."))
    )


def split_components(rows: DataFrame, keys: Sequence[str], begin: str, end: str, gap: int) -> DataFrame:
    """The rows with ``component``: a new one where a row begins more than ``gap`` behind all before it."""
    order = Window.partitionBy(*keys).orderBy(begin, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(begin) > reach + gap), 1).otherwise(0)
    return rows.withColumn("_fresh", fresh).withColumn("component", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def overlap_violations(rows: DataFrame, keys: Sequence[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """Rows that begin before all earlier ones of their keys have ended: none if the intervals are disjoint."""
    order = Window.partitionBy(*keys).orderBy(begin, end).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max(end).over(order)).where(F.col("_reach") > F.col(begin)).drop("_reach")
