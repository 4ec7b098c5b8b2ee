"""The workflow for repeat-rich pairs: matches of both strands, orientation, directed anchors, stitched segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.errors import InputError
from strandline.operators import centromere, copies, intervals, orientation


@dataclass
class Centromere:
    """What a run finds, each as a table."""

    matches: DataFrame
    labels: DataFrame
    regions: DataFrame
    anchors: DataFrame
    unanchored: DataFrame
    copy_jobs: DataFrame
    gaps: DataFrame
    segments: DataFrame
    summary: DataFrame


def check_directions(directions: DataFrame) -> None:
    """An InputError if given regions (pair_id, query_begin, query_end, strand) are empty, without direction, or overlap."""
    if directions.where("not (query_begin >= 0 and query_begin < query_end and strand in ('+', '-'))").limit(1).count():
        raise InputError("a region is empty or has no direction")
    if intervals.overlap_violations(directions, ["pair_id"], "query_begin", "query_end").limit(1).count():
        raise InputError("regions overlap")


def align_whole(reference: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """One forward end-to-end record of each pair of (seq_id, bases): anchors over the whole of it, and every gap by the control kernel."""
    matches = centromere.rare_matches(reference, queries, k, strands="+")
    whole = queries.select(F.col("seq_id").alias("pair_id"), F.lit(1).cast("long").alias("region_id"), F.lit(0).cast("long").alias("query_begin"), F.length("bases").cast("long").alias("query_end"), F.lit("+").alias("strand"))
    return centromere.whole_pairs(centromere.directed_anchors(matches, whole), reference, queries)


def align_centromere(reference: DataFrame, queries: DataFrame, directions: DataFrame | None = None, k: int = 20, window: int = centromere.WINDOW, step: int = centromere.STEP) -> Centromere:
    """Align the pairs of (seq_id, bases) that have equal ids; ``directions`` replaces the orientation plan."""
    matches = centromere.rare_matches(reference, queries, k).persist()
    extents = queries.select(F.col("seq_id").alias("pair_id"), F.length("bases").cast("long").alias("length"))
    labels = centromere.window_labels(matches, extents, window, step)
    if directions is None:
        regions = centromere.regions(labels, matches)
    else:
        check_directions(directions)
        regions = directions
    regions = regions.persist()
    both = extents.withColumnRenamed("length", "query_length").join(reference.select(F.col("seq_id").alias("pair_id"), F.length("bases").cast("long").alias("reference_length")), "pair_id")
    free = centromere.directed_anchors(matches, regions)
    # A reverse region between forward ones is searched between their anchors if its own reach beyond them.
    windows = orientation.flank_windows(regions, free, both)
    anchors = centromere.directed_anchors(matches, regions, windows).persist()
    plain = centromere.numbered(anchors).select("pair_id", "anchor_id", F.col("reference_begin").alias("rb"), F.col("query_begin").alias("qb"), F.col("length").alias("len"), "strand")
    segments, gaps = centromere.stitch(anchors, reference, queries)
    segments = segments.persist()
    totals = segments.groupBy("pair_id").agg(F.count("*").alias("segments"), F.sum("matches").alias("matches"), F.sum("edits").alias("edits"), F.sum("score").alias("score"))
    left = gaps.groupBy("pair_id").agg(F.count("*").alias("gaps"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))
    summary = both.join(totals, "pair_id", "left").join(left, "pair_id", "left").fillna(0)
    summary = summary.withColumn("complete", F.col("unresolved") == 0)
    return Centromere(matches, labels, regions, anchors, centromere.unanchored(anchors, regions, extents), copies.jobs(plain, both), gaps, segments, summary)
