"""Directions along a query from windows, cells and chains: blocks, bridged gaps, audits and clipped ends, as joins and windows.

Cells are disjoint (pair_id, begin, end, mask) as from ``intervals.sweep``: bit 1 speaks for ``+``, bit 2 for ``-``, bit 4
for neither. Evidence is (pair_id, strand, begin, end), stretches of the query with exact matches of one strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scoring
from strandline.operators import intervals

#: A gap between two stretches of one direction is bridged up to this length.
LONGEST_GAP = 20_000


def own_bit(strand: Column) -> Column:
    return F.when(strand == "+", F.lit(1)).otherwise(F.lit(2))


def overlap_length(rows: DataFrame, others: DataFrame, name: str, condition: Column | None = None, begin: str = "begin", end: str = "end") -> DataFrame:
    """The rows with ``name``: how much of their interval the intervals of ``others`` (pair_id, o_begin, o_end, ...) that meet the condition
    cover, counting each of those by itself. Rows are told apart by ``row_id``."""
    met = intervals.binned_join(rows, others, ["pair_id"], F.lit(True) if condition is None else condition, (begin, end), ("o_begin", "o_end"))
    sums = met.groupBy("row_id").agg(F.sum(F.least("o_end", end) - F.greatest("o_begin", begin)).alias(name))
    return rows.join(sums, "row_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def connected_gaps(endpoints: DataFrame, cells: DataFrame, evidence: DataFrame, unknown: DataFrame, limit: int = LONGEST_GAP, bridge_unknown: bool = False) -> DataFrame:
    """(pair_id, begin, end, strand, accepted, reason): the gaps between neighbouring endpoints (pair_id, begin, end, strand) of one direction.

    A gap no longer than ``limit`` and without unknown bases (pair_id, begin, end) is accepted if cells that speak for its direction alone
    cover all of it. With ``bridge_unknown`` it is also accepted if no cell in it speaks for anything else and no evidence of the other strand
    lies in it. Endpoints are disjoint; accepted gaps never count as endpoints of others.
    """
    order = Window.partitionBy("pair_id").orderBy("begin")
    after = endpoints.select("*", F.lead("begin").over(order).alias("n_begin"), F.lead("strand").over(order).alias("n_strand"))
    gaps = after.where((F.col("strand") == F.col("n_strand")) & (F.col("end") < F.col("n_begin"))).select("pair_id", F.col("end").alias("begin"), F.col("n_begin").alias("end"), "strand")
    gaps = gaps.withColumn("row_id", F.struct("pair_id", "begin"))
    ranged = lambda df, *more: df.select("pair_id", F.col("begin").alias("o_begin"), F.col("end").alias("o_end"), *more)
    bit = own_bit(F.col("strand"))
    gaps = overlap_length(gaps, ranged(unknown), "n_bases")
    gaps = overlap_length(gaps, ranged(cells, "mask"), "pure", F.col("mask") == bit)
    gaps = overlap_length(gaps, ranged(cells, "mask"), "veto", F.col("mask").bitwiseAND(F.bitwise_not(bit)) != 0)
    gaps = overlap_length(gaps, ranged(evidence, F.col("strand").alias("o_strand")), "opposite", F.col("o_strand") != F.col("strand"))
    n = F.col("end") - F.col("begin")
    reason = F.when(n > limit, "gap_too_long").when(F.col("n_bases") > 0, "contains_N").when(F.col("pure") == n, "continuous_window_gap")
    if bridge_unknown:
        reason = reason.when(F.col("veto") > 0, "conflicting_or_uncovered_window").when(F.col("opposite") > 0, "opposite_exact_evidence").otherwise("same_direction_unknown_gap")
    else:
        reason = reason.otherwise("conflicting_or_uncovered_window")
    judged = gaps.withColumn("reason", reason)
    return judged.select("pair_id", "begin", "end", "strand", F.col("reason").isin("continuous_window_gap", "same_direction_unknown_gap").alias("accepted"), "reason")


def block_audit(blocks: DataFrame, anchors: DataFrame, cells: DataFrame, limit: int = LONGEST_GAP, every_gap: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cuts, known) of blocks (pair_id, block_id, strand, begin, end) with anchors (pair_id, block_id, begin, end) in order along the query.

    In a gap longer than ``limit`` between two anchors of a block (in any gap, with ``every_gap``) what cells of the opposite direction alone cover is
    cut out: cuts (pair_id, block_id, strand, begin, end, gap_begin, gap_end), touching ones made one. known (pair_id, block_id, strand, begin, end)
    is what is left of the blocks.
    """
    order = Window.partitionBy("pair_id", "block_id").orderBy("begin")
    gaps = anchors.select("pair_id", "block_id", F.col("end").alias("gap_begin"), F.lead("begin").over(order).alias("gap_end")).where(F.col("gap_end") - F.col("gap_begin") > (0 if every_gap else limit))
    gaps = gaps.join(blocks.select("pair_id", "block_id", "strand"), ["pair_id", "block_id"])
    pure = cells.select("pair_id", F.col("begin").alias("c_begin"), F.col("end").alias("c_end"), "mask")
    met = intervals.binned_join(gaps, pure, ["pair_id"], F.col("mask") == F.lit(3) - own_bit(F.col("strand")), ("gap_begin", "gap_end"), ("c_begin", "c_end"))
    pieces = met.select("pair_id", "block_id", "strand", "gap_begin", "gap_end", F.greatest("gap_begin", "c_begin").alias("begin"), F.least("gap_end", "c_end").alias("end"))
    cuts = intervals.union(pieces, ["pair_id", "block_id", "strand", "gap_begin", "gap_end"]).select("pair_id", "block_id", "strand", "begin", "end", "gap_begin", "gap_end")
    # A block less its cuts: from each cut's end (or the block's begin) to the next cut's begin (or the block's end).
    own = Window.partitionBy("pair_id", "block_id", "strand").orderBy("begin", "end")
    edges = cuts.select("pair_id", "block_id", "strand", "begin", "end")
    whole = blocks.where("begin < end")
    edges = edges.union(whole.select("pair_id", "block_id", "strand", F.col("begin"), F.col("begin").alias("end"))).union(whole.select("pair_id", "block_id", "strand", F.col("end").alias("begin"), F.col("end")))
    known = edges.select("pair_id", "block_id", "strand", F.col("end").alias("begin"), F.lead("begin").over(own).alias("next")).where("next > begin")
    return cuts, known.withColumnRenamed("next", "end")


def initial_blocks(chains: DataFrame, extents: DataFrame) -> DataFrame:
    """The blocks of each pair by the chains of both strands (pair_id, strand, rb, qb, len; no overlaps within a chain) and extents (pair_id, reference_length, query_length).

    The strand with more bases is the background (``+`` if equal). Each of its anchors is a block, and so is what lies between
    two of them or before and behind: its direction is that with more bases of anchors inside it on both sequences, and if both
    have as many it is tentative and the background's. Columns: pair_id, block_id, skeleton, tentative, inversion_candidate, strand,
    rb, re, qb, qe, forward_support, reverse_support. Blocks are numbered along the reference from 1.
    """
    sums = chains.groupBy("pair_id").agg(*[F.sum(F.when(F.col("strand") == s, F.col("len")).otherwise(0)).alias(n) for s, n in (("+", "f"), ("-", "r"))])
    whole = extents.join(sums, "pair_id", "left").fillna(0, ["f", "r"]).withColumn("background", F.when(F.col("r") > F.col("f"), "-").otherwise("+")).drop("f", "r")
    oriented = F.when(F.col("strand") == "+", F.col("qb")).otherwise(F.col("query_length") - F.col("qb") - F.col("len"))
    placed = chains.join(whole, "pair_id").withColumn("u", oriented)
    backbone = placed.where("strand = background").select("pair_id", "rb", (F.col("rb") + F.col("len")).alias("re"), "u", (F.col("u") + F.col("len")).alias("ue"))
    # A zero-length anchor at either end of the pair, so that every gap lies between two.
    ends = whole.select("pair_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("u"), F.lit(-1).alias("side")), F.struct(F.col("reference_length").alias("r"), F.col("query_length").alias("u"), F.lit(1).alias("side")))).alias("x"))
    spots = backbone.withColumn("side", F.lit(0)).unionByName(ends.select("pair_id", F.col("x.r").alias("rb"), F.col("x.r").alias("re"), F.col("x.u").alias("u"), F.col("x.u").alias("ue"), "x.side"))
    along = Window.partitionBy("pair_id").orderBy("rb", "side", "re")
    gaps = spots.select("pair_id", F.col("re").alias("rb"), F.lead("rb").over(along).alias("re"), F.col("ue").alias("u"), F.lead("u").over(along).alias("ue"), F.col("side").alias("left"), F.lead("side").over(along).alias("right"))
    gaps = gaps.where("re is not null and (re > rb or ue > u)").withColumn("inner", (F.col("left") == 0) & (F.col("right") == 0)).drop("left", "right")
    blocks = backbone.withColumn("skeleton", F.lit(True)).withColumn("inner", F.lit(False)).unionByName(gaps.withColumn("skeleton", F.lit(False)))
    blocks = blocks.join(whole, "pair_id")
    turned = F.col("background") == "-"
    blocks = blocks.select("pair_id", "background", "skeleton", "inner", "rb", "re", F.when(turned, F.col("query_length") - F.col("ue")).otherwise(F.col("u")).alias("qb"), F.when(turned, F.col("query_length") - F.col("u")).otherwise(F.col("ue")).alias("qe"))
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("rb", "re", F.when(turned, -F.col("qb")).otherwise(F.col("qb"))))
    blocks = blocks.withColumn("block_id", number.cast("long"))
    # What an anchor has inside a gap block, on both sequences: its diagonal cut to the block.
    anchor = chains.select("pair_id", F.col("strand").alias("a_strand"), F.col("rb").alias("a_rb"), (F.col("rb") + F.col("len")).alias("a_re"), F.col("qb").alias("a_qb"), (F.col("qb") + F.col("len")).alias("a_qe"))
    met = intervals.binned_join(blocks.where("not skeleton"), anchor, ["pair_id"], F.lit(True), ("rb", "re"), ("a_rb", "a_re"))
    front = F.greatest(F.col("rb") - F.col("a_rb"), F.when(F.col("a_strand") == "+", F.col("qb") - F.col("a_qb")).otherwise(F.col("a_qe") - F.col("qe")), F.lit(0))
    back = F.greatest(F.col("a_re") - F.col("re"), F.when(F.col("a_strand") == "+", F.col("a_qe") - F.col("qe")).otherwise(F.col("qb") - F.col("a_qb")), F.lit(0))
    inside = met.withColumn("n", F.greatest(F.col("a_re") - F.col("a_rb") - front - back, F.lit(0)))
    support = inside.groupBy("pair_id", "block_id").agg(*[F.sum(F.when(F.col("a_strand") == s, F.col("n")).otherwise(0)).alias(name) for s, name in (("+", "f"), ("-", "r"))])
    judged = blocks.join(support, ["pair_id", "block_id"], "left").fillna(0, ["f", "r"])
    own = lambda s: F.when(F.col("skeleton"), F.when(F.col("background") == s, F.col("re") - F.col("rb")).otherwise(0))
    judged = judged.withColumn("forward_support", own("+").otherwise(F.col("f"))).withColumn("reverse_support", own("-").otherwise(F.col("r")))
    tied = ~F.col("skeleton") & (F.col("forward_support") == F.col("reverse_support"))
    strand = F.when(F.col("skeleton") | tied, F.col("background")).when(F.col("reverse_support") > F.col("forward_support"), "-").otherwise("+")
    judged = judged.withColumn("tentative", tied).withColumn("strand", strand).withColumn("inversion_candidate", F.col("inner") & (F.col("strand") != F.col("background")))
    return judged.select("pair_id", "block_id", "skeleton", "tentative", "inversion_candidate", "strand", "rb", "re", "qb", "qe", "forward_support", "reverse_support")


def end_clips(anchors: DataFrame) -> DataFrame:
    """(pair_id, strand, anchor_id, end, trim, witness): how much of an anchor's ``front`` or ``back`` has to go so that it fits a neighbour that it partly overlaps.

    anchors: (pair_id, strand, anchor_id, rb, ub, len, weight) with ub on the oriented query. Neighbours begin and end later than the anchor on
    both axes; what is trimmed is less than half of the shorter one, the gap left is smaller than either weight after the trim, and the step costs less than either.
    The least trim counts, then the least cost, then the smallest neighbour.
    """
    side = lambda p: anchors.select("pair_id", "strand", *[F.col(c).alias(f"{p}_{c}") for c in ("anchor_id", "rb", "ub", "len", "weight")], (F.col("rb") + F.col("len")).alias(f"{p}_re"), (F.col("ub") + F.col("len")).alias(f"{p}_ue"))
    later = (F.col("a_rb") < F.col("b_rb")) & (F.col("a_ub") < F.col("b_ub")) & (F.col("a_re") < F.col("b_re")) & (F.col("a_ue") < F.col("b_ue"))
    keys = ["pair_id", "strand"]
    # They overlap on the reference or else on the query.
    by_ref = intervals.binned_join(side("a"), side("b"), keys, later, ("a_rb", "a_re"), ("b_rb", "b_re"))
    apart = (F.col("a_re") <= F.col("b_rb"))
    by_query = intervals.binned_join(side("a"), side("b"), keys, later & apart, ("a_ub", "a_ue"), ("b_ub", "b_ue"))
    pairs = by_ref.unionByName(by_query)
    trim = F.greatest(F.col("a_re") - F.col("b_rb"), F.col("a_ue") - F.col("b_ub"))
    pairs = pairs.withColumn("trim", trim).where(2 * F.col("trim") < F.least("a_len", "b_len"))
    delta = F.abs((F.col("b_rb") - F.col("a_rb")) - (F.col("b_ub") - F.col("a_ub")))
    cost = scoring.discordance(F.col("b_rb") - F.col("a_rb"), F.col("b_ub") - F.col("a_ub"))
    gap = F.greatest(F.col("b_rb") - F.col("a_re"), F.col("b_ub") - F.col("a_ue")) + F.col("trim")
    pairs = pairs.withColumn("delta", delta).withColumn("cost", cost).withColumn("gap", gap)
    out = None
    for own, other, end in (("a", "b", "back"), ("b", "a", "front")):
        left = F.col(f"{own}_weight") * ((F.col(f"{own}_len") - F.col("trim")) / F.col(f"{own}_len"))
        least = F.least(left, F.col(f"{other}_weight"))
        fits = pairs.where(((F.col("gap") == 0) | (F.col("gap") < least)) & ((F.col("delta") == 0) | (F.col("cost") < least)))
        best = fits.groupBy(*keys, F.col(f"{own}_anchor_id").alias("anchor_id")).agg(F.min(F.struct("trim", "cost", F.col(f"{other}_anchor_id").alias("witness"))).alias("x"))
        rows = best.select(*keys, "anchor_id", F.lit(end).alias("end"), "x.trim", "x.witness")
        out = rows if out is None else out.unionByName(rows)
    return out


def flank_windows(regions: DataFrame, anchors: DataFrame, extents: DataFrame) -> DataFrame:
    """(pair_id, region_id, reference_begin, reference_end): which part of the reference a region's anchors are searched in.

    It is all of it, but for a reverse region between two forward ones: that is searched between the last anchor of the one and the first of the
    other if that stretch is as long as the region or longer and one of the region's own anchors lies partly outside it.
    regions: (pair_id, region_id, query_begin, query_end, strand); anchors: (pair_id, region_id, reference_begin, reference_end), extents: (pair_id, reference_length).
    """
    ends = anchors.groupBy("pair_id", "region_id").agg(F.min("reference_begin").alias("first"), F.min("reference_begin").alias("low"), F.max("reference_end").alias("high"), F.max_by("reference_end", "reference_begin").alias("last"))
    order = Window.partitionBy("pair_id").orderBy("query_begin")
    rows = regions.join(ends, ["pair_id", "region_id"], "left")
    rows = rows.select("*", F.lag("strand").over(order).alias("l_strand"), F.lead("strand").over(order).alias("r_strand"), F.lag("last").over(order).alias("begin"), F.lead("first").over(order).alias("end"))
    between = (F.col("strand") == "-") & (F.col("l_strand") == "+") & (F.col("r_strand") == "+")
    escapes = (F.col("low") < F.col("begin")) | (F.col("high") > F.col("end"))
    inside = F.coalesce(between & (F.col("begin") < F.col("end")) & (F.col("end") - F.col("begin") >= F.col("query_end") - F.col("query_begin")) & escapes, F.lit(False))
    out = rows.join(extents.select("pair_id", "reference_length"), "pair_id")
    return out.select("pair_id", "region_id", F.when(inside, F.col("begin")).otherwise(F.lit(0)).cast("long").alias("reference_begin"), F.when(inside, F.col("end")).otherwise(F.col("reference_length")).cast("long").alias("reference_end"))


def region_overlaps(anchors: DataFrame) -> DataFrame:
    """(pair_id, left_id, right_id, begin, end): stretches of the reference that the anchors of two regions of a pair both cover."""
    cover = intervals.union(anchors.select("pair_id", "region_id", F.col("reference_begin").alias("begin"), F.col("reference_end").alias("end")), ["pair_id", "region_id"])
    named = cover.select("pair_id", F.col("region_id").alias("id"), "begin", "end")
    return intervals.self_overlaps(named, ["pair_id"])


def refreshed(anchors: DataFrame, windows: DataFrame, replacements: DataFrame) -> DataFrame:
    """The anchors (pair_id, region_id, reference_begin, reference_end, query_begin, query_end, strand) outside the ``windows`` (pair_id, region_id, query_begin, query_end) together with
    the replacements, numbered anew: anchor_id along the pair by region and place, chain_index along the reference within a region."""
    w = windows.select("pair_id", "region_id", F.col("query_begin").alias("w_begin"), F.col("query_end").alias("w_end"))
    marked = anchors.withColumn("row", F.struct("reference_begin", "query_begin", "strand"))
    gone = intervals.binned_join(marked.select("pair_id", "region_id", "row", "query_begin", "query_end"), w, ["pair_id", "region_id"], (F.col("query_begin") >= F.col("w_begin")) & (F.col("query_end") <= F.col("w_end")), ("query_begin", "query_end"), ("w_begin", "w_end"))
    kept = marked.join(gone.select("pair_id", "region_id", "row").distinct(), ["pair_id", "region_id", "row"], "left_anti").select(anchors.columns)
    rows = kept.unionByName(replacements.select(anchors.columns))
    within = Window.partitionBy("pair_id", "region_id").orderBy("reference_begin", "query_begin")
    numbered = rows.withColumn("chain_index", F.row_number().over(within).cast("long"))
    return numbered.withColumn("anchor_id", F.row_number().over(Window.partitionBy("pair_id").orderBy("region_id", "chain_index")).cast("long"))
