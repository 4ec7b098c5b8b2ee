"""Costs and weights as columns, and the fixed scores that kernels use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The substitution matrix over A, C, G, T, N and the affine gap of the genome workflow.
HOXD = ((9, -11, -3, -12, -10), (-11, 10, -13, -3, -10), (-3, -13, 10, -11, -10), (-12, -3, -11, 9, -10), (-10, -10, -10, -10, -10))
GAP_OPEN, GAP_EXTEND = 40, 3
# The three-piece gap of the centromere workflow (open, extend), its match and mismatch.
PIECES = ((60, 30), (800, 5), (2500, 1))
MATCH, MISMATCH = 20, 80
# The two-piece control.
CONTROL_PIECES = ((4, 2), (12, 1))
CONTROL_MISMATCH = 3


def affine_gap(n: Column) -> Column:
    """Cost of a gap of n bases; 0 for none."""
    return F.when(n > 0, n * GAP_EXTEND + GAP_OPEN).otherwise(F.lit(0))


def three_piece_gap(n: Column) -> Column:
    return F.when(n > 0, F.least(*[n * e + o for o, e in PIECES])).otherwise(F.lit(0))


def two_piece_gap(n: Column) -> Column:
    return F.when(n > 0, F.least(*[n * e + o for o, e in CONTROL_PIECES])).otherwise(F.lit(0))


def rarity_weight(length: Column, reference_count: Column, query_count: Column) -> Column:
    """Length over the geometric mean of the occurrences."""
    return length / F.sqrt((reference_count * query_count).cast("double"))


def discordance(dr: Column, dq: Column) -> Column:
    """Twice the binary logarithm of one more than the difference of two steps."""
    return 2 * F.log2((F.abs(dr - dq) + 1).cast("double"))


def automatic_band(reference: Column, query: Column) -> Column:
    """The band an alignment of these lengths is estimated to need."""
    return F.lit(200) + F.floor((reference + F.floor(query / 2)) * F.lit(0.1)).cast("long")


def stitched_score(cigar: Column) -> Column:
    """Score of a CIGAR under the three-piece gap; a run of I then D is two gaps, neighbours of the same operation are one."""
    state = F.struct(F.lit(0).cast("long").alias("score"), F.lit("").alias("op"), F.lit(0).cast("long").alias("gap"))

    def step(s: Column, c: Column) -> Column:
        gap = (c["op"] == "I") | (c["op"] == "D")
        same = gap & (c["op"] == s["op"])
        closed = s["score"] - F.when(same, F.lit(0)).otherwise(three_piece_gap(s["gap"]))
        value = F.when(c["op"] == "=", c["len"] * MATCH).when(c["op"] == "X", -c["len"] * MISMATCH).otherwise(F.lit(0))
        return F.struct((closed + value).cast("long").alias("score"), F.when(gap, c["op"]).otherwise(F.lit("")).alias("op"), F.when(same, s["gap"] + c["len"]).when(gap, c["len"]).otherwise(F.lit(0)).cast("long").alias("gap"))

    return F.aggregate(cigar, state, step, lambda s: (s["score"] - three_piece_gap(s["gap"])).cast("long"))
