import random

import pytest
from pyspark.sql import functions as F

from strandline.errors import InputError
from strandline.functions import scoring
from strandline.functions.kernels import reverse_complement
from strandline.operators import centromere
from strandline.plans.centromere import align_centromere, align_whole

RANDOM = random.Random(918)
CORE = "".join(RANDOM.choice("ACGT") for _ in range(3000))
OTHER = {"A": "C", "C": "G", "G": "T", "T": "A"}
# A substitution every 150 bases, an insertion and a deletion that can't be moved.
CHANGED = "".join(OTHER[c] if k % 150 == 75 else c for k, c in enumerate(CORE))
GONE = next(k for k in range(2410, 2450) if CORE[k] != CORE[k + 3] and CORE[k - 1] != CORE[k + 2])
EDITED = CHANGED[:1800] + OTHER[CORE[1800]] + OTHER[CORE[1799]] + CHANGED[1800:GONE] + CHANGED[GONE + 3 :]


def frame(spark, bases):
    return spark.createDataFrame([(0, bases)], "seq_id long, bases string")


@pytest.mark.parametrize("strand", ["+", "-"])
def test_stitched_segments(spark, strand):
    query = "N" * 11 + EDITED + "N" * 13
    out = align_centromere(frame(spark, CORE), frame(spark, query if strand == "+" else reverse_complement(query)), window=1000, step=500)
    (row,) = out.segments.collect()
    assert row.strand == strand and (row.rb, row.re) == (0, len(CORE))
    ops = {c.op: 0 for c in row.cigar}
    for c in row.cigar:
        ops[c.op] += c.len
    assert set(ops) == {"=", "X", "I", "D"} and (ops["X"], ops["I"], ops["D"]) == (20, 2, 3)
    assert row.score == ops["="] * 20 - 20 * 80 - (60 + 2 * 30) - (60 + 3 * 30)
    assert out.segments.select(scoring.stitched_score(F.col("cigar")).alias("s")).first()["s"] == row.score
    assert {r.label for r in out.labels.collect()} <= {strand, "."}
    summary = out.summary.first()
    assert summary.complete and summary.segments == 1
    ends = {(r.begin, r.end) for r in out.unanchored.where("status = 'unknown'").collect()}
    assert ends == ({(0, 11), (11 + len(EDITED), len(query))} if strand == "+" else {(0, 13), (13 + len(EDITED), len(query))})


def test_nothing_but_unknown_bases(spark):
    out = align_centromere(frame(spark, "N" * 80), frame(spark, "N" * 93))
    assert out.segments.count() == 0 and out.summary.first().segments == 0


def test_gap_beyond_the_cells_splits_a_segment(spark):
    out = align_centromere(frame(spark, CORE), frame(spark, EDITED), window=1000, step=500)
    segments, gaps = centromere.stitch(out.anchors, frame(spark, CORE), frame(spark, EDITED), most_cells=1)
    broken = gaps.where("status = 'unresolved'").count()
    assert broken and segments.count() == broken + 1


def test_given_directions_are_checked(spark):
    bad = spark.createDataFrame([(0, 1, 0, 10, "+"), (0, 2, 5, 20, "+")], "pair_id long, region_id long, query_begin long, query_end long, strand string")
    with pytest.raises(InputError):
        align_centromere(frame(spark, CORE), frame(spark, EDITED), directions=bad)


def test_later_segments_take_no_room(spark):
    path = lambda n: [("=", n)]
    rows = [(0, 1, "+", 0, 10, path(10)), (0, 2, "-", 5, 30, path(25)), (0, 3, "+", 30, 40, path(10)), (0, 4, "+", 0, 5, path(5))]
    df = spark.createDataFrame(rows, "pair_id long, segment_id long, strand string, qb long, qe long, cigar array<struct<op:string,len:bigint>>")
    assert {r.segment_id: r.flag for r in centromere.disjoint_flags(df).collect()} == {1: 256, 2: 16, 3: 2048, 4: 2048}


def test_whole_pairs(spark):
    row = align_whole(frame(spark, CORE), frame(spark, "AC" * 8 + EDITED)).first()
    ops = {c.op: 0 for c in row.cigar}
    for c in row.cigar:
        ops[c.op] += c.len
    assert ops["="] + ops["X"] + ops["D"] == len(CORE) and ops["="] + ops["X"] + ops["I"] == len(EDITED) + 16
    cost = sum(3 * c.len if c.op == "X" else 0 if c.op == "=" else min(4 + 2 * c.len, 12 + c.len) for c in row.cigar)
    assert row.score == -cost and row.matches == ops["="]
    assert cost <= 20 * 3 + min(4 + 2 * 16, 12 + 16) + 8 + 10
