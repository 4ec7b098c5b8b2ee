import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import cigar, kernels, scoring, sequence


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cigar_fixture(spark):
    c = cigar.parsed(F.lit("5=2I3=1D4="))
    assert one(spark, cigar.deltas(c)) == [-6, -1, 4, 0]
    assert [tuple(b) for b in one(spark, cigar.chain_blocks(c))] == [(5, 0, 2), (3, 1, 0), (4, 0, 0)]
    assert [one(spark, f(c)) for f in (cigar.reference_length, cigar.query_length, cigar.matches, cigar.edits)] == [13, 14, 12, 3]
    assert one(spark, cigar.to_string(c)) == "5=2I3=1D4="
    assert one(spark, cigar.to_string(cigar.parsed(F.lit("*")))) == "*"


def test_sam_clips_and_long_operations(spark):
    c = cigar.parsed(F.lit("7="))
    assert one(spark, cigar.sam_cigar(c, F.lit(2), F.lit(9), F.lit(12), F.lit("-"))) == "3H7=2H"
    assert one(spark, cigar.sam_cigar(c, F.lit(2), F.lit(9), F.lit(12), F.lit("+"))) == "2H7=3H"
    assert one(spark, cigar.to_string(cigar.split_long(cigar.parsed(F.lit("25=")), 10))) == "10=10=5="
    assert one(spark, cigar.to_string(cigar.merged(cigar.parsed(F.lit("2=0I3=1D"))))) == "5=1D"


@pytest.mark.parametrize("n, three, affine", [(1, 90, 43), (29, 930, 127), (30, 950, 130), (425, 2925, 1315), (1000, 3500, 3040), (0, 0, 0)])
def test_gap_costs(spark, n, three, affine):
    assert one(spark, scoring.three_piece_gap(F.lit(n))) == three
    assert one(spark, scoring.affine_gap(F.lit(n))) == affine


def test_stitched_score_merges_neighbours(spark):
    c = cigar.parsed(F.lit("2=1I1D1X"))
    assert one(spark, scoring.stitched_score(c)) == 40 - 90 - 90 - 80
    assert one(spark, scoring.stitched_score(cigar.merged(cigar.parsed(F.lit("2=1I1I"))))) == 40 - 120


def test_sequence_columns(spark):
    assert one(spark, sequence.normalized(F.lit("acgtnXß"))) == "ACGTNNN"
    assert one(spark, sequence.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert one(spark, sequence.ambiguous(F.lit("ANNA"))) == 2
    assert one(spark, sequence.kmer_code(F.lit("ACGT"))) == 27


def plain_score(a, b, s):
    n, m = len(a), len(b)
    h = [[-(10**9)] * (m + 1) for _ in range(n + 1)]
    h[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                best = [-(10**9)]
                if i and j:
                    x, y = "ACGTN".index(a[i - 1]), "ACGTN".index(b[j - 1])
                    if s.mismatches or (x == y and x < 4):
                        best.append(h[i - 1][j - 1] + s.matrix[x][y])
                best += [h[i - k][j] - s.gap(k) for k in range(1, i + 1)] + [h[i][j - k] - s.gap(k) for k in range(1, j + 1)]
                h[i][j] = max(best)
    return h[n][m]


@pytest.mark.parametrize("scores", [kernels.GENOME, kernels.CENTROMERE, kernels.EXACT_GAPS, kernels.CONTROL])
def test_global_alignment_scores(scores):
    r = random.Random(7)
    for _ in range(40):
        a = "".join(r.choice("ACGT") for _ in range(r.randrange(20)))
        b = list(a)
        for _ in range(r.randrange(4)):
            if b:
                b[r.randrange(len(b))] = r.choice("ACGTN")
        b = "".join(b)[r.randrange(3) :] + "".join(r.choice("ACGT") for _ in range(r.randrange(4)))
        path, score = kernels.global_alignment(a, b, scores)
        assert score == plain_score(a, b, scores)
        assert kernels.spans(path) == (len(a), len(b))
        assert scores.mismatches or all(op != "X" for op, _ in path)


def test_replay_and_tags():
    assert kernels.replay([("M", 80)], "A" * 80, "A" * 80) == ([("=", 80)], 720, 0)
    assert kernels.replay([("M", 1)], "N", "N")[0] == [("X", 1)]
    assert kernels.md_tag([("=", 3), ("X", 1), ("D", 2), ("I", 1), ("=", 2)], "ACGTACGG") == "3T0^AC2"
    assert kernels.gapped([("=", 2), ("I", 1), ("D", 1)], "ACG", "ACT") == ("AC-G", "ACT-")
    with pytest.raises(ValueError):
        kernels.replay([("M", 3)], "AC", "AC")


def test_band_is_as_good_as_all_diagonals(monkeypatch):
    r = random.Random(5)
    pairs = []
    for _ in range(60):
        a = "".join(r.choice("ACGT") for _ in range(r.randrange(1, 120)))
        b = a
        for _ in range(r.randrange(6)):
            at = r.randrange(len(b) + 1)
            b = b[:at] + "".join(r.choice("ACGTN") for _ in range(r.randrange(40))) + b[at + r.randrange(25) :]
        pairs.append((a, b))
    models = (kernels.GENOME, kernels.CENTROMERE, kernels.CONTROL, kernels.EXACT_GAPS)
    monkeypatch.setattr(kernels, "FIRST_BAND", 1)
    narrow = [kernels.global_alignment(a, b, s) for a, b in pairs for s in models]
    monkeypatch.setattr(kernels, "FIRST_BAND", 1000)
    assert narrow == [kernels.global_alignment(a, b, s) for a, b in pairs for s in models]


def test_control_gap():
    assert kernels.control_gap("ACG", "ATG" + "C" * 200) == [("=", 1), ("X", 1), ("=", 1), ("I", 200)]
    assert kernels.control_gap("ACGTACGT", "") == [("D", 8)]
    assert kernels.control_gap("ACGTACGT", "ACGAACGT") == [("=", 3), ("X", 1), ("=", 4)]
