import random

import pytest

from strandline.operators import copies, orientation

ENDPOINTS = "pair_id long, begin long, end long, strand string"
CELLS = "pair_id long, begin long, end long, mask int"
EVIDENCE = "pair_id long, strand string, begin long, end long"


@pytest.mark.parametrize("bridge", [False, True])
def test_connected_gaps(spark, bridge):
    ends = spark.createDataFrame([(1, b, e, s) for b, e, s in ((0, 10, "+"), (20, 30, "+"), (40, 50, "+"), (60, 70, "+"), (80, 90, "+"), (300, 310, "+"), (310, 320, "-"), (330, 340, "-"))], ENDPOINTS)
    cells = spark.createDataFrame([(1, 10, 15, 1), (1, 15, 20, 1), (1, 30, 35, 1), (1, 52, 55, 3), (1, 320, 330, 2)], CELLS)
    found = spark.createDataFrame([(1, "-", 72, 74), (1, "+", 32, 34)], EVIDENCE)
    unknown = spark.createDataFrame([(1, 325, 326)], "pair_id long, begin long, end long")
    got = {r.begin: (r.end, r.strand, r.accepted, r.reason) for r in orientation.connected_gaps(ends, cells, found, unknown, 100, bridge).collect()}
    veto = (False, "conflicting_or_uncovered_window")
    assert got == {
        10: (20, "+", True, "continuous_window_gap"),
        30: (40, "+", *((True, "same_direction_unknown_gap") if bridge else veto)),
        50: (60, "+", *veto),
        70: (80, "+", *((False, "opposite_exact_evidence") if bridge else veto)),
        90: (300, "+", False, "gap_too_long"),
        320: (330, "-", False, "contains_N"),
    }


def test_block_audit(spark):
    blocks = spark.createDataFrame([(1, 7, "+", 0, 100), (1, 8, "-", 100, 100)], "pair_id long, block_id long, strand string, begin long, end long")
    anchors = spark.createDataFrame([(1, 7, 10, 20), (1, 7, 60, 70), (1, 7, 72, 80)], "pair_id long, block_id long, begin long, end long")
    cells = spark.createDataFrame([(1, 15, 30, 2), (1, 30, 35, 2), (1, 50, 65, 2), (1, 40, 45, 3), (1, 70, 72, 2)], CELLS)
    cuts, known = orientation.block_audit(blocks, anchors, cells, 5)
    assert sorted((r.begin, r.end, r.gap_begin, r.gap_end) for r in cuts.collect()) == [(20, 35, 20, 60), (50, 60, 20, 60)]
    assert sorted((r.block_id, r.begin, r.end) for r in known.collect()) == [(7, 0, 20), (7, 35, 50), (7, 60, 100)]
    every, _ = orientation.block_audit(blocks, anchors, cells, 5, every_gap=True)
    assert every.count() == 3


def test_flank_windows(spark):
    regions = spark.createDataFrame([(1, 1, 0, 10, "+"), (1, 2, 10, 20, "-"), (1, 3, 20, 30, "+"), (1, 4, 30, 40, "-")], "pair_id long, region_id long, query_begin long, query_end long, strand string")
    found = [(1, 1, 0, 5), (1, 2, 90, 95), (1, 3, 40, 50)]
    extents = spark.createDataFrame([(1, 100)], "pair_id long, reference_length long")
    shape = "pair_id long, region_id long, reference_begin long, reference_end long"
    got = {r.region_id: (r.reference_begin, r.reference_end) for r in orientation.flank_windows(regions, spark.createDataFrame(found, shape), extents).collect()}
    assert got == {1: (0, 100), 2: (5, 40), 3: (0, 100), 4: (0, 100)}
    inside = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 10, 15), (1, 3, 40, 50)], shape)
    assert all((r.reference_begin, r.reference_end) == (0, 100) for r in orientation.flank_windows(regions, inside, extents).collect())
    overlaps = orientation.region_overlaps(spark.createDataFrame([(1, 1, 0, 9), (1, 2, 5, 7), (1, 2, 8, 12), (2, 3, 0, 50)], shape)).collect()
    assert sorted((r.left_id, r.right_id, r.begin, r.end) for r in overlaps) == [(1, 2, 5, 7), (1, 2, 8, 9)]


def test_refreshed_anchors(spark):
    shape = "pair_id long, region_id long, reference_begin long, reference_end long, query_begin long, query_end long, strand string"
    rows = spark.createDataFrame([(1, 1, 0, 5, 0, 5, "+"), (1, 1, 10, 15, 10, 15, "+"), (1, 2, 30, 35, 30, 35, "+")], shape)
    windows = spark.createDataFrame([(1, 1, 8, 20)], "pair_id long, region_id long, query_begin long, query_end long")
    new = spark.createDataFrame([(1, 1, 8, 12, 9, 13, "+"), (1, 1, 14, 16, 15, 17, "+")], shape)
    got = sorted((r.anchor_id, r.region_id, r.chain_index, r.reference_begin) for r in orientation.refreshed(rows, windows, new).collect())
    assert got == [(1, 1, 1, 0), (2, 1, 2, 8), (3, 1, 3, 14), (4, 2, 1, 30)]


def test_copy_columns(spark):
    row = spark.createDataFrame([(10, 100, 20, "+", 15, 25, 200), (10, 100, 20, "-", 15, 25, 200), (10, 100, 20, "-", 40, 50, 200)], "b long, o long, n long, s string, lo long, hi long, size long")
    from pyspark.sql import functions as F

    c = F.col
    cut = row.select(copies.clipped(c("b"), c("o"), c("n"), c("s"), c("lo"), c("hi")).alias("x"), copies.counterpart(c("b"), c("o"), c("n"), c("s"), c("lo")).alias("y")).collect()
    assert [(r.x.begin, r.x.other, r.x.len) for r in cut] == [(15, 105, 10), (15, 105, 10), (10, 100, 0)]
    assert [r.y for r in cut[:2]] == [105, 114]
    line = row.select(copies.diagonal(c("b"), c("o"), c("n"), c("s"), c("size")).alias("d")).collect()
    assert [r.d for r in line] == [10 - 100, 10 - 80, 10 - 80]


def test_best_copy_chain_against_all_chains():
    from itertools import combinations
    from math import log2

    r = random.Random(3)
    for _ in range(60):
        rows = sorted((r.randrange(60), r.randrange(60), r.randrange(1, 9), r.choice("+-"), r.choice("+-"), r.randrange(60), r.random() * 9) for _ in range(7))
        axis, n = r.choice(("query", "reference")), 70

        def value(ids):
            total = rows[ids[0]][6]
            for i, j in zip(ids, ids[1:], strict=False):
                a, b = rows[i], rows[j]
                u = [x[1] if x[3] == "+" else n - x[1] - x[2] for x in (a, b)]
                dr, dq, ds = b[0] - a[0] - a[2], u[1] - u[0] - a[2], b[5] - a[5] - a[2]
                if a[3:5] != b[3:5] or min(dr, dq, ds) < 0:
                    return float("-inf")
                total += b[6] - 2 * log2(abs(dr - dq) + 1) - 2 * log2(abs(ds - (dq if axis == "query" else dr)) + 1)
            return total

        path, score = copies.best_copy_chain(rows, n, axis)
        best = max(value(ids) for k in range(1, 8) for ids in combinations(range(7), k))
        assert score == pytest.approx(best) and value(path) == pytest.approx(best)


def test_copies_of_a_repeat(spark):
    r = random.Random(11)
    new = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    a, x, b = new(120), new(80), new(120)
    # The query has x twice; the second one lies in a stretch that no anchor covers.
    reference, query = a + x + b, a + x + x + b
    refs = spark.createDataFrame([(1, reference)], "pair_id long, bases string")
    queries = spark.createDataFrame([(1, query)], "pair_id long, bases string")
    extents = spark.createDataFrame([(1, len(reference), len(query))], "pair_id long, reference_length long, query_length long")
    anchors = spark.createDataFrame([(1, 1, 0, 0, 200, "+"), (1, 2, 200, 280, 120, "+")], "pair_id long, anchor_id long, rb long, qb long, len long, strand string")
    todo = copies.jobs(anchors, extents).persist()
    job = todo.where("not scout").collect()
    assert [(j.axis, j.target_begin, j.target_end, j.source_begin, j.source_end, j.left_id, j.right_id) for j in job] == [("query", 200, 280, 0, 400, 1, 2)]
    from pyspark.sql import functions as F

    found = copies.self_matches(queries, 20).withColumn("axis", F.lit("query"))
    repeats = copies.self_repeats(found, todo, anchors).where("job = 1")
    images = copies.merged(copies.projected(repeats, anchors, extents), extents)
    assert {(i.rb, i.qb, i.len, i.strand) for i in images.collect()} == {(120, 200, 80, "+")}
    assert {s.job: s.status for s in copies.budget(repeats, images, todo).collect()}[1] == "open"
    assert {s.job: s.status for s in copies.budget(repeats, images, todo, local=1).collect()}[1] == "budget_exhausted"
    assert [u.unique for u in copies.unique_flanks(todo, anchors, refs, queries).collect()] == [True]
    chain = copies.chained(images.withColumn("weight", F.col("len").cast("double")), extents).first()
    assert (chain.rb, chain.qb, chain.len, chain.score, chain.runner_up) == (120, 200, 80, 80.0, 0.0)
