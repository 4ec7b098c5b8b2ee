import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals, seeds, select

REVERSE = str.maketrans("ACGT", "TGCA")


def occurrences(text, word):
    return sum(text.startswith(word, i) for i in range(len(text) - len(word) + 1))


def brute_mems(refs, queries, k):
    out = set()
    for i, r in refs:
        for j, q in queries:
            for strand, o in (("+", q), ("-", q[::-1].translate(REVERSE))):
                for a in range(len(r)):
                    for b in range(len(o)):
                        if r[a] != o[b] or "N" in (r[a], o[b]) or (a and b and r[a - 1] == o[b - 1] != "N"):
                            continue
                        n = 0
                        while a + n < len(r) and b + n < len(o) and r[a + n] == o[b + n] != "N":
                            n += 1
                        if n >= k:
                            out.add((i, a, j, b if strand == "+" else len(o) - b - n, n, strand, b))
    return out


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(11)
    refs = [(k, "".join(r.choice("ACGT") for _ in range(60)) + "N" + "ACGTTACGTA" * (k + 1)) for k in range(2)]
    queries = [(k, refs[k % 2][1][10:50] + "".join(r.choice("ACGT") for _ in range(15)) + refs[1][1][20:40][::-1].translate(REVERSE) + "ACGTTACGTA") for k in range(2)]
    frame = lambda rows: spark.createDataFrame(rows, "seq_id long, bases string")
    return refs, queries, frame(refs), frame(queries), 4


def rows_of(df):
    return {tuple(x) for x in df.select("ref_id", "rb", "query_id", "qb", "len", "strand").collect()}


def test_seed_modes_against_direct_definitions(case):
    refs, queries, ref_df, query_df, k = case
    mems = brute_mems(refs, queries, k)
    texts = {j: {"+": q, "-": q[::-1].translate(REVERSE)} for j, q in queries}
    word = lambda m: texts[m[2]][m[5]][m[6] : m[6] + m[4]]
    in_refs = lambda w: sum(occurrences(r, w) for _, r in refs)
    mam = {m for m in mems if in_refs(word(m)) == 1}
    mum = {m for m in mam if occurrences(texts[m[2]][m[5]], word(m)) == 1}
    inside = lambda m, o: (o[2], o[5]) == (m[2], m[5]) and o[6] <= m[6] and o[6] + o[4] >= m[6] + m[4] and o[4] > m[4]
    smem = {m for m in mems if not any(inside(m, o) for o in mems)}
    covered = lambda m: all(any(x[2] == m[2] and x[5] == m[5] and x[3] <= p < x[3] + x[4] for x in mam) for p in range(m[3], m[3] + m[4]))
    fast = mam | {m for m in mems if not covered(m)}
    for mode, expected in (("maxmatch", mems), ("mumreference", mam), ("mum", mum), ("smem", smem), ("fast", fast)):
        assert rows_of(seeds.seeds(ref_df, query_df, mode, k)) == {m[:6] for m in expected}, mode


def test_smem_with_two_occurrences(case):
    refs, queries, ref_df, query_df, k = case
    expected = set()
    for j, q in queries:
        for strand, o in (("+", q), ("-", q[::-1].translate(REVERSE))):
            count = lambda w: sum(occurrences(r, w) for _, r in refs) if "N" not in w else 0
            found = []
            for a in range(len(o)):
                b = a + k
                if b > len(o) or count(o[a:b]) < 2:
                    continue
                while b < len(o) and count(o[a : b + 1]) >= 2:
                    b += 1
                if not any(x <= a and y >= b for x, y in found):
                    found.append((a, b))
            for a, b in found:
                for i, r in refs:
                    for p in range(len(r) - (b - a) + 1):
                        if r.startswith(o[a:b], p):
                            expected.add((i, p, j, a if strand == "+" else len(o) - b, b - a, strand))
    assert rows_of(seeds.seeds(ref_df, query_df, "smem", k, 2)) == expected


def test_seeds_do_not_depend_on_partitions(case):
    _, _, ref_df, query_df, k = case
    assert rows_of(seeds.seeds(ref_df.repartition(1), query_df, "fast", k)) == rows_of(seeds.seeds(ref_df.repartition(8), query_df.repartition(3), "fast", k))
    assert seeds.inexact(seeds.seeds(ref_df, query_df, "maxmatch", k), ref_df, query_df).count() == 0


def test_touching_seeds_merge(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 5, "+"), (0, 5, 0, 5, 4, "+"), (0, 20, 0, 30, 5, "+")], "ref_id long, rb long, query_id long, qb long, len long, strand string")
    assert rows_of(seeds.merge_diagonals(rows)) == {(0, 0, 0, 0, 9, "+"), (0, 20, 0, 30, 5, "+")}


def test_interval_operators(spark):
    rows = spark.createDataFrame([("a", 2, 5, 0), ("a", 5, 8, 1), ("a", 10, 12, 0), ("a", 11, 15, 1), ("b", 0, 3, 2)], "key string, begin long, end long, bit int")
    merged = {tuple(r) for r in intervals.union(rows, ["key"]).collect()}
    assert merged == {("a", 2, 8), ("a", 10, 15), ("b", 0, 3)}
    extents = spark.createDataFrame([("a", 20), ("b", 3), ("c", 4)], "key string, length long")
    assert {tuple(r) for r in intervals.complement(rows, extents, ["key"]).collect()} == {("a", 0, 2), ("a", 8, 10), ("a", 15, 20), ("c", 0, 4)}
    cells = {tuple(r) for r in intervals.sweep(rows, ["key"]).select("key", "begin", "end", "mask").collect()}
    assert cells == {("a", 2, 5, 1), ("a", 5, 8, 2), ("a", 10, 11, 1), ("a", 11, 12, 3), ("a", 12, 15, 2), ("b", 0, 3, 4)}
    named = rows.withColumn("id", F.col("begin"))
    assert {tuple(r) for r in intervals.self_overlaps(named, ["key"]).collect()} == {("a", 10, 11, 11, 12)}
    asked = spark.createDataFrame([("a", 3, 7), ("a", 7, 9), ("d", 0, 1)], "key string, begin long, end long")
    assert {(r["begin"], r["covered"]) for r in intervals.covered_by(asked, intervals.union(rows, ["key"]), ["key"]).collect()} == {(3, True), (7, False), (0, False)}
    assert intervals.overlap_violations(rows, ["key"]).count() == 1


@pytest.mark.parametrize("values, label", [((4, 2, 400, 200), "+"), ((4, 3, 400, 200), "?"), ((2, 0, 200, 0), "."), ((1, 5, 10, 500), "-")])
def test_window_label(spark, values, label):
    assert spark.range(1).select(intervals.label(*[F.lit(v) for v in values]).alias("x")).first()["x"] == label


def test_heaviest_set_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        rows = sorted((b, b + r.randrange(1, 9), float(r.randrange(1, 20))) for b in (r.randrange(30) for _ in range(r.randrange(1, 11))))
        kept = select.heaviest([x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows])
        chosen = [x for x, k in zip(rows, kept, strict=True) if k]
        assert all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:], strict=False))
        best = 0.0
        for mask in range(1 << len(rows)):
            some = [x for k, x in enumerate(rows) if mask >> k & 1]
            if all(a[1] <= b[0] for a, b in zip(some, some[1:], strict=False)):
                best = max(best, sum(x[2] for x in some))
        assert sum(x[2] for x in chosen) == best
