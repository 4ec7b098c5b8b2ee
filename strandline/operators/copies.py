"""Further copies of what is aligned: open stretches, repeats of a sequence within itself, and their images through the primary anchors.

Anchors: (pair_id, anchor_id, rb, qb, len, strand), places on the forward query. A job is a stretch of one axis
(``reference`` or ``query``) that no anchor covers, its target, searched for in its source, the target with as much on both sides as it is long, out to the
neighbouring anchors.
"""

from __future__ import annotations

from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import intervals, seeds

# Candidates of a job and in all, and the most occurrences of a repeat.
LOCAL_LIMIT = 3000
TOTAL_LIMIT = 100_000
MOST_LEVEL = 100
COPY = "pair_id long, job long, axis string, primary_id long, rb long, qb long, len long, strand string, source_strand string, source_begin long, weight double"


def oriented(qb: Column, n: Column, strand: Column, query_length: Column) -> Column:
    """Where a match begins on the query as its strand reads it."""
    return F.when(strand == "+", qb).otherwise(query_length - qb - n)


def diagonal(rb: Column, qb: Column, n: Column, strand: Column, query_length: Column) -> Column:
    """Matches of one strand with the same value are on one line."""
    return rb - oriented(qb, n, strand, query_length)


def counterpart(begin: Column, other: Column, n: Column, strand: Column, target: Column) -> Column:
    """The place on the other sequence that belongs to ``target``, in a match at ``begin`` here and ``other`` there."""
    return other + F.when(strand == "+", target - begin).otherwise(n - 1 - (target - begin))


def clipped(begin: Column, other: Column, n: Column, strand: Column, low: Column, high: Column) -> Column:
    """A match cut to [low, high) of the axis of ``begin``: begin, other and len, which is 0 if nothing is left."""
    first, last = F.greatest(low, begin), F.least(high, begin + n)
    left = F.greatest(last - first, F.lit(0))
    moved = other + F.when(strand == "+", first - begin).otherwise(begin + n - last)
    return F.when(left > 0, F.struct(first.alias("begin"), moved.alias("other"), left.alias("len"))).otherwise(F.struct(begin.alias("begin"), other.alias("other"), left.alias("len")))


def _spans(anchors: DataFrame, axis: str) -> DataFrame:
    begin = F.col("qb") if axis == "query" else F.col("rb")
    return anchors.select("pair_id", "anchor_id", "strand", begin.alias("begin"), (begin + F.col("len")).alias("end"))


def jobs(anchors: DataFrame, extents: DataFrame, scouts: bool = True) -> DataFrame:
    """(pair_id, job, axis, scout, target_begin, target_end, source_begin, source_end, left_id, right_id): the open stretches of a pair, longest first, then two scouts
    over each whole sequence. extents: (pair_id, reference_length, query_length).

    left_id and right_id are the anchors that end last before the target and begin first behind it; of several the first by id.
    """
    out = None
    for axis in ("query", "reference"):
        lengths = extents.select("pair_id", F.col(f"{axis}_length").alias("length"))
        spans = _spans(anchors, axis)
        gaps = intervals.complement(spans, lengths, ["pair_id"]).join(lengths, "pair_id")
        # The nearest anchors come along the axis: the last end up to a gap's begin, the first begin from its end on.
        ends = spans.groupBy("pair_id", F.col("end").alias("at")).agg(F.min(F.struct("anchor_id", "begin")).alias("l"))
        begins = spans.groupBy("pair_id", F.col("begin").alias("at")).agg(F.min(F.struct("anchor_id", "end")).alias("r"))
        asked = gaps.select("pair_id", "length", "begin", "end", F.col("begin").alias("at"), F.lit(1).alias("kind"))
        up = Window.partitionBy("pair_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
        left = asked.unionByName(ends.withColumn("kind", F.lit(0)), allowMissingColumns=True).withColumn("l", F.last("l", True).over(up)).where("kind = 1")
        down = Window.partitionBy("pair_id").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
        both = left.withColumn("at", F.col("end")).unionByName(begins.withColumn("kind", F.lit(0)), allowMissingColumns=True).withColumn("r", F.last("r", True).over(down)).where("kind = 1")
        n = F.col("end") - F.col("begin")
        rows = both.select(
            "pair_id", F.lit(axis).alias("axis"), F.lit(False).alias("scout"), F.col("begin").alias("target_begin"), F.col("end").alias("target_end"),
            F.least(F.greatest(F.col("begin") - n, F.lit(0)), F.coalesce("l.begin", "begin")).alias("source_begin"),
            F.greatest(F.least(F.col("end") + n, F.col("length")), F.coalesce("r.end", "end")).alias("source_end"),
            F.col("l.anchor_id").alias("left_id"), F.col("r.anchor_id").alias("right_id"),
        )
        whole = lengths.select("pair_id", F.lit(axis).alias("axis"), F.lit(True).alias("scout"), F.lit(0).cast("long").alias("target_begin"), F.col("length").alias("target_end"), F.lit(0).cast("long").alias("source_begin"), F.col("length").alias("source_end"), F.lit(None).cast("long").alias("left_id"), F.lit(None).cast("long").alias("right_id"))
        rows = rows.unionByName(whole) if scouts else rows
        out = rows if out is None else out.unionByName(rows)
    order = Window.partitionBy("pair_id").orderBy("scout", F.when(F.col("scout"), 0).otherwise(F.col("target_begin") - F.col("target_end")), F.when(F.col("scout") == (F.col("axis") == "query"), 0).otherwise(1), "target_begin")
    return out.withColumn("job", F.row_number().over(order).cast("long"))


def self_repeats(found: DataFrame, todo: DataFrame, anchors: DataFrame) -> DataFrame:
    """(pair_id, job, axis, first_begin, second_begin, len, strand): the repeats within a sequence that a job is about.

    found: (pair_id, axis, s, d, len, strand), maximal matches of each sequence with itself, d where it is read along the strand. A repeat's
    two places differ and don't overlap; for a job one is in its target, the other in its source but outside the target, and one of the ends is an end of the target or of an
    anchor. A scout's repeats lie side by side; forward ones that overlap are cut to one period. Each pair of places counts once a job.
    """
    t = todo.select("pair_id", "job", "axis", "scout", "target_begin", "target_end", "source_begin", "source_end")
    m = found.select("pair_id", "axis", "s", "d", F.col("len").alias("n"), "strand", (F.col("d") + F.col("len")).alias("d_end"))
    met = intervals.binned_join(t, m, ["pair_id", "axis"], F.col("s") != F.col("d"), ("target_begin", "target_end"), ("d", "d_end"))
    # Cut to target and source, in step: forward from the front, reverse from the other end.
    plus = F.col("strand") == "+"
    front = F.greatest(F.col("target_begin") - F.col("d"), F.when(plus, F.col("source_begin") - F.col("s")).otherwise(F.col("s") + F.col("n") - F.col("source_end")), F.lit(0))
    back = F.greatest(F.col("d_end") - F.col("target_end"), F.when(plus, F.col("s") + F.col("n") - F.col("source_end")).otherwise(F.col("source_begin") - F.col("s")), F.lit(0))
    cut = met.withColumn("front", front).withColumn("back", back).where("n > front + back")
    cut = cut.select("pair_id", "job", "axis", "scout", "target_begin", "target_end", "strand", (F.col("d") + F.col("front")).alias("d"), (F.col("s") + F.when(plus, F.col("front")).otherwise(F.col("back"))).alias("s"), (F.col("n") - F.col("front") - F.col("back")).alias("len"))
    apart = F.abs(F.col("s") - F.col("d"))
    cut = cut.withColumn("len", F.when(F.col("scout") & plus, F.least("len", apart)).otherwise(F.col("len")))
    end = lambda c: F.col(c) + F.col("len")
    cut = cut.where((F.col("s") >= end("d")) | (F.col("d") >= end("s")))
    beside = (end("s") == F.col("d")) | (end("d") == F.col("s"))
    outside = (F.col("s") >= F.col("target_end")) | (F.col("target_begin") >= end("s"))
    marks = _spans(anchors, "query").withColumn("axis", F.lit("query")).unionByName(_spans(anchors, "reference").withColumn("axis", F.lit("reference")))
    edges = lambda name: marks.select("pair_id", "axis", F.col(name).alias("edge")).distinct()
    cut = cut.withColumn("s_end", end("s"))
    cut = cut.join(edges("begin").withColumnRenamed("edge", "s").withColumn("at_begin", F.lit(True)), ["pair_id", "axis", "s"], "left")
    cut = cut.join(edges("end").withColumnRenamed("edge", "s_end").withColumn("at_end", F.lit(True)), ["pair_id", "axis", "s_end"], "left")
    attached = (F.col("d") == F.col("target_begin")) | (end("d") == F.col("target_end")) | F.coalesce("at_begin", F.lit(False)) | F.coalesce("at_end", F.lit(False))
    kept = cut.where(F.when(F.col("scout"), beside).otherwise(outside & attached))
    places = F.least("s", "d").alias("first_begin"), F.greatest("s", "d").alias("second_begin")
    once = kept.groupBy("pair_id", "job", "axis", *places, "len", "strand").agg(F.min(F.struct("s", "d")).alias("x"))
    return once.select("pair_id", "job", "axis", "first_begin", "second_begin", "len", "strand", "x.s", "x.d")


def self_matches(sequences: DataFrame, k: int, strands: str = "+-") -> DataFrame:
    """(pair_id, s, d, len, strand): maximal exact matches of each of (pair_id, bases) with itself, less each place with itself."""
    named = sequences.select(F.col("pair_id").alias("seq_id"), "bases")
    found = seeds.mems(named, named, k, strands).where("ref_id = query_id")
    return found.where("not (strand = '+' and rb = qb)").select(F.col("query_id").alias("pair_id"), F.col("rb").alias("s"), F.col("qb").alias("d"), "len", "strand")


def projected(repeats: DataFrame, anchors: DataFrame, extents: DataFrame) -> DataFrame:
    """COPY without weight: the parts of repeats whose source an anchor covers, as matches of the target with the other sequence.

    A match found in several ways counts once a job. source_begin is its place in the source as the source is read.
    """
    sources = repeats.select("pair_id", "job", "axis", "s", "d", "len", "strand", (F.col("s") + F.col("len")).alias("s_end"))
    out = None
    for axis in ("query", "reference"):
        own = _spans(anchors, axis).select("pair_id", F.col("anchor_id").alias("primary_id"), F.col("strand").alias("a_strand"), F.col("begin").alias("ab"), F.col("end").alias("ae"))
        other = "rb" if axis == "query" else "qb"
        own = own.join(anchors.select("pair_id", F.col("anchor_id").alias("primary_id"), F.col(other).alias("ob")), ["pair_id", "primary_id"])
        met = intervals.binned_join(sources.where(F.col("axis") == axis), own, ["pair_id"], F.lit(True), ("s", "s_end"), ("ab", "ae"))
        b, e = F.greatest("s", "ab"), F.least("s_end", "ae")
        target = F.when(F.col("strand") == "+", F.col("d") + b - F.col("s")).otherwise(F.col("d") + F.col("s_end") - e)
        there = F.col("ob") + F.when(F.col("a_strand") == "+", b - F.col("ab")).otherwise(F.col("ae") - e)
        reading = F.col("a_strand") if axis == "query" else F.col("strand")
        length = F.col(f"{axis}_length")
        rows = met.join(extents, "pair_id").select(
            "pair_id", "job", "axis", "primary_id", (there if axis == "query" else target).alias("rb"), (target if axis == "query" else there).alias("qb"), (e - b).alias("len"),
            F.when(F.col("a_strand") == F.col("strand"), "+").otherwise("-").alias("strand"), reading.alias("source_strand"), F.when(reading == "+", b).otherwise(length - e).alias("source_begin"),
        )
        out = rows if out is None else out.unionByName(rows)
    first = Window.partitionBy("pair_id", "job", "rb", "qb", "len", "strand").orderBy("primary_id", "source_begin", "source_strand")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def merged(copies: DataFrame, extents: DataFrame) -> DataFrame:
    """The copies without those that lie in a longer one on the same line through the same anchor."""
    rows = copies.join(extents.select("pair_id", "query_length"), "pair_id")
    rows = rows.withColumn("line", diagonal(F.col("rb"), F.col("qb"), F.col("len"), F.col("strand"), F.col("query_length"))).withColumn("re", F.col("rb") + F.col("len"))
    keys = ["pair_id", "job", "strand", "line", "primary_id"]
    once = rows.dropDuplicates([*keys, "rb", "re"])
    return once.withColumn("_in", intervals.contained(once, keys, "rb", "re", strictly=True)).where("not _in").drop("_in", "line", "re", "query_length")


def budget(repeats: DataFrame, copies: DataFrame, todo: DataFrame, local: int = LOCAL_LIMIT, total: int = TOTAL_LIMIT) -> DataFrame:
    """(pair_id, job, repeats, projections, candidates, status): ``budget_exhausted`` where a job has more than ``local`` candidates or the jobs of the pair up to it, in their
    order, more than ``total``; else ``no_repeat``, ``no_projected_repeat`` or ``open``. What an exhausted job has found is ambiguous as a whole."""
    counts = todo.select("pair_id", "job").join(repeats.groupBy("pair_id", "job").agg(F.count("*").alias("repeats")), ["pair_id", "job"], "left").join(copies.groupBy("pair_id", "job").agg(F.count("*").alias("projections")), ["pair_id", "job"], "left").fillna(0)
    counts = counts.withColumn("candidates", F.col("repeats") + F.col("projections"))
    so_far = F.sum("candidates").over(Window.partitionBy("pair_id").orderBy("job").rowsBetween(Window.unboundedPreceding, 0))
    status = F.when((F.col("candidates") > local) | (so_far > total), "budget_exhausted").when(F.col("repeats") == 0, "no_repeat").when(F.col("projections") == 0, "no_projected_repeat").otherwise("open")
    return counts.withColumn("status", status)


def unique_flanks(todo: DataFrame, anchors: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    """(pair_id, job, unique): whether both neighbours of a job's target are of one strand, in order, and occur once in either sequence.

    reference and queries: (pair_id, bases). An occurrence may overlap another; the query is searched for what the strand reads.
    """
    a = anchors.join(reference.withColumnRenamed("bases", "r"), "pair_id").join(queries.withColumnRenamed("bases", "q"), "pair_id")
    pattern = F.expr("substring(r, int(rb + 1), int(len))")
    a = a.withColumn("p", pattern).withColumn("x", F.when(F.col("strand") == "+", F.col("p")).otherwise(F.reverse(F.translate("p", "ACGT", "TGCA"))))
    # A pattern occurs once if it is found first where it is found last: searched from both ends.
    single = lambda s, p: F.expr(f"instr({s}, {p}) > 0 and instr({s}, {p}) = length({s}) - length({p}) + 2 - instr(reverse({s}), reverse({p}))")
    marked = a.select("pair_id", "anchor_id", "strand", "rb", "qb", "len", (single("r", "p") & single("q", "x")).alias("once"))
    side = lambda p: marked.select("pair_id", *[F.col(c).alias(f"{p}_{c}" if c != "anchor_id" else f"{p}_id") for c in ("anchor_id", "strand", "rb", "qb", "len", "once")])
    both = todo.where("not scout").select("pair_id", "job", "axis", "left_id", "right_id").join(side("left"), ["pair_id", "left_id"], "left").join(side("right"), ["pair_id", "right_id"], "left")
    ends = lambda p, c: F.col(f"{p}_{c}") + F.col(f"{p}_len")
    ordered = F.when(F.col("axis") == "query", F.when(F.col("left_strand") == "+", ends("left", "rb") <= F.col("right_rb")).otherwise(ends("right", "rb") <= F.col("left_rb")))
    ordered = ordered.otherwise(F.when(F.col("left_strand") == "+", ends("left", "qb") <= F.col("right_qb")).otherwise(ends("right", "qb") <= F.col("left_qb")))
    ok = (F.col("left_strand") == F.col("right_strand")) & (F.col("left_id") != F.col("right_id")) & ordered & F.col("left_once") & F.col("right_once")
    return both.select("pair_id", "job", F.coalesce(ok, F.lit(False)).alias("unique"))


def best_copy_chain(rows: list[tuple], query_length: int, axis: str, banned: frozenset[int] = frozenset()) -> tuple[list[int], float]:
    """(indices, score) of the best chain of copies (rb, qb, len, strand, source_strand, source_begin, weight) in order of rb.

    A step costs the discordance of the two sequences and that of source and target; it is never raised to stay positive, so a chain only goes on where that pays.
    Steps go between copies of one strand whose sources are read alike, without overlaps on the reference, the oriented query and the source. Of equal ones the first.
    """
    place = [(r, q if s == "+" else query_length - q - n, n, s, t, b, w) for r, q, n, s, t, b, w in rows]
    score, back = [float("-inf")] * len(rows), [-1] * len(rows)
    for i, (r, u, n, s, t, b, w) in enumerate(place):
        if i in banned:
            continue
        score[i] = w
        for j, (x, v, m, s2, t2, c, _) in enumerate(place[:i]):
            if j in banned or s2 != s or t2 != t:
                continue
            dr, dq, ds = r - x - m, u - v - m, b - c - m
            if min(dr, dq, ds) < 0:
                continue
            value = score[j] + w - 2 * log2(abs(dr - dq) + 1) - 2 * log2(abs(ds - (dq if axis == "query" else dr)) + 1)
            if value > score[i]:
                score[i], back[i] = value, j
    at = max((k for k in range(len(rows)) if k not in banned), key=lambda k: (score[k], -k), default=-1)
    best, path = (score[at] if at >= 0 else 0.0), []
    while at >= 0:
        path.append(at)
        at = back[at]
    return path[::-1], best


def chained(copies: DataFrame, extents: DataFrame) -> DataFrame:
    """COPY with chain_index, score and runner_up: each job's best chain, and the best that does without one of its copies, the largest of those.

    A chain is told from its rivals only if runner_up is smaller by more than rounding. A job has LOCAL_LIMIT copies at most (``budget``).
    """
    rows = copies.join(extents.select("pair_id", "query_length"), "pair_id")
    names = [c.split(" ")[0] for c in COPY.split(", ")]

    def run(batches: pd.DataFrame) -> pd.DataFrame:
        group = batches.sort_values(["rb", "qb", "strand", "len"]).reset_index(drop=True)
        items = list(zip(*[group[c].tolist() for c in ("rb", "qb", "len", "strand", "source_strand", "source_begin", "weight")], strict=True))
        n, axis = int(group["query_length"].iloc[0]), group["axis"].iloc[0]
        path, best = best_copy_chain(items, n, axis)
        second = max((best_copy_chain(items, n, axis, frozenset([k]))[1] for k in path), default=0.0)
        out = group.iloc[path][names].copy()
        return out.assign(chain_index=range(1, len(path) + 1), score=best, runner_up=second)

    return rows.groupBy("pair_id", "job").applyInPandas(run, f"{COPY}, chain_index long, score double, runner_up double")

