"""Operators for repeat-rich pairs: rare matches, orientation by windows, directed anchors, copy jobs, stitched segments.

All tables carry pair_id, so many pairs go through one plan; within a pair, strands and regions are groups of their own.
Matches: (pair_id, rb, qb, len, strand, reference_count, query_count, level, weight), places on the forward query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import cigar, kernels, scoring
from strandline.operators import intervals, seeds

# Rarity, windows, and how far a direction is carried across a gap.
MOST_LEVEL = 100
WINDOW, STEP = 10_000, 5_000
CARRIED = 20_000


def rare_matches(reference: DataFrame, queries: DataFrame, k: int = 20, most: int = MOST_LEVEL, strands: str = "+-") -> DataFrame:
    """Maximal exact matches of each pair (equal seq_id) that occur ``most`` times or fewer on either side.

    A match's string occurs once in the reference for each match of its query stretch that contains it, and once in the
    query for each match of its reference stretch. level is the larger count, weight the length over their geometric mean.
    """
    found = seeds.mems(reference, queries, k, strands).where("ref_id = query_id")
    rows = found.select(F.col("query_id").alias("pair_id"), "strand", "rb", (F.col("rb") + F.col("len")).alias("re"), "oqb", "oqe", "qb", "len")
    rows = rows.withColumn("mid", F.xxhash64("pair_id", "strand", "rb", "oqb"))
    rows = rows.persist()

    def counted(begin: str, end: str, name: str) -> DataFrame:
        own = rows.select("pair_id", "strand", "mid", F.col(begin).alias("b"), F.col(end).alias("e"))
        other = rows.select("pair_id", "strand", F.col(begin).alias("ob"), F.col(end).alias("oe"))
        pairs = intervals.binned_join(own, other, ["pair_id", "strand"], (F.col("ob") <= F.col("b")) & (F.col("oe") >= F.col("e")), ("b", "e"), ("ob", "oe"))
        return pairs.groupBy("mid").agg(F.count("*").alias(name))

    both = rows.join(counted("oqb", "oqe", "reference_count"), "mid").join(counted("rb", "re", "query_count"), "mid")
    both = both.withColumn("level", F.greatest("reference_count", "query_count")).where(F.col("level") <= most)
    weight = scoring.rarity_weight(F.col("len"), F.col("reference_count"), F.col("query_count"))
    return both.select("pair_id", "rb", "qb", "len", "strand", "reference_count", "query_count", "level", weight.alias("weight"))


def first_hits(matches: DataFrame) -> DataFrame:
    """Of each pair and strand the matches of the lowest level that has any."""
    lowest = F.min("level").over(Window.partitionBy("pair_id", "strand"))
    return matches.withColumn("_low", lowest).where("level = _low").drop("_low")


def without_neutral(matches: DataFrame) -> DataFrame:
    """Without matches whose box (stretch of both sequences) is one of either strand."""
    both = F.size(F.collect_set("strand").over(Window.partitionBy("pair_id", "rb", "qb", "len")))
    return matches.withColumn("_n", both).where("_n = 1").drop("_n")


def window_labels(matches: DataFrame, extents: DataFrame, size: int = WINDOW, step: int = STEP) -> DataFrame:
    """(pair_id, begin, end, label) of the windows over each query (pair_id, length).

    Members of a window have their middle in it; they are counted as the most that don't overlap, by earliest end, and their
    length is what they cover of it.
    """
    windows = intervals.window_starts(extents, ["pair_id"], size, step).select("pair_id", F.col("begin").alias("w_begin"), F.col("end").alias("w_end"))
    rows = without_neutral(matches).select("pair_id", "strand", F.col("qb").alias("begin"), (F.col("qb") + F.col("len")).alias("end"))
    middle = F.floor((F.col("begin") + F.col("end")) / 2)
    placed = rows.select("pair_id", "strand", "begin", "end", middle.alias("m"), (middle + 1).alias("m1"))
    members = intervals.binned_join(windows, placed, ["pair_id"], F.lit(True), ("w_begin", "w_end"), ("m", "m1"), step)

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        n, reach = 0, -1
        for b, e in sorted(zip(rows["begin"], rows["end"], strict=True), key=lambda x: (x[1], x[0])):
            if b >= reach:
                n, reach = n + 1, e
        key = rows.iloc[0]
        return pd.DataFrame({"pair_id": [key["pair_id"]], "w_begin": [key["w_begin"]], "w_end": [key["w_end"]], "strand": [key["strand"]], "n": [n]})

    counts = members.groupBy("pair_id", "w_begin", "w_end", "strand").applyInPandas(counted, "pair_id long, w_begin long, w_end long, strand string, n long")
    cover = intervals.union(rows, ["pair_id", "strand"])
    lengths = intervals.binned_join(windows, cover, ["pair_id"], F.lit(True), ("w_begin", "w_end"), ("begin", "end"), step)
    lengths = lengths.groupBy("pair_id", "w_begin", "w_end", "strand").agg(F.sum(F.least("end", "w_end") - F.greatest("begin", "w_begin")).alias("covered"))
    side = lambda s, c: F.coalesce(F.max(F.when(F.col("strand") == s, F.col(c))), F.lit(0))
    sums = counts.join(lengths, ["pair_id", "w_begin", "w_end", "strand"], "full").groupBy("pair_id", "w_begin", "w_end").agg(side("+", "n").alias("f"), side("-", "n").alias("r"), side("+", "covered").alias("fl"), side("-", "covered").alias("rl"))
    labelled = windows.join(sums, ["pair_id", "w_begin", "w_end"], "left").fillna(0, ["f", "r", "fl", "rl"])
    return labelled.select("pair_id", F.col("w_begin").alias("begin"), F.col("w_end").alias("end"), intervals.label(F.col("f"), F.col("r"), F.col("fl"), F.col("rl")).alias("label"))


def regions(labels: DataFrame, matches: DataFrame, carried: int = CARRIED) -> DataFrame:
    """(pair_id, region_id, query_begin, query_end, strand): stretches of one direction.

    Labelled windows make cells; a cell that only one direction labels supports it where matches of that direction cover it.
    Neighbours of the same direction are one region if the gap between them is short and no cell in it speaks otherwise.
    """
    bit = F.when(F.col("label") == "+", 0).when(F.col("label") == "-", 1).otherwise(2)
    cells = intervals.sweep(labels.where("label <> '.'").withColumn("bit", bit), ["pair_id"])
    pure = cells.where("mask in (1, 2)").select("pair_id", F.when(F.col("mask") == 1, "+").otherwise("-").alias("strand"), F.col("begin").alias("c_begin"), F.col("end").alias("c_end"))
    cover = intervals.union(without_neutral(matches).select("pair_id", "strand", F.col("qb").alias("begin"), (F.col("qb") + F.col("len")).alias("end")), ["pair_id", "strand"])
    support = intervals.binned_join(pure, cover, ["pair_id", "strand"], F.lit(True), ("c_begin", "c_end"), ("begin", "end"), STEP)
    support = support.select("pair_id", "strand", F.greatest("begin", "c_begin").alias("begin"), F.least("end", "c_end").alias("end"))
    # In order along the query: a change of direction, or too long a gap, begins a new region.
    order = Window.partitionBy("pair_id").orderBy("begin", "end")
    fresh = F.when((F.lag("strand").over(order) == F.col("strand")) & (F.col("begin") - F.lag("end").over(order) <= carried), 0).otherwise(1)
    runs = support.withColumn("_f", fresh).withColumn("region_id", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("pair_id", "region_id", "strand").agg(F.min("begin").alias("query_begin"), F.max("end").alias("query_end")).select("pair_id", "region_id", "query_begin", "query_end", "strand")


ANCHOR = "pair_id long, region_id long, chain_index long, reference_begin long, reference_end long, query_begin long, query_end long, strand string, length long, weight double"


def directed_anchors(matches: DataFrame, found: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """ANCHOR: the best chain of matches of each region's direction inside it, and inside its window (pair_id, region_id, reference_begin, reference_end) of the reference if there are any.

    A chain's score is the weight of its matches less the discordance of its steps; a step that would cost more than its match
    brings leaves it a little. Matches in a chain don't overlap on either sequence.
    """
    clipped = intervals.binned_join(
        found.select("pair_id", "strand", "region_id", "query_begin", "query_end"), matches.select("pair_id", "strand", "rb", "qb", (F.col("qb") + F.col("len")).alias("qe"), "len", "weight"), ["pair_id", "strand"], (F.col("qb") >= F.col("query_begin")) & (F.col("qe") <= F.col("query_end")), ("query_begin", "query_end"), ("qb", "qe"), STEP
    )

    if windows is not None:
        clipped = clipped.join(windows, ["pair_id", "region_id"]).where((F.col("rb") >= F.col("reference_begin")) & (F.col("rb") + F.col("len") <= F.col("reference_end")))

    def chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pair, region, strand = key
        items = sorted((int(q), int(r), int(n), float(w)) for q, r, n, w in zip(rows["qb"], rows["rb"], rows["len"], rows["weight"], strict=True))
        q, r, n, w = (np.array(c) for c in zip(*items, strict=True)) if items else (np.zeros(0),) * 4
        best, link = w.astype(float), np.full(len(items), -1)
        for i in range(1, len(items)):
            dq = q[i] - q[:i] - n[:i]
            dr = r[i] - r[:i] - n[:i] if strand == "+" else r[:i] - r[i] - n[i]
            cost = 2 * np.log2(np.abs(dq - dr) + 1)
            value = np.where((dq >= 0) & (dr >= 0), best[:i] + np.where(w[i] > cost, w[i] - cost, 0.1), -np.inf)
            j = int(value.argmax())
            if value[j] > best[i]:
                best[i], link[i] = value[j], j
        at = int(best.argmax()) if items else -1
        path = []
        while at >= 0:
            path.append(items[at])
            at = int(link[at])
        path.reverse()
        if strand == "-":
            path.reverse()  # the order of the reference
        out = [(pair, region, k + 1, r, r + n, q, q + n, strand, n, w) for k, (q, r, n, w) in enumerate(path)]
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in ANCHOR.split(", ")])

    return clipped.groupBy("pair_id", "region_id", "strand").applyInPandas(chain, ANCHOR)


def unanchored(anchors: DataFrame, found: DataFrame, extents: DataFrame) -> DataFrame:
    """(pair_id, begin, end, status): what no anchor covers of the query; ``known_unanchored`` inside a region, else ``unknown``."""
    cover = anchors.select("pair_id", F.col("query_begin").alias("begin"), F.col("query_end").alias("end"))
    known = found.select("pair_id", F.col("query_begin").alias("begin"), F.col("query_end").alias("end"))
    inside = known.withColumn("bit", F.lit(0)).union(cover.withColumn("bit", F.lit(1)))
    cells = intervals.sweep(inside, ["pair_id"], bits=2)
    gaps = cells.where("mask = 1").select("pair_id", "begin", "end", F.lit("known_unanchored").alias("status"))
    outside = intervals.complement(inside, extents, ["pair_id"]).withColumn("status", F.lit("unknown"))
    return gaps.unionByName(outside)


#: Cells up to which a gap counts as small; larger ones are aligned in bands of diagonals.
SMALL_CELLS = 4_000_000


def numbered(anchors: DataFrame) -> DataFrame:
    """With anchor_id: from 1 along a pair's regions and their chains."""
    return anchors.withColumn("anchor_id", F.row_number().over(Window.partitionBy("pair_id").orderBy("region_id", "chain_index")).cast("long"))


def gaps_between(anchors: DataFrame) -> DataFrame:
    """(pair_id, region_id, chain_index, left_anchor_id, right_anchor_id, strand, rb, re, qb, qe, gap_id): what lies between neighbours of a chain that don't touch on both sequences."""
    order = Window.partitionBy("pair_id", "region_id").orderBy("chain_index")
    plus = F.col("strand") == "+"
    pairs = anchors.select("*", *[F.lead(c).over(order).alias(f"n_{c}") for c in ("reference_begin", "query_begin", "query_end", "anchor_id")]).where("n_reference_begin is not null")
    gap = pairs.select(
        "pair_id", "region_id", "chain_index", F.col("anchor_id").alias("left_anchor_id"), F.col("n_anchor_id").alias("right_anchor_id"), "strand", F.col("reference_end").alias("rb"), F.col("n_reference_begin").alias("re"),
        F.when(plus, F.col("query_end")).otherwise(F.col("n_query_end")).alias("qb"), F.when(plus, F.col("n_query_begin")).otherwise(F.col("query_begin")).alias("qe"),
    ).where("re > rb or qe > qb")
    return gap.withColumn("gap_id", F.row_number().over(Window.partitionBy("pair_id").orderBy("region_id", "chain_index")).cast("long"))


def stitch(anchors: DataFrame, reference: DataFrame, queries: DataFrame, most_cells: int = kernels.MOST_CELLS, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, gaps): anchors joined across completed gaps.

    gaps: (pair_id, gap_id, path_id, path_role, region_id, branch_id, chain_index, left_anchor_id, right_anchor_id, strand, rb, re, qb, qe, engine, status, reason, cigar, score, dp_cells)
    between neighbours that don't touch. segments: (pair_id, segment_id, path_id, path_role, region_id, branch_id, strand, rb, re, qb, qe, anchors, anchor_ids, gap_ids, cigar, score, matches, edits); a new one begins with
    each region and after each gap that isn't complete. ``known`` (pair_id, region_id, strand, rb, re, qb, qe, cigar) has gaps that were reviewed before: they are taken as they are.
    """
    anchors = numbered(anchors)
    order = Window.partitionBy("pair_id", "region_id").orderBy("chain_index")
    gap = gaps_between(anchors)
    columns = gap.columns
    given = ["pair_id", "region_id", "strand", "rb", "re", "qb", "qe"]
    if known is None:
        gap = gap.withColumn("given", F.lit(None).cast(cigar.TYPE))
    else:
        gap = gap.join(known.select(*given, F.col("cigar").alias("given")).dropDuplicates(given), given, "left")
    refs = reference.select(F.col("seq_id").alias("pair_id"), F.col("bases").alias("r"))
    qs = queries.select(F.col("seq_id").alias("pair_id"), F.col("bases").alias("q"))
    part = lambda s, b, e: F.expr(f"cast(substring(cast({s} as binary), int({b} + 1), int({e} - {b})) as string)")
    bases = gap.join(refs, "pair_id").join(qs, "pair_id").select(*columns, "given", part("r", "rb", "re").alias("ref_part"), part("q", "qb", "qe").alias("query_part"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for ref, query, strand, path in zip(rows["ref_part"], rows["query_part"], rows["strand"], rows["given"], strict=True):
                query = query if strand == "+" else kernels.reverse_complement(query)
                cells = (len(ref) + 1) * (len(query) + 1)
                if path is not None:
                    fixed = [(c["op"], int(c["len"])) for c in path]
                    out.append(("review", "complete", "", fixed, kernels.replay(fixed, ref, query, kernels.CENTROMERE)[1], 0))
                    continue
                found = kernels.global_alignment(ref, query, kernels.CENTROMERE, most_cells)
                engine = "geometry" if not ref or not query else "dp" if cells <= SMALL_CELLS else "banded"
                if found is None:
                    out.append((engine, "unresolved", "kernel_numerical_size_limit", [], None, 0))
                else:
                    out.append((engine, "complete", "", *found, cells if engine == "dp" else 0))
            engines, states, reasons, paths, totals, counts = zip(*out, strict=True) if out else ([],) * 6
            cigars = [[{"op": op, "len": n} for op, n in path] for path in paths]
            yield rows.drop(columns=["ref_part", "query_part", "given"]).assign(engine=list(engines), status=list(states), reason=list(reasons), cigar=cigars, score=pd.array(list(totals), "Int64"), dp_cells=list(counts))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gap.select(columns).schema) + f", engine string, status string, reason string, cigar {cigar.TYPE}, score long, dp_cells long"
    path = {"path_id": F.col("region_id"), "path_role": F.lit("primary"), "branch_id": F.lit(0).cast("long")}
    gaps = bases.mapInPandas(close, schema).withColumns(path).persist()
    closed = gaps.where("status = 'complete'").select("pair_id", "region_id", "chain_index", "status", F.col("cigar").alias("gap"), "gap_id")
    left = gaps.where("status <> 'complete'").select("pair_id", "region_id", "chain_index", "status", F.lit(None).cast(cigar.TYPE).alias("gap"), F.lit(None).cast("long").alias("gap_id"))
    joined = anchors.join(closed.union(left), ["pair_id", "region_id", "chain_index"], "left")
    breaks = F.when(F.lag("chain_index").over(order).isNull() | (F.lag(F.coalesce("status", F.lit("complete"))).over(order) == "unresolved"), 1).otherwise(0)
    whole = Window.partitionBy("pair_id").orderBy("region_id", "chain_index")
    placed = joined.withColumn("_b", breaks).withColumn("segment_id", F.sum("_b").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.array(F.struct(F.lit("=").alias("op"), F.col("length").cast("long").alias("len")))
    after = F.when(F.col("status") == "complete", F.col("gap")).otherwise(F.array().cast(cigar.TYPE))
    parts = F.array_sort(F.collect_list(F.struct("chain_index", F.concat(own, after).alias("path"), "anchor_id", "gap_id")))
    merged = placed.groupBy("pair_id", "segment_id", "region_id", "strand").agg(
        F.min("reference_begin").alias("rb"), F.max("reference_end").alias("re"), F.min("query_begin").alias("qb"), F.max("query_end").alias("qe"), F.count("*").alias("anchors"), parts.alias("parts")
    )
    ids = {"anchor_ids": F.transform("parts", lambda p: p["anchor_id"]), "gap_ids": F.filter(F.transform("parts", lambda p: p["gap_id"]), lambda x: x.isNotNull())}
    segments = merged.withColumns(ids | path).withColumn("cigar", cigar.merged(F.flatten(F.transform("parts", lambda p: p["path"])))).drop("parts")
    c = F.col("cigar")
    return segments.select("*", scoring.stitched_score(c).alias("score"), cigar.matches(c).alias("matches"), cigar.edits(c).alias("edits")), gaps


def whole_pairs(anchors: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    """(pair_id, cigar, score, matches, edits): one end-to-end record of each pair, every gap between its anchors and at both ends closed by the control kernel.

    anchors: forward ones in order on both sequences. The score is the cost, negated; neighbouring gaps are one.
    """
    refs = reference.select(F.col("seq_id").alias("pair_id"), F.col("bases").alias("r"))
    qs = queries.select(F.col("seq_id").alias("pair_id"), F.col("bases").alias("q"))
    both = refs.join(qs, "pair_id")
    spot = lambda r, q, n, side: F.struct(F.lit(side).alias("side"), r.cast("long").alias("rb"), q.cast("long").alias("qb"), n.cast("long").alias("n"))
    ends = both.select("pair_id", F.explode(F.array(spot(F.lit(0), F.lit(0), F.lit(0), 0), spot(F.length("r"), F.length("q"), F.lit(0), 2))).alias("x")).select("pair_id", "x.*")
    rows = anchors.select("pair_id", F.lit(1).alias("side"), F.col("reference_begin").alias("rb"), F.col("query_begin").alias("qb"), F.col("length").cast("long").alias("n")).unionByName(ends)
    order = Window.partitionBy("pair_id").orderBy("side", "rb", "qb")
    placed = rows.select("pair_id", "n", F.row_number().over(order).alias("at"), (F.col("rb") + F.col("n")).alias("rb"), F.lead("rb").over(order).alias("re"), (F.col("qb") + F.col("n")).alias("qb"), F.lead("qb").over(order).alias("qe"))
    part = lambda s, b, e: F.coalesce(F.expr(f"cast(substring(cast({s} as binary), int({b} + 1), int({e} - {b})) as string)"), F.lit(""))
    bases = placed.join(both, "pair_id").select("pair_id", "at", "n", part("r", "rb", "re").alias("ref_part"), part("q", "qb", "qe").alias("query_part"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            paths = [[{"op": "=", "len": int(n)}] * (n > 0) + [{"op": op, "len": k} for op, k in kernels.control_gap(r, q)] for n, r, q in zip(part["n"], part["ref_part"], part["query_part"], strict=True)]
            yield pd.DataFrame({"pair_id": part["pair_id"], "at": part["at"], "path": paths})

    closed = bases.mapInPandas(close, f"pair_id long, at int, path {cigar.TYPE}")
    joined = closed.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("parts"))
    whole = joined.select("pair_id", cigar.merged(F.flatten(F.transform("parts", lambda p: p["path"]))).alias("cigar"))
    c = F.col("cigar")
    cost = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.when(x["op"] == "X", x["len"] * scoring.CONTROL_MISMATCH).when(x["op"] == "=", F.lit(0)).otherwise(scoring.two_piece_gap(x["len"])))
    return whole.select("pair_id", "cigar", (-cost).alias("score"), cigar.matches(c).alias("matches"), cigar.edits(c).alias("edits"))


def disjoint_flags(segments: DataFrame) -> DataFrame:
    """With flag: 0 for a query's representative (of the primary paths, most paired bases, then the lowest id), 2048 for a later one that overlaps none
    admitted before on the query, 256 for one that does; 16 more on the reverse strand. What isn't admitted takes no room."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        paired = [sum(int(c["len"]) for c in path if c["op"] in "=X") for path in rows["cigar"]]
        rows = rows.assign(_p=paired).sort_values(["copy", "_p", "segment_id"], ascending=[True, False, True])
        first = rows.iloc[0]["segment_id"]
        taken: list[tuple[int, int]] = []
        flags = {}
        for r in [rows.iloc[0], *[x for _, x in rows.sort_values(["copy", "segment_id"]).iterrows() if x["segment_id"] != first]]:
            free = all(r["qe"] <= b or r["qb"] >= e for b, e in taken)
            if free:
                taken.append((r["qb"], r["qe"]))
            flags[r["segment_id"]] = (0 if r["segment_id"] == first else 2048 if free else 256) + (16 if r["strand"] == "-" else 0)
        return pd.DataFrame({"pair_id": rows["pair_id"], "segment_id": rows["segment_id"], "flag": [flags[s] for s in rows["segment_id"]]})

    copy = F.col("path_role") != "primary" if "path_role" in segments.columns else F.lit(False)
    flags = segments.select("pair_id", "segment_id", "strand", "qb", "qe", "cigar", copy.alias("copy")).groupBy("pair_id").applyInPandas(run, "pair_id long, segment_id long, flag int")
    return segments.join(flags, ["pair_id", "segment_id"])
