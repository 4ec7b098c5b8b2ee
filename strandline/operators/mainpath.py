"""Links between neighbours on the main path: gaps that are empty, equal, one-sided or close to it are filled in.

Neighbours on the reference are linked if they are neighbours on the query too. The plan is made with windows; only gaps that
need an alignment go to a kernel, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import cigar, kernels
from strandline.functions.sequence import reverse_complement
from strandline.operators.link import ALIGNMENT, stretches
from strandline.operators.select import ORDER

# What a gap and its flanks must be like.
LONGEST = 10_000
LONGEST_INEXACT = 1_000
IDENTITY = 0.98
#: Where an alignment is on the path.
PLACE = ["ref_id", "ref_rank"]


def plan(rows: DataFrame, reference: DataFrame, queries: DataFrame, min_match: int = 20, min_cluster: int = 65) -> DataFrame:
    """Each alignment with its place on the path (ref_rank) and, for the link to the next one: kind (empty, equal, one_sided, dp), or none and why not."""
    # Only neighbours on one reference and one query are compared, so ranks count within each.
    path = Window.partitionBy("ref_id").orderBy("rb", "re", *ORDER)
    ranked = rows.withColumn("ref_rank", F.row_number().over(path)).withColumn("query_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("qb", "qe", "ref_id", "rb")))
    lead_first = F.element_at("cigar", 1)
    end_exact = F.when(F.element_at("cigar", -1)["op"] == "=", F.element_at("cigar", -1)["len"]).otherwise(0)
    begin_exact = F.when(lead_first["op"] == "=", lead_first["len"]).otherwise(0)
    with_ends = ranked.withColumn("end_exact", end_exact).withColumn("begin_exact", begin_exact).withColumn("identity", F.col("matches") / F.col("columns"))
    ahead = Window.partitionBy("ref_id").orderBy("ref_rank")
    fields = ("query_id", "strand", "rb", "qb", "qe", "query_rank", "begin_exact", "identity", "matches")
    pairs = with_ends.select("*", *[F.lead(c).over(ahead).alias(f"n_{c}") for c in fields])
    forward = F.col("strand") == "+"
    pairs = pairs.withColumn("gap_rb", F.col("re")).withColumn("gap_re", F.col("n_rb"))
    pairs = pairs.withColumn("gap_qb", F.when(forward, F.col("qe")).otherwise(F.col("n_qe"))).withColumn("gap_qe", F.when(forward, F.col("n_qb")).otherwise(F.col("qb")))
    rn, qn = F.col("gap_re") - F.col("gap_rb"), F.col("gap_qe") - F.col("gap_qb")
    next_to = (F.col("n_query_id") == F.col("query_id")) & (F.col("n_strand") == F.col("strand")) & (F.col("n_query_rank") - F.col("query_rank") == F.when(forward, 1).otherwise(-1)) & (rn >= 0) & (qn >= 0)
    flanks = (F.least("matches", "n_matches") >= min_cluster) & (F.col("end_exact") >= min_match) & (F.col("n_begin_exact") >= min_match) & (F.least("identity", "n_identity") >= IDENTITY)
    pairs = pairs.withColumn("rn", rn).withColumn("qn", qn).withColumn("next_to", F.coalesce(next_to, F.lit(False))).withColumn("flanks", F.coalesce(flanks, F.lit(False)))
    gaps = pairs.where("next_to and rn + qn > 0 and flanks and greatest(rn, qn) <= %d" % LONGEST)
    named = gaps.select(*PLACE, "query_id", "strand", F.col("gap_rb").alias("rb"), F.col("gap_re").alias("re"), F.col("gap_qb").alias("qb"), F.col("gap_qe").alias("qe"))
    bases = stretches(named, reference, queries).withColumn("query_part", F.when(F.col("strand") == "+", F.col("query_part")).otherwise(reverse_complement(F.col("query_part")))).select(*PLACE, "ref_part", "query_part")
    known = pairs.join(bases, PLACE, "left")
    has_n = F.contains(F.concat("ref_part", "query_part"), F.lit("N"))
    kind = (
        F.when(~F.col("next_to"), F.lit(None))
        .when((F.col("rn") == 0) & (F.col("qn") == 0), F.lit("empty"))
        .when((F.greatest("rn", "qn") > LONGEST) | ~F.col("flanks") | has_n, F.lit(None))
        .when(F.col("ref_part") == F.col("query_part"), F.lit("equal"))
        .when(F.greatest("rn", "qn") > LONGEST_INEXACT, F.lit(None))
        .when((F.col("rn") == 0) | (F.col("qn") == 0), F.lit("one_sided"))
        .otherwise(F.lit("dp"))
    )
    return known.withColumn("kind", kind).withColumn("least_identity", F.least("identity", "n_identity"))


def _filled(min_cluster: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for ref_id, rank, ref, query, least in zip(*[rows[c] for c in (*PLACE, "ref_part", "query_part", "least_identity")], strict=True):
                # LONGEST_INEXACT by as many bases are within the kernel's cells, so there is a path.
                path, _ = kernels.global_alignment(ref, query)
                matches = sum(n for op, n in path if op == "=")
                columns = sum(n for _, n in path)
                if matches >= min_cluster and matches / columns >= max(IDENTITY, least):
                    out.append((ref_id, rank, [{"op": op, "len": n} for op, n in path]))
            yield pd.DataFrame(out, columns=[*PLACE, "filled"])

    return run


def link_main_path(rows: DataFrame, reference: DataFrame, queries: DataFrame, min_match: int = 20, min_cluster: int = 65) -> DataFrame:
    """The alignments with linked neighbours made one: CIGARs joined across their gaps and scored anew, gaps that meet opened once."""
    planned = plan(rows, reference, queries, min_match, min_cluster).persist()
    filled = planned.where("kind = 'dp'").select(*PLACE, "ref_part", "query_part", "least_identity").mapInPandas(_filled(min_cluster), f"ref_id long, ref_rank int, filled {cigar.TYPE}")
    one = lambda op, n: F.array(F.struct(F.lit(op).alias("op"), n.cast("long").alias("len")))
    gap = (
        F.when(F.col("kind") == "empty", F.array().cast(cigar.TYPE))
        .when(F.col("kind") == "equal", one("=", F.col("rn")))
        .when(F.col("kind") == "one_sided", F.when(F.col("qn") == 0, one("D", F.col("rn"))).otherwise(one("I", F.col("qn"))))
        .otherwise(F.col("filled"))
    )
    known = planned.join(filled, PLACE, "left").withColumn("gap", gap)
    order = Window.partitionBy("ref_id").orderBy("ref_rank")
    breaks = F.when(F.lag("gap").over(order).isNull(), 1).otherwise(0)
    runs = known.withColumn("_break", breaks).withColumn("run", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("ref_rank", "cigar", F.coalesce("gap", F.array().cast(cigar.TYPE)).alias("gap"))))
    merged = runs.groupBy("ref_id", "run").agg(
        F.first("query_id").alias("query_id"), F.first("strand").alias("strand"), F.min("rb").alias("rb"), F.max("re").alias("re"), F.min("qb").alias("qb"), F.max("qe").alias("qe"), parts.alias("parts"), F.count("*").alias("members")
    )
    flat = F.flatten(F.transform("parts", lambda p, i: F.when(i < F.size("parts") - 1, F.concat(p["cigar"], p["gap"])).otherwise(p["cigar"])))
    merged = merged.withColumn("cigar", cigar.merged(flat)).drop("parts", "run")
    bases = stretches(merged, reference, queries)

    def rescored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for row in part.to_dict("records"):
                query = row["query_part"] if row["strand"] == "+" else kernels.reverse_complement(row["query_part"])
                path, score, edits = kernels.replay([(c["op"], int(c["len"])) for c in row["cigar"]], row["ref_part"], query)
                out.append((row["ref_id"], row["rb"], row["re"], row["query_id"], row["qb"], row["qe"], row["strand"], [{"op": op, "len": n} for op, n in path], score, edits, sum(n for op, n in path if op == "="), sum(n for _, n in path), row["members"]))
            yield pd.DataFrame(out, columns=["ref_id", "rb", "re", "query_id", "qb", "qe", "strand", "cigar", "score", "edits", "matches", "columns", "members"])

    return bases.mapInPandas(rescored, f"{ALIGNMENT}, members long")
