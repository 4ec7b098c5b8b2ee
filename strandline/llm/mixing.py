"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document of a source with rate r = target / size of source has r expected copies. Documents are put in an
order within their source (by size, so that every stretch of sizes is sampled alike), the expected copies are
summed along it, one offset in [0, 1) is added for the source, and a document comes out once for each integer
that the sum crosses within it.

The running sum is the rate times a rank, and a rank is found in three levels (sizes of a source, a hash bucket
of equal sizes, a document in its bucket), so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import SEPARATOR

#: A source's target is at most so many times its size.
MOST = 3
#: Weights by rank of the source's name, repeating.
WEIGHTS = (1, 2, 3)


def size_of(text: Column) -> Column:
    """Words of a text; null has 0."""
    return F.coalesce(F.size(F.filter(F.split(text, SEPARATOR), lambda w: w != "")), F.lit(0)).cast("long")


def part_of(doc_id: Column) -> Column:
    """One of 256 parts in which documents of one source and size are ranked separately."""
    return F.coalesce(F.substring(F.md5(doc_id.cast("string")), 1, 2), F.lit(""))


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to the same with weight and target: shares of all sizes by weight, none above ``most`` times its source.

    One row a source. With the sources in order of most * size / weight, the first k that fill up take their caps
    and the rest share what is left by weight; k is the first for which the next one stays within its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.lit(float(most)) * F.col("source_size")
    fill = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rest = (
        ranked.withColumn("cap", cap)
        .withColumn("left_size", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(after))
        .withColumn("at", F.row_number().over(fill))
        .withColumn("open_at", F.when(F.col("left_size") * F.col("weight") <= F.col("cap") * F.col("left_weight"), F.col("at")))
        .withColumn("first_open", F.min("open_at").over(whole))
        .withColumn("level_size", F.max(F.when(F.col("at") == F.col("first_open"), F.col("left_size"))).over(whole))
        .withColumn("level_weight", F.max(F.when(F.col("at") == F.col("first_open"), F.col("left_weight"))).over(whole))
    )
    target = F.when(F.col("at") < F.col("first_open"), F.col("cap")).otherwise(F.col("level_size") * F.col("weight") / F.col("level_weight"))
    return rest.select("source", "source_size", "weight", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """One offset for each source, a multiple of 2**-20 in [0, 1), from a hash of seed and name: reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\x00")).cast("string")))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def systematic_mix(docs: DataFrame, seed: str = "mix", most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Each row with size, source_size, target, copies (how often the mix has it).

    Null text has size 0. Rows without source are a source of their own, the last. Repeated rows are rows of their
    own; which of several with the same source, size and doc_id gets a copy more doesn't show. A document of size 0 takes
    part but adds no words. An empty table gives an empty one. Other columns of docs pass through, whatever their names; columns of docs
    named like ours (size, source_size, target, copies) are replaced.
    """
    ours = ("size", "source_size", "target", "copies")
    others = [c for c in docs.columns if c not in ours]
    rows = docs.select(F.struct(*others).alias("row")).select("row", F.col("row.source").alias("source"), size_of(F.col("row.text")).alias("size"), part_of(F.col("row.doc_id")).alias("part"))
    counted = rows.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    by_size = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_source = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aimed = targets(by_source, most, weights)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    up_to = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_size.withColumn("below", F.coalesce(F.sum("n").over(up_to), F.lit(0))).drop("n")
    parts = counted.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = parts.alias("p").join(bases.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.size") == F.col("b.size")))
    joined = joined.select(F.col("p.source").alias("source"), F.col("p.size").alias("size"), "part", (F.col("below") + F.col("inner")).alias("base"))
    placed = joined.alias("j").join(
        aimed.select("source", "source_size", "target", rate.alias("rate")).alias("t"),
        F.col("j.source").eqNullSafe(F.col("t.source")),
    ).select(F.col("j.source").alias("s"), F.col("j.size").alias("z"), F.col("j.part").alias("p"), "base", "source_size", "target", "rate")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("row.doc_id")).cast("long"))
    out = ranked.join(placed, ranked["source"].eqNullSafe(placed["s"]) & (ranked["size"] == placed["z"]) & (ranked["part"] == placed["p"]))
    end = F.col("base") + F.col("rank")
    u = offset(F.col("source"), seed)
    copies = F.floor(end * F.col("rate") + u) - F.floor((end - 1) * F.col("rate") + u)
    return out.select(*[F.col("row")[c].alias(c) for c in others], "size", "source_size", "target", copies.cast("long").alias("copies"))
