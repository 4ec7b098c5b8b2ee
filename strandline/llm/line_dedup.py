"""Line dedup by a suffix array over line-id sequences, in DataFrame operations only.

The corpus is the sequence of the lines of its documents, by document and place; a suffix ends with its document. Prefix
doubling refines ranks: a suffix's rank at depth 2d is its own at depth d with that of the suffix d lines on. A rank
is the id of the first line and an offset among the suffixes that begin with that line, so ranks are
refined within one group at a time and no global numbering is needed; any order of what follows gives the same
intervals, and one by hash lets a large group be ranked in parts. Suffixes alone with their rank leave: their
longest common prefix with any other suffix is known. What shares a rank at depth d is an interval of the array whose
longest common prefix is d lines or more; all but its first member are later copies of a run of d lines.

A maximal repeated run is the union of the copies at the depths up to its length. A stretch of 1, 2, 4 ... lines that occurred earlier is deleted
if it has LEAST_CHARS in all, so how deep a run of short lines is shared decides about it. Lines count as equal if two hashes,
of 96 bits together, and so their ids are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut

#: A run is deleted as a copy if its lines have so many characters.
LEAST_CHARS = 20
#: Groups are ranked in so many parts.
PARTS = 256


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def levels(docs: DataFrame, id_column: str = "doc_id", text: str = "text", deep: int | None = None) -> list[DataFrame]:
    """The intervals of the suffix array with two members or more, at depths 1, 2, 4 and so on, up to the first one of ``deep`` or more: one table for each depth.

    Columns: d, t (document: id and hash of text), pos (of the suffix among the document's lines that aren't blank), line, last (first
    and last line number of the run of that depth), chars, g, o (rank), first (whether it is the interval's first member).
    """
    rows = docs.select(F.col(id_column).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("x")).where("x is not null")
    exploded = rows.select("d", "t", F.posexplode(_lines(F.col("x"))).alias("line", "s"))
    lines = exploded.where(F.length(F.trim(F.col("s"))) > 0).select("d", "t", "line", F.length("s").alias("chars"), F.xxhash64("s").alias("g"), F.hash("s").alias("h"))
    # Rows with the same id and text are one document.
    lines = cut(lines.dropDuplicates(["d", "t", "line"]))
    repeated = lines.groupBy("g", "h").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "line")).alias("top")).where("n > 1")
    repeated = cut(repeated.select("g", "h", "top", F.monotonically_increasing_id().alias("own")))  # so that the join below has its own exchange, whose hot partitions can be split
    place = Window.partitionBy("d", "t").orderBy("line")
    at = lines.withColumn("pos", F.row_number().over(place))
    found = at.join(repeated, ["g", "h"]).select("d", "t", "pos", "line", F.col("line").alias("last"), "chars", F.col("own").alias("g"), F.lit(0).cast("long").alias("o"), (F.struct("d", "t", "line") == F.col("top")).alias("first"))
    active = cut(found)
    out, depth = [active], 1
    while deep is None or depth < deep:
        ahead = active.select("d", "t", (F.col("pos") - depth).alias("pos"), F.col("last").alias("last2"), F.col("chars").alias("chars2"), F.col("g").alias("g2"), F.col("o").alias("o2"))
        pairs = cut(active.drop("first").join(ahead, ["d", "t", "pos"]))
        groups = pairs.groupBy("g", "o", "g2", "o2").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "line")).alias("top")).where("n > 1")
        groups = cut(groups.withColumn("part", F.pmod(F.xxhash64("g2", "o2"), F.lit(PARTS))))
        before = lambda *by: Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)
        parts = groups.groupBy("g", "o", "part").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before(["g", "o"], ["part"])), F.lit(0))).drop("n")
        inner = groups.withColumn("inner", F.coalesce(F.sum("n").over(before(["g", "o", "part"], ["g2", "o2"])), F.lit(0)))
        groups = inner.join(parts, ["g", "o", "part"]).select("g", "o", "g2", "o2", "top", (F.col("base") + F.col("inner")).alias("less"))
        refined = pairs.join(groups, ["g", "o", "g2", "o2"]).select(
            "d", "t", "pos", "line", F.col("last2").alias("last"), (F.col("chars") + F.col("chars2")).alias("chars"), "g", (F.col("o") + F.col("less")).alias("o"), (F.struct("d", "t", "line") == F.col("top")).alias("first")
        )
        active = cut(refined)
        if active.isEmpty():
            break
        out.append(active)
        depth *= 2
    return out


def copied_runs(docs: DataFrame, least_chars: int = LEAST_CHARS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, start, end): the runs of lines, by line numbers from 0 and both inclusive, that are copies of earlier ones, as long as they come.

    A run of ``least_chars`` lines has as many characters, so deeper intervals add nothing to it.

    Earlier means in a document with a smaller id (null is the smallest; for equal ids the smaller hash of the text), or further up in the same one.
    """
    found = None
    for level in levels(docs, id_column, text, least_chars):
        copies = level.where(~F.col("first") & (F.col("chars") >= least_chars)).select("d", "t", "line", "last")
        found = copies if found is None else found.union(copies)
    order = Window.partitionBy("d", "t").orderBy("line", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.coalesce(F.col("line") > reach, F.lit(True)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("d", "t", "island").agg(F.min("line").alias("start"), F.max("last").alias("end")).drop("island")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with its text without the runs that are copies of earlier ones, and lines_removed (0 if none, also for null text).

    Blank lines belong to no run; those inside a deleted run go with it. A text all of whose lines that aren't blank are copies
    becomes empty. Rows with the same id and text are one document: they stay alike, and aren't copies of each other. A
    null or empty text stays. Other columns pass through, whatever their names; one named lines_removed is replaced.
    """
    runs = copied_runs(docs, least_chars, id_column, text)
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"])))
    by_doc = runs.groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("runs")).select("d", "t", gone.alias("gone"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "lines_removed"]).alias("row"))
    rows = rows.select("row", F.xxhash64(F.col("row")[text]).alias("h"))
    joined = rows.join(by_doc, F.col("row")[id_column].eqNullSafe(by_doc["d"]) & (F.col("h") == by_doc["t"]), "left")
    split = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), _lines(F.col("row")[text])).alias("lines"))
    # Not a search of the runs for each line: the difference of two sets of numbers is taken by hash.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = split.select("row", "gone", F.transform(left, lambda i: F.get(F.col("lines"), i)).alias("kept"))
    solid = F.exists("kept", lambda x: F.length(F.trim(x)) > 0)
    now = F.when(F.col("gone").isNull(), F.col("row")[text]).when(solid, F.array_join("kept", "\n")).otherwise(F.lit(""))
    columns = [(now if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c != "lines_removed"]
    return kept.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"))
