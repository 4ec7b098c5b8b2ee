"""Segments of repeat-rich pairs as SAM, PAF, MAF and tables, as (part, at, line) like ``formats``.

Segments are those of ``operators.centromere.stitch``; references and queries are (seq_id, name, bases), a pair being equal ids. Lines come by
pair and segment; each SAM begins with the first pair's header, as a file holds one pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.errors import UsageError
from strandline.functions import cigar, kernels
from strandline.operators.centromere import disjoint_flags

# Names in tags and tables.
MODEL = "centrolign-3piece"
FORMATS = ("sam", "paf", "maf")
#: The largest number that a tag of type i holds.
INT = 2**31 - 1
SEGMENTS = ("segment_id", "path_id", "path_role", "region_id", "branch_id", "reference_begin", "reference_end", "query_begin", "query_end", "strand", "cigar", "score", "score_model", "edit_distance", "anchor_ids", "gap_ids")
GAPS = (
    "gap_id", "path_id", "path_role", "region_id", "branch_id", "left_anchor_id", "right_anchor_id", "reference_begin", "reference_end", "query_begin", "query_end", "strand", "status", "reason", "engine", "cigar", "score", "score_model", "dp_cells",
)


def _status(complete: DataFrame) -> DataFrame:
    return complete.select("pair_id", F.when(F.col("complete"), "complete").otherwise("partial").alias("st"))


def named(segments: DataFrame, reference: DataFrame, queries: DataFrame, complete: DataFrame) -> DataFrame:
    """Segments with names, lengths, counts and the part of the query they align, read along their strand. complete: (pair_id, complete)."""
    refs = reference.select(F.col("seq_id").alias("pair_id"), F.col("name").alias("ref_name"), F.length("bases").cast("long").alias("ref_n"), F.col("bases").alias("_r"))
    qs = queries.select(F.col("seq_id").alias("pair_id"), F.col("name").alias("query_name"), F.length("bases").cast("long").alias("query_n"), F.col("bases").alias("_q"))
    rows = segments.join(refs, "pair_id").join(qs, "pair_id").join(_status(complete), "pair_id", "left").withColumn("st", F.coalesce("st", F.lit("partial")))
    part = F.expr("substring(_q, int(qb + 1), int(qe - qb))")
    turned = F.reverse(F.translate(part, "ACGT", "TGCA"))
    rows = rows.withColumn("query_part", F.when(F.col("strand") == "+", part).otherwise(turned)).withColumn("ref_part", F.expr("substring(_r, int(rb + 1), int(re - rb))"))
    columns = F.aggregate("cigar", F.lit(0).cast("long"), lambda s, c: s + c["len"])
    at = F.row_number().over(Window.partitionBy("pair_id").orderBy("segment_id")).cast("long")
    return rows.drop("_r", "_q").withColumn("columns", columns).withColumn("at", at)


def _list(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _tags() -> list[Column]:
    z = lambda tag, c: F.concat(F.lit(f"{tag}:Z:"), c)
    score = F.col("score").cast("string")
    return [
        z("si", F.col("segment_id").cast("string")), z("pi", F.col("path_id").cast("string")), z("pr", F.col("path_role")), z("ri", F.col("region_id").cast("string")), z("bi", F.col("branch_id").cast("string")),
        z("sm", F.lit(MODEL)), z("st", F.col("st")), z("sc", score), F.when(F.col("edits") <= INT, F.concat(F.lit("NM:i:"), F.col("edits").cast("string"))).otherwise(z("ne", F.col("edits").cast("string"))),
        F.when(F.abs("score") <= INT, F.concat(F.lit("AS:i:"), score)), F.when(F.size("anchor_ids") > 0, z("ai", _list("anchor_ids"))), F.when(F.size("gap_ids") > 0, z("gi", _list("gap_ids"))),
    ]


def paf(rows: DataFrame) -> DataFrame:
    fields = ["query_name", "query_n", "qb", "qe", "strand", "ref_name", "ref_n", "rb", "re", "matches", "columns"]
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in fields], F.lit("255"), F.concat(F.lit("cg:Z:"), cigar.to_string(F.col("cigar"))), *_tags())
    return rows.select(F.lit(1).alias("part"), "at", line.alias("line"))


def sam(rows: DataFrame, reference: DataFrame, queries: DataFrame, complete: DataFrame) -> DataFrame:
    """The representative first, then primary paths, then copies; a pair without segments has one unmapped record with its whole query."""
    flagged = disjoint_flags(rows)
    first = F.col("flag").isin(0, 16)
    at = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.when(first, 0).when(F.col("path_role") == "primary", 1).otherwise(2), "segment_id")).cast("long")
    clips = cigar.sam_cigar(F.col("cigar"), F.col("qb"), F.col("qe"), F.col("query_n"), F.col("strand"))
    fields = [F.col("query_name"), F.col("flag"), F.col("ref_name"), F.col("rb") + 1, F.lit(255), clips, F.lit("*"), F.lit(0), F.lit(0), F.col("query_part"), F.lit("*")]
    records = flagged.withColumn("at", at).select(F.lit(1).alias("part"), "at", F.concat_ws("\t", *[f.cast("string") for f in fields], *_tags()).alias("line"))
    none = queries.select(F.col("seq_id").alias("pair_id"), "name", "bases").join(rows.select("pair_id").distinct(), "pair_id", "left_anti").join(_status(complete), "pair_id", "left")
    unmapped = F.concat_ws("\t", "name", F.lit("4\t*\t0\t0\t*\t*\t0\t0"), F.when(F.col("bases") == "", "*").otherwise(F.col("bases")), F.lit("*"), F.concat(F.lit("st:Z:"), F.coalesce("st", F.lit("partial"))))
    empty = none.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), unmapped.alias("line"))
    names = reference.select(F.lit(0).alias("part"), (F.col("seq_id") + 1).cast("long").alias("at"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), F.length("bases"))).alias("line"))
    notes = "@CO\tSegments only, hard clipped; pr tells primary paths from copies, flags tell the order of records."
    program = rows.sparkSession.createDataFrame([(0, 0, "@HD\tVN:1.6\tSO:unsorted"), (0, (1 << 62), "@PG\tID:strandline\tPN:strandline"), (0, (1 << 62) + 1, notes)], "part int, at long, line string")
    return program.union(names).union(records).union(empty)


def maf(rows: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", x string, y string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [kernels.gapped([(o["op"], int(o["len"])) for o in c], r, q) for c, r, q in zip(part["cigar"], part["ref_part"], part["query_part"], strict=True)]
            yield part.assign(x=[a for a, _ in made], y=[b for _, b in made])

    start = F.when(F.col("strand") == "+", F.col("qb")).otherwise(F.col("query_n") - F.col("qe"))
    made = rows.mapInPandas(run, schema)
    ref = F.concat_ws(" ", F.lit("s"), F.concat(F.lit("ref."), "ref_name"), F.col("rb").cast("string"), (F.col("re") - F.col("rb")).cast("string"), F.lit("+"), F.col("ref_n").cast("string"), "x")
    query = F.concat_ws(" ", F.lit("s"), F.concat(F.lit("query."), "query_name"), start.cast("string"), (F.col("qe") - F.col("qb")).cast("string"), "strand", F.col("query_n").cast("string"), "y")
    head = rows.sparkSession.createDataFrame([(0, 0, f"##maf version=1 scoring={MODEL}")], "part int, at long, line string")
    line = F.concat(F.lit("\n# "), F.concat_ws(" ", *[F.regexp_replace(t, "^(..):.:", "$1=") for t in _tags()]), F.lit("\na score="), F.col("score").cast("string"), F.lit("\n"), ref, F.lit("\n"), query)
    return head.union(made.select(F.lit(1).alias("part"), "at", line.alias("line")))


def lines(kind: str, segments: DataFrame, reference: DataFrame, queries: DataFrame, complete: DataFrame) -> DataFrame:
    if kind not in FORMATS:
        raise UsageError(f"segments can't be written as {kind!r}")
    rows = named(segments, reference, queries, complete)
    return {"paf": lambda: paf(rows), "sam": lambda: sam(rows, reference, queries, complete), "maf": lambda: maf(rows)}[kind]()


def table_lines(rows: DataFrame, columns: tuple[str, ...], order: list[str]) -> DataFrame:
    """A tab-separated table with a header, escaped; null is NA."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n"), "\r", r"\\r")
    at = F.row_number().over(Window.orderBy(*order)).cast("long")
    body = rows.withColumn("at", at).select(F.lit(1).alias("part"), "at", F.concat_ws("\t", *[F.coalesce(escaped(F.col(c).cast("string")), F.lit("NA")) for c in columns]).alias("line"))
    return rows.sparkSession.createDataFrame([(0, 0, "\t".join(columns))], "part int, at long, line string").union(body)


def segment_table(segments: DataFrame) -> DataFrame:
    """The table of segments, 16 columns."""
    names = {"rb": "reference_begin", "re": "reference_end", "qb": "query_begin", "qe": "query_end", "edits": "edit_distance"}
    rows = segments.withColumns({"cigar": cigar.to_string(F.col("cigar")), "anchor_ids": _list("anchor_ids"), "gap_ids": _list("gap_ids"), "score_model": F.lit(MODEL)}).withColumnsRenamed(names)
    return table_lines(rows, SEGMENTS, ["pair_id", "segment_id"])


def gap_table(gaps: DataFrame) -> DataFrame:
    """The table of gaps between anchors: the columns that don't depend on the machine."""
    names = {"rb": "reference_begin", "re": "reference_end", "qb": "query_begin", "qe": "query_end"}
    rows = gaps.withColumns({"cigar": cigar.to_string(F.col("cigar")), "score_model": F.lit(MODEL)}).withColumnsRenamed(names)
    return table_lines(rows, GAPS, ["pair_id", "gap_id"])
