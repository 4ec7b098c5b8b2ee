"""SAM, PAF, MAF, delta and chain from alignments, as (part, at, line): the header is part 0; lines are written in order of part and at.

Alignments are rows of ``operators.link.ALIGNMENT`` with primary; references and queries are (seq_id, name, bases).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.errors import InputError, OutputError, UsageError
from strandline.functions import cigar, kernels
from strandline.operators.link import only, stretches
from strandline.operators.select import ORDER

FORMATS = ("sam", "paf", "maf", "delta", "chain")


def escaped(c: Column) -> Column:
    """A name without what would break a line or field: tabs and line ends are spaces."""
    return F.regexp_replace(c, "[\t\r\n]", " ")


#: Sequences in a group whose sizes are summed up together.
GROUP = 65_536


def numbered(rows: DataFrame, order: list[str], name: str = "at") -> DataFrame:
    """With ``name``, from 1 in this order, whose first column is a sequence's id.

    A row's number is its place among those of its sequence and the rows of all sequences before: sums of sums by groups of sequences, so no task
    sees more than the rows of one sequence, the sequences of one group, or the groups.
    """
    by = order[0]
    rows = rows.persist()  # read for the sizes too
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n")).withColumn("_group", F.floor(F.col(by) / GROUP))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("_group").agg(F.sum("_n").alias("_n")).select("_group", before(Window.orderBy("_group")).alias("_base"))
    begins = sizes.withColumn("_inner", before(Window.partitionBy("_group").orderBy(by))).join(groups, "_group").select(by, (F.col("_base") + F.col("_inner")).alias("_before"))
    own = rows.withColumn("_row", F.row_number().over(Window.partitionBy(by).orderBy(*order[1:])))
    return own.join(begins, by).withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_row", "_before")


def _placed(rows: DataFrame, reference: DataFrame, queries: DataFrame, order: list[str] | None = None) -> DataFrame:
    rows = rows.persist()  # as in numbered
    refs = only(reference, rows, "ref_id").select(F.col("seq_id").alias("ref_id"), escaped(F.col("name")).alias("ref_name"), F.length("bases").cast("long").alias("ref_n"))
    qs = queries.select(F.col("seq_id").alias("query_id"), escaped(F.col("name")).alias("query_name"), F.length("bases").cast("long").alias("query_n"))
    return numbered(rows, order or ORDER).join(refs, "ref_id").join(qs, "query_id")


def _header(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(0, k, x) for k, x in enumerate(lines)], "part int, at long, line string")


def _lines(rows: DataFrame, line: Column) -> DataFrame:
    return rows.select(F.lit(1).alias("part"), "at", line.alias("line"))


def paf(rows: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    placed = _placed(rows, reference, queries)
    tags = [F.concat(F.lit("cg:Z:"), cigar.to_string(F.col("cigar"))), F.concat(F.lit("NM:i:"), "edits"), F.concat(F.lit("AS:i:"), "score"), F.concat(F.lit("tp:A:"), F.when(F.col("primary"), "P").otherwise("S"))]
    fields = ["query_name", "query_n", "qb", "qe", "strand", "ref_name", "ref_n", "rb", "re", "matches", "columns"]
    return _lines(placed, F.concat_ws("\t", *[F.col(c).cast("string") for c in fields], F.lit("255"), *tags))


def _with_text(rows: DataFrame, reference: DataFrame, queries: DataFrame, what: str) -> DataFrame:
    """With a text made by a kernel from the CIGAR and both stretches."""
    bases = stretches(rows, reference, queries)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", x string, y string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x, y = [], []
            for c, ref, query, strand in zip(part["cigar"], part["ref_part"], part["query_part"], part["strand"], strict=True):
                path = [(o["op"], int(o["len"])) for o in c]
                if what == "md":
                    x.append(kernels.md_tag(path, ref))
                    y.append("")
                else:
                    a, b = kernels.gapped(path, ref, query if strand == "+" else kernels.reverse_complement(query))
                    x.append(a)
                    y.append(b)
            yield part.drop(columns=["ref_part", "query_part"]).assign(x=x, y=y)

    return bases.mapInPandas(run, schema)


def sam(rows: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    placed = _placed(rows, reference, queries)
    # Without bases of the reference that the query hasn't, MD is the number of matches.
    plain = ~F.exists("cigar", lambda c: c["op"].isin("X", "D"))
    matched = F.aggregate("cigar", F.lit(0).cast("long"), lambda n, c: n + F.when(c["op"] == "=", c["len"]).otherwise(0))
    other = rows.where(~plain).limit(1).count()
    short = (placed.where(plain) if other else placed).withColumn("x", matched.cast("string"))
    placed = short.unionByName(_with_text(placed.where(~plain), reference, queries, "md").drop("y")) if other else short
    names = reference.select(F.lit(0).alias("part"), (F.col("seq_id") + 1).cast("long").alias("at"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), escaped(F.col("name"))), F.concat(F.lit("LN:"), F.length("bases"))).alias("line"))
    program = spark.createDataFrame([(0, 0, "@HD\tVN:1.6\tSO:unknown"), (0, (1 << 62), "@PG\tID:strandline\tPN:strandline")], "part int, at long, line string")
    flag = F.when(F.col("strand") == "-", 16).otherwise(0) + F.when(F.col("primary"), 0).otherwise(2048)
    clips = cigar.sam_cigar(F.col("cigar"), F.col("qb"), F.col("qe"), F.col("query_n"), F.col("strand"))
    fields = [F.col("query_name"), flag, F.col("ref_name"), F.col("rb") + 1, F.lit(255), clips, F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), "edits"), F.concat(F.lit("MD:Z:"), "x"), F.concat(F.lit("AS:i:"), "score")]
    return program.union(names).union(_lines(placed, F.concat_ws("\t", *[f.cast("string") for f in fields])))


def maf(rows: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    placed = _with_text(_placed(rows, reference, queries), reference, queries, "maf")
    start = F.when(F.col("strand") == "+", F.col("qb")).otherwise(F.col("query_n") - F.col("qe"))
    ref = F.concat_ws(" ", F.lit("s"), "ref_name", F.col("rb").cast("string"), (F.col("re") - F.col("rb")).cast("string"), F.lit("+"), F.col("ref_n").cast("string"), "x")
    query = F.concat_ws(" ", F.lit("s"), "query_name", start.cast("string"), (F.col("qe") - F.col("qb")).cast("string"), "strand", F.col("query_n").cast("string"), "y")
    return _header(rows.sparkSession, ["##maf version=1"]).union(_lines(placed, F.concat(F.lit("\na score="), F.col("score").cast("string"), F.lit("\n"), ref, F.lit("\n"), query)))


def delta(rows: DataFrame, reference: DataFrame, queries: DataFrame, paths: tuple[str, str] = ("reference", "query")) -> DataFrame:
    order = ["ref_id", *ORDER]
    placed = _placed(rows, reference, queries, order)
    new = F.row_number().over(Window.partitionBy("ref_id", "query_id").orderBy("at")) == 1  # a pair's rows follow each other
    first, last = F.when(F.col("strand") == "+", F.col("qb") + 1).otherwise(F.col("qe")), F.when(F.col("strand") == "+", F.col("qe")).otherwise(F.col("qb") + 1)
    pair = F.when(new, F.concat_ws(" ", F.concat(F.lit(">"), "ref_name"), "query_name", F.col("ref_n").cast("string"), F.concat(F.col("query_n").cast("string"), F.lit("\n")))).otherwise(F.lit(""))
    place = F.concat_ws(" ", *[c.cast("string") for c in (F.col("rb") + 1, F.col("re"), first, last, F.col("edits"), F.col("edits"), F.lit(0))])
    steps = F.array_join(F.transform(cigar.deltas(F.col("cigar")), lambda n: n.cast("string")), "\n")
    return _header(rows.sparkSession, [" ".join(paths), "NUCMER"]).union(_lines(placed, F.concat(pair, place, F.lit("\n"), steps)))


def chain(rows: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    placed = _placed(rows, reference, queries)
    blocks = cigar.chain_blocks(F.col("cigar"))
    plus = F.col("strand") == "+"
    # Gaps at either end are left out of the blocks, so the ends move in.
    edge = lambda k: F.when((F.element_at("cigar", k)["op"] == "D") | (F.element_at("cigar", k)["op"] == "I"), F.element_at("cigar", k)["len"]).otherwise(0)
    side = lambda k, op: F.when(F.element_at("cigar", k)["op"] == op, edge(k)).otherwise(0)
    qb = F.when(plus, F.col("qb")).otherwise(F.col("query_n") - F.col("qe"))
    qe = F.when(plus, F.col("qe")).otherwise(F.col("query_n") - F.col("qb"))
    head = [F.lit("chain"), F.greatest("score", F.lit(0)), F.col("ref_name"), F.col("ref_n"), F.lit("+"), F.col("rb") + side(1, "D"), F.col("re") - side(-1, "D"), F.col("query_name"), F.col("query_n"), F.col("strand"), qb + side(1, "I"), qe - side(-1, "I"), F.col("at")]
    text = F.transform(blocks, lambda b, i: F.when(i < F.size(blocks) - 1, F.concat_ws("\t", b["size"].cast("string"), b["dt"].cast("string"), b["dq"].cast("string"))).otherwise(b["size"].cast("string")))
    return _lines(placed.where(F.size(blocks) > 0), F.concat(F.concat_ws(" ", *[c.cast("string") for c in head]), F.lit("\n"), F.array_join(text, "\n"), F.lit("\n")))


def lines(kind: str, rows: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    if kind not in FORMATS:
        raise UsageError(f"unknown format {kind!r}")
    return {"sam": sam, "paf": paf, "maf": maf, "delta": delta, "chain": chain}[kind](rows, reference, queries)


def publish(text: DataFrame, path: str) -> None:
    """The lines, in order, as one file at ``path``, which mustn't exist: written beside it and renamed, so it is there whole or not at all."""
    spark = text.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise OutputError(f"{path} exists")
    staging = jvm.org.apache.hadoop.fs.Path(f"{path}.staging")
    try:
        text.orderBy("part", "at").select("line").coalesce(1).write.mode("overwrite").text(f"{path}.staging")
        part = next(s.getPath() for s in fs.listStatus(staging) if s.getPath().getName().startswith("part-"))
        if fs.exists(target) or not fs.rename(part, target):
            raise OutputError(f"{path} can't be put in place")
    finally:
        fs.delete(staging, True)


def withdrawn(spark: SparkSession, path: str) -> None:
    """Take back a file that was put in place."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """query, query_n, qb, qe, strand, ref, ref_n, rb, re, matches, columns, cigar of a PAF's lines; an InputError if one has too few fields."""
    parts = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("f"), "value")
    if parts.where(F.size("f") < 12).limit(1).count():
        raise InputError(f"{path}: a line has fewer than 12 fields")
    names = ("query", "query_n", "qb", "qe", "strand", "ref", "ref_n", "rb", "re", "matches", "columns")
    columns = [F.col("f")[k].cast("string" if n in ("query", "strand", "ref") else "long").alias(n) for k, n in enumerate(names)]
    return parts.select(*columns, cigar.parsed(F.regexp_extract("value", r"\tcg:Z:([^\t]+)", 1)).alias("cigar"))


def aligned_pairs(rows: DataFrame, ref: str = "ref_id", query: str = "query_id") -> DataFrame:
    """(ref, query, strand, r, q): the pairs of places that the CIGARs put together, on the forward query; for replaying formats."""
    state = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<r:bigint,q:bigint,n:bigint>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        paired = F.instr(F.lit("M=X"), c["op"]) > 0
        block = F.array(F.struct(s["r"].alias("r"), s["q"].alias("q"), c["len"].alias("n")))
        return F.struct((s["r"] + F.when(c["op"] == "I", F.lit(0)).otherwise(c["len"])).alias("r"), (s["q"] + F.when(c["op"] == "D", F.lit(0)).otherwise(c["len"])).alias("q"), F.when(paired, F.concat(s["out"], block)).otherwise(s["out"]).alias("out"))

    blocks = rows.select(ref, query, "strand", "rb", "qb", "qe", F.explode(F.aggregate("cigar", state, step, lambda s: s["out"])).alias("b"))
    single = blocks.select(ref, query, "strand", "rb", "qb", "qe", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.n") - 1)).alias("k"))
    q = F.when(F.col("strand") == "+", F.col("qb") + F.col("b.q") + F.col("k")).otherwise(F.col("qe") - 1 - F.col("b.q") - F.col("k"))
    return single.select(ref, query, "strand", (F.col("rb") + F.col("b.r") + F.col("k")).alias("r"), q.alias("q"))
