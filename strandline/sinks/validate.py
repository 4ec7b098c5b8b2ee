"""Checks of written files: an OutputError for one that isn't what its format says. Lines and blocks are checked in parallel, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.errors import OutputError


def _refuse(bad: DataFrame, path: str, what: str) -> None:
    if bad.limit(1).count():
        raise OutputError(f"{path}: {what}")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Stretches of lines between blank ones."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", "^\n+|\n+$", "").alias("value")).where("value <> ''")


def sam(spark: SparkSession, path: str) -> None:
    lines = spark.read.text(path).where("value <> ''")
    _refuse(lines.where("value like '@%' and not value rlike '^@(HD\tVN:1[.]6|SQ\t|RG\t|PG\t|CO\t)'"), path, "an unknown header line")
    _refuse(lines.where("value not like '@%'").where(F.size(F.split("value", "\t")) < 11), path, "a record with fewer than 11 fields")
    if not lines.where("value like '@HD\tVN:1.6%'").limit(1).count():
        raise OutputError(f"{path}: no header")


def paf(spark: SparkSession, path: str) -> None:
    _refuse(spark.read.text(path).where("value <> ''").where(F.size(F.split("value", "\t")) < 12), path, "a record with fewer than 12 fields")


def delta(spark: SparkSession, path: str) -> None:
    head = [r[0] for r in spark.read.text(path).limit(2).collect()]
    if len(head) < 2 or not head[0] or head[1] != "NUCMER":
        raise OutputError(f"{path}: no header")


def maf(spark: SparkSession, path: str) -> None:
    head = [r[0] for r in spark.read.text(path).limit(1).collect()]
    if not head or not head[0].startswith("##maf version=1"):
        raise OutputError(f"{path}: no header")
    lines = F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#") & ~x.startswith("a score="))
    blocks = _blocks(spark, path).select(lines.alias("rows")).where(F.size("rows") > 0)
    f = F.transform("rows", lambda x: F.split(x, " +"))
    number = lambda x, k: F.get(x, F.lit(k)).try_cast("long")
    text = lambda x: F.get(x, F.lit(6))
    row_ok = lambda x: (F.size(x) == 7) & (x[0] == "s") & (x[1] != "") & x[4].isin("+", "-") & (number(x, 2) + number(x, 3) <= number(x, 5)) & (F.length(F.replace(text(x), F.lit("-"), F.lit(""))) == number(x, 3))
    pair_ok = (F.size("f") == 2) & (F.length(text(F.col("f")[0])) == F.length(text(F.col("f")[1]))) & F.forall("f", row_ok)
    _refuse(blocks.select(f.alias("f")).where(~F.coalesce(pair_ok, F.lit(False))), path, "a block that isn't two fitting rows")


def _closed(head: Column, body: Column) -> Column:
    """Whether the blocks of a chain take up just what its header spans: every one but the last has gaps behind it."""
    number = lambda x, k: F.get(x, F.lit(k)).try_cast("long")
    parts = F.transform(body, lambda x: F.split(x, "\\s+"))
    last = F.size(parts)
    shaped = F.forall(F.transform(parts, lambda x, i: (F.size(x) == F.when(i == last - 1, 1).otherwise(3)) & (number(x, 0) > 0)), lambda x: F.coalesce(x, F.lit(False)))
    total = lambda k: F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + number(x, 0) + F.coalesce(number(x, k), F.lit(0)))
    spans = (total(1) == number(head, 6) - number(head, 5)) & (total(2) == number(head, 11) - number(head, 10))
    inside = (number(head, 5) >= 0) & (number(head, 5) < number(head, 6)) & (number(head, 6) <= number(head, 3)) & (number(head, 10) >= 0) & (number(head, 10) < number(head, 11)) & (number(head, 11) <= number(head, 8))
    return (F.size(head) == 13) & (head[0] == "chain") & (head[4] == "+") & head[9].isin("+", "-") & (number(head, 12) != 0) & inside & (last > 0) & shaped & spans


def chain(spark: SparkSession, path: str) -> None:
    rows = _blocks(spark, path).select(F.split("value", "\n").alias("l"))
    ok = _closed(F.split(F.col("l")[0], " +"), F.slice("l", F.lit(2), F.size("l")))
    _refuse(rows.where(~F.coalesce(ok, F.lit(False))), path, "a chain whose blocks don't close its span")


CHECKS = {"sam": sam, "paf": paf, "delta": delta, "maf": maf, "chain": chain}


def check(spark: SparkSession, kind: str, path: str) -> None:
    CHECKS[kind](spark, path)
