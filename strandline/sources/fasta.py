"""FASTA, plain or gzip, as DataFrames.

Records are split by Spark's text source at line starts with ``>``, so a plain file is read in parallel; gzip isn't
splittable and is read by one task a file. Suffixes and first bytes are checked before anything is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.errors import InputError, UnsupportedError
from strandline.functions.sequence import ambiguous, normalized

SCHEMA = "seq_id long, name string, header string, bases string, length long, ambiguous long"
#: First bytes of compressed files, and what each is.
MAGIC = {"gzip": b"\x1f\x8b", "xz": b"\xfd7zXZ\x00", "bzip2": b"BZh", "zstd": b"\x28\xb5\x2f\xfd", "zip": b"PK\x03\x04"}


def compression(spark: SparkSession, path: str) -> str:
    """``plain`` or ``gzip``; other compression is unsupported, and a .gz suffix without gzip's first bytes an error."""
    context = spark.sparkContext
    jvm = context._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(place):
        raise InputError(f"{path}: no such file")
    files = [place] if not fs.getFileStatus(place).isDirectory() else [s.getPath() for s in fs.listStatus(place) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    kinds = set()
    for f in files:
        stream = fs.open(f)
        try:
            head = bytes(b & 0xFF for b in (stream.read() for _ in range(6)) if b >= 0)
        finally:
            stream.close()
        kind = next((k for k, m in MAGIC.items() if head.startswith(m)), "plain")
        if f.getName().endswith((".gz", ".bgz")) and kind != "gzip":
            raise InputError(f"{f.getName()}: not gzip, in spite of its suffix")
        kinds.add(kind)
    if odd := kinds - {"plain", "gzip"}:
        raise UnsupportedError(f"{path}: {', '.join(sorted(odd))} isn't supported")
    return "gzip" if "gzip" in kinds else "plain"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(raw, at): each record's text without its ``>``, and an order that follows the file."""
    compression(spark, path)
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("at", F.monotonically_increasing_id())
    return raw.select(F.col("value").alias("raw"), "at")


def read_fasta(spark: SparkSession, path: str, first_id: int = 0, check: bool = True) -> DataFrame:
    """SCHEMA of the records of a file (or of a folder of files), numbered in file order from ``first_id``.

    The name is the header's first word. Letters are upper-cased, all but A, C, G, T become N. With ``check`` an
    InputError says what is wrong: no record, text before the first header, a header without a name, a record without
    bases, characters that aren't letters, or a name that occurs twice.
    """
    rows = records(spark, path)
    begin = F.when(F.startswith("raw", F.lit(">")), F.substring(F.col("raw"), F.lit(2), F.length("raw"))).otherwise(F.col("raw"))
    body = rows.select("at", F.startswith("raw", F.lit(">")).alias("marked"), begin.alias("raw"))
    head = F.regexp_replace(F.substring_index("raw", "\n", 1), "\r$", "")
    rest = F.when(F.instr("raw", "\n") > 0, F.substring(F.col("raw"), F.instr("raw", "\n") + 1, F.length("raw"))).otherwise(F.lit(""))
    parsed = body.select("at", "marked", head.alias("header"), F.regexp_replace(rest, "[\r\n]", "").alias("letters"))
    parsed = parsed.withColumn("name", F.regexp_extract("header", r"^(\S+)", 1))
    if check:
        bad = parsed.agg(
            F.count("*").alias("n"),
            F.count_if(F.col("name") == "").alias("unnamed"),
            F.count_if(F.col("letters") == "").alias("empty"),
            F.count_if(F.col("letters").rlike("[^A-Za-z]")).alias("odd"),
            F.min_by("marked", "at").alias("marked"),
        ).first()
        if not bad["n"]:
            raise InputError(f"{path}: no record")
        for what, n in (("begin with a header", 0 if bad["marked"] else 1), ("have a name", bad["unnamed"]), ("have bases", bad["empty"]), ("hold letters only", bad["odd"])):
            if n:
                raise InputError(f"{path}: its records must {what}")
        again = parsed.groupBy("name").count().where("count > 1").limit(1).collect()
        if again:
            raise InputError(f"{path}: {again[0]['name']} occurs twice")
    # Numbers in file order: counts before each partition, then ranks within it.
    part = F.shiftright("at", 33)
    counts = parsed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    bases = normalized(F.col("letters"))
    numbered = parsed.withColumn("part", part).join(F.broadcast(before), "part")
    return numbered.select((F.col("base") + own + first_id).alias("seq_id"), "name", "header", bases.alias("bases"), F.length("letters").cast("long").alias("length"), ambiguous(bases).cast("long").alias("ambiguous"))


def write_fasta(rows: DataFrame, path: str, width: int = 80) -> None:
    """(name, bases) as FASTA text, one file a partition."""
    wrapped = F.regexp_replace("bases", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value")).write.text(path)
