"""Columns over CIGARs: arrays of (op, len) with the operations = X I D; I is query only, D is reference only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<op:string,len:bigint>>"
#: BAM holds an operation's length in 28 bits.
LONGEST = (1 << 28) - 1


def parsed(text: Column) -> Column:
    """A CIGAR's string as an array; ``*`` and the empty string are empty."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, r"^\d+", 0).cast("long").alias("len")))


def to_string(cigar: Column) -> Column:
    joined = F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    return F.when(F.size(cigar) > 0, joined).otherwise(F.lit("*"))


def _total(cigar: Column, ops: str) -> Column:
    return F.aggregate(cigar, F.lit(0).cast("long"), lambda a, c: a + F.when(F.instr(F.lit(ops), c["op"]) > 0, c["len"]).otherwise(F.lit(0)))


def reference_length(cigar: Column) -> Column:
    return _total(cigar, "M=XD")


def query_length(cigar: Column) -> Column:
    return _total(cigar, "M=XI")


def matches(cigar: Column) -> Column:
    return _total(cigar, "=")


def edits(cigar: Column) -> Column:
    return _total(cigar, "XID")


def columns_(cigar: Column) -> Column:
    return _total(cigar, "M=XID")


def merged(cigar: Column) -> Column:
    """Neighbours of the same operation made one, empty ones left out."""
    start = F.array().cast(TYPE)

    def add(out: Column, c: Column) -> Column:
        same = F.element_at(out, -1)["op"] == c["op"]
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(c["op"].alias("op"), (F.element_at(out, -1)["len"] + c["len"]).alias("len"))))
        appended = F.concat(out, F.array(F.struct(c["op"].alias("op"), c["len"].alias("len"))))
        return F.when(c["len"] <= 0, out).when(F.size(out) == 0, appended).when(same, grown).otherwise(appended)

    return F.aggregate(cigar, start, add)


def split_long(cigar: Column, most: int = LONGEST) -> Column:
    """Operations of more than ``most`` in pieces."""

    def pieces(c: Column) -> Column:
        whole = F.floor((c["len"] - 1) / F.lit(most)).cast("int")
        return F.transform(F.sequence(F.lit(0), whole), lambda k: F.struct(c["op"].alias("op"), F.when(k < whole, F.lit(most).cast("long")).otherwise(c["len"] - whole * F.lit(most)).alias("len")))

    return F.flatten(F.transform(F.filter(cigar, lambda c: c["len"] > 0), pieces))


def sam_cigar(cigar: Column, query_begin: Column, query_end: Column, query_size: Column, strand: Column) -> Column:
    """The string with hard clips; on the reverse strand what is before the aligned part of the query comes last."""
    before = F.when(strand == "+", query_begin).otherwise(query_size - query_end)
    after = F.when(strand == "+", query_size - query_end).otherwise(query_begin)
    clip = lambda n: F.filter(F.array(F.struct(F.lit("H").alias("op"), n.cast("long").alias("len"))), lambda c: c["len"] > 0)
    return to_string(split_long(F.concat(clip(before), cigar, clip(after))))


def deltas(cigar: Column) -> Column:
    """Signed distances between gap columns: positive for a base of the reference only, negative for one of the query only; 0 ends them.

    Of several gap columns in a row all but the first are at distance 1.
    """
    zero = F.struct(F.lit(0).cast("long").alias("run"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        gap = (c["op"] == "I") | (c["op"] == "D")
        sign = F.when(c["op"] == "D", F.lit(1)).otherwise(F.lit(-1))
        first = F.array(sign * (s["run"] + 1))
        rest = F.when(c["len"] > 1, F.transform(F.sequence(F.lit(2).cast("long"), c["len"]), lambda _: sign.cast("long"))).otherwise(F.array().cast("array<bigint>"))
        grown = F.concat(s["out"], first.cast("array<bigint>"), rest)
        return F.struct(F.when(gap, F.lit(0).cast("long")).otherwise(s["run"] + c["len"]).alias("run"), F.when(gap & (c["len"] > 0), grown).otherwise(s["out"]).alias("out"))

    return F.concat(F.aggregate(cigar, zero, step, lambda s: s["out"]), F.array(F.lit(0).cast("long")))


BLOCK_TYPE = "array<struct<size:bigint,dt:bigint,dq:bigint>>"


def chain_blocks(cigar: Column) -> Column:
    """(size, dt, dq): ungapped blocks and the gaps in reference and query after each; gaps at either end are left out, the last block has 0, 0."""
    zero = F.struct(F.array().cast(BLOCK_TYPE).alias("out"))

    def step(s: Column, c: Column) -> Column:
        out = s["out"]
        last = F.element_at(out, -1)
        paired = F.instr(F.lit("M=X"), c["op"]) > 0
        fresh = F.array(F.struct(c["len"].alias("size"), F.lit(0).cast("long").alias("dt"), F.lit(0).cast("long").alias("dq")))
        but_last = F.slice(out, 1, F.size(out) - 1)
        grow = F.array(F.struct((last["size"] + c["len"]).alias("size"), F.lit(0).cast("long").alias("dt"), F.lit(0).cast("long").alias("dq")))
        gap = F.array(F.struct(last["size"].alias("size"), (last["dt"] + F.when(c["op"] == "D", c["len"]).otherwise(F.lit(0))).alias("dt"), (last["dq"] + F.when(c["op"] == "I", c["len"]).otherwise(F.lit(0))).alias("dq")))
        joined = F.when(F.size(out) == 0, F.when(paired, fresh).otherwise(out)).when(paired & (last["dt"] + last["dq"] == 0), F.concat(but_last, grow)).when(paired, F.concat(out, fresh)).otherwise(F.concat(but_last, gap))
        return F.struct(F.when(c["len"] > 0, joined).otherwise(out).alias("out"))

    def trimmed(s: Column) -> Column:
        out = s["out"]
        last = F.element_at(out, -1)
        end = F.array(F.struct(last["size"].alias("size"), F.lit(0).cast("long").alias("dt"), F.lit(0).cast("long").alias("dq")))
        return F.when(F.size(out) > 0, F.concat(F.slice(out, 1, F.size(out) - 1), end)).otherwise(out)

    return F.aggregate(cigar, zero, step, trimmed)
