"""Columns over nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import words

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()


def normalized(text: Column) -> Column:
    """Letters A-Z upper-cased, everything but A, C, G, T made N. ASCII only: other letters are N too."""
    return F.regexp_replace(F.translate(text, _LOWER, _UPPER), "[^ACGT]", "N")


def ambiguous(bases: Column) -> Column:
    """How many bases are N."""
    return F.length(bases) - F.length(F.translate(bases, "N", ""))


def reverse_complement(bases: Column) -> Column:
    """Reverse complement; what isn't canonical becomes N."""
    return F.reverse(F.regexp_replace(F.translate(bases, "ACGTacgt", "TGCATGCA"), "[^ACGT]", "N"))


def is_canonical(base: Column) -> Column:
    return base.rlike("^[ACGTacgt]$")


def folded(text: Column) -> Column:
    """The letters a-z and A-Z of a text, mapped to A, C, G, T in turn: a way to get sequences from prose."""
    cycle = ("ACGT" * 7)[:26]
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), _LOWER + _UPPER, cycle + cycle)


#: Two bits a base fit a long up to this length.
MOST_PACKED = 31
#: Words of a collection of up to so many bases are sent to all tasks (8 bytes each).
BROADCAST_WORDS = 500_000


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, for MOST_PACKED bases or fewer; sorts as the string does among equal lengths."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def kmers(sequences: DataFrame, k: int, id_column: str = "seq_id", bases: str = "bases", packed: bool = False) -> DataFrame:
    """(id, pos, kmer) of every window of k canonical bases; ``packed``, the k-mer is a long of two bits a base."""
    n = F.length(bases)
    # As bytes: a place in a string is found by counting characters from its begin, one in bytes at once.
    rows = sequences.select(id_column, F.col(bases).cast("binary").alias("_bytes"), F.explode(F.when(n >= k, F.sequence(F.lit(0), n - k))).alias("pos"))
    kmer = F.expr(f"cast(substring(_bytes, pos + 1, {k}) as string)")
    found = rows.select(id_column, F.col("pos").cast("long").alias("pos"), kmer.alias("kmer")).where(~F.contains("kmer", F.lit("N")))
    return found.withColumn("kmer", kmer_code(F.col("kmer"))) if packed else found


def canonical_runs(sequences: DataFrame, id_column: str = "seq_id", bases: str = "bases") -> DataFrame:
    """(id, begin, end) of the maximal runs of canonical bases."""
    pieces = sequences.select(id_column, F.posexplode(F.regexp_extract_all(bases, F.lit("N+|[ACGT]+"), F.lit(0))).alias("piece", "s"))
    so_far = Window.partitionBy(id_column).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("end", F.sum(F.length("s")).over(so_far))
    return placed.where(~F.startswith("s", F.lit("N"))).select(id_column, (F.col("end") - F.length("s")).alias("begin"), "end")


def kmer_counts(sequences: DataFrame, k: int, bases: str = "bases", id_column: str = "seq_id") -> DataFrame:
    """(kmer, n) over all sequences: overlapping occurrences count each."""
    return kmers(sequences, k, id_column, bases).groupBy("kmer").agg(F.count("*").alias("n"))


def unique_words(left: DataFrame, right: DataFrame, k: int = 32) -> DataFrame:
    """(kmer, left_id, left_pos, right_id, right_pos): words that occur once in each of two collections.

    Only words that occur once on the right can be in the result, so of the left no others are counted. They go to all tasks up to
    BROADCAST_WORDS bases on the right; beyond that, and for k above 32, both sides are shuffled.
    """
    short = k <= words.MOST

    def once(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("kmer").agg(F.count("*").alias("n"), F.min("seq_id").alias(f"{name}_id"), F.min("pos").alias(f"{name}_pos")).where("n = 1").drop("n")

    if not short:
        return once(kmers(left, k), "left").join(once(kmers(right, k), "right"), "kmer")
    others = once(words.words(right, k), "right")
    if (right.agg(F.sum(F.length("bases"))).first()[0] or 0) <= BROADCAST_WORDS:
        others = others.persist()
        found = once(words.words(left, k, others), "left").join(F.broadcast(others), "kmer")
    else:
        found = once(words.words(left, k), "left").join(others, "kmer")
    letters = F.translate(F.lpad(F.conv(F.hex("kmer"), 16, 4), k, "0"), "0123", "ACGT")
    return found.select(letters.alias("kmer"), "left_id", "left_pos", "right_id", "right_pos")


def fingerprint(bases: Column) -> Column:
    """Tells one record's content from another's."""
    return F.sha2(bases, 256)
