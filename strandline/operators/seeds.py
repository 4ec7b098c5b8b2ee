"""Exact-match seeds between two collections of sequences as joins.

A maximal exact match is an island of k-mer hits on one diagonal, so an equi join on k-mers and one window give all
of them, whatever the partitioning; few queries go to the references instead, and nothing is shuffled. Whether a match's string occurs elsewhere in the reference shows in the matches
themselves: an occurrence elsewhere is part of another match of the same query stretch, which contains this one's
stretch. So uniqueness is a running maximum, without joining the reference to itself.

Seeds: (ref_id, rb, query_id, qb, len, strand); rb and qb count from 0, qb is always on the forward query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import MOST_PACKED, kmers, reverse_complement
from strandline.functions.words import MOST, matches, words
from strandline.operators.intervals import contained, covered_by, union

MODES = ("fast", "mumreference", "mum", "smem", "maxmatch")
MIN_MATCH = 20
#: Query k-mers are broadcast up to this number (about 50 bytes each), else both sides are shuffled.
BROADCAST_KMERS = 500_000
KEY = ["ref_id", "query_id", "strand"]


def oriented(queries: DataFrame) -> DataFrame:
    """(query_id, strand, length, bases) of both strands of (seq_id, bases)."""
    forward = queries.select(F.col("seq_id").alias("query_id"), F.lit("+").alias("strand"), F.length("bases").cast("long").alias("length"), "bases")
    return forward.union(forward.select("query_id", F.lit("-"), "length", reverse_complement(F.col("bases"))))


def mems(reference: DataFrame, queries: DataFrame, k: int = MIN_MATCH, strands: str = "+-", indexed: DataFrame | None = None) -> DataFrame:
    """All maximal exact matches of k bases or more, with oqb and oqe, the stretch of the oriented query.

    reference and queries: (seq_id, bases). ``indexed`` has the reference's k-mers (seq_id, pos, kmer), packed if k allows, as an index keeps them.
    """
    both = oriented(queries).where(F.col("strand").isin(*strands))
    total = both.agg(F.sum("length")).first()[0] or 0
    if indexed is None and k <= MOST and total <= BROADCAST_KMERS:
        return matches(reference, both, k)
    packed = k <= MOST_PACKED
    query_kmers = kmers(both.withColumn("id", F.struct("query_id", "strand", "length")), k, "id", packed=packed)
    query_kmers = query_kmers.select("kmer", F.col("pos").alias("j"), "id.*")
    if total <= BROADCAST_KMERS:
        query_kmers = F.broadcast(query_kmers)
    if indexed is None:
        indexed = words(reference, k) if packed else kmers(reference, k)
    own = indexed
    hits = own.select("kmer", F.col("pos").alias("i"), F.col("seq_id").alias("ref_id")).join(query_kmers, "kmer").drop("kmer")
    diagonal = Window.partitionBy(*KEY, "diagonal").orderBy("i")
    marked = hits.withColumn("diagonal", F.col("i") - F.col("j")).withColumn("island", F.col("i") - F.row_number().over(diagonal))
    found = marked.groupBy(*KEY, "diagonal", "island").agg(F.min("i").alias("rb"), F.min("j").alias("oqb"), (F.count("*") + (k - 1)).alias("len"), F.first("length").alias("length"))
    end = F.col("oqb") + F.col("len")
    forward = F.when(F.col("strand") == "+", F.col("oqb")).otherwise(F.col("length") - end)
    return found.select("ref_id", "rb", "query_id", forward.alias("qb"), "len", "strand", "oqb", end.alias("oqe"))


def mams(found: DataFrame) -> DataFrame:
    """Matches whose string occurs once in the reference collection (forward text)."""
    return found.withColumn("_in", contained(found, ["query_id", "strand"], "oqb", "oqe")).where(~F.col("_in")).drop("_in")


def mums(found: DataFrame) -> DataFrame:
    """Of those, the ones whose string also occurs once in their oriented query."""
    ends = found.withColumn("_re", F.col("rb") + F.col("len"))
    in_reference = contained(ends, ["query_id", "strand"], "oqb", "oqe")
    in_query = contained(ends, KEY, "rb", "_re")
    return ends.withColumn("_a", in_reference).withColumn("_b", in_query).where(~F.col("_a") & ~F.col("_b")).drop("_a", "_b", "_re")


def smems(found: DataFrame, k: int = MIN_MATCH, least: int = 1) -> DataFrame:
    """Stretches of a query that occur ``least`` times or more in the reference and lie in no longer such one, at all their places.

    For one occurrence these are the matches in no longer match. In general the stretch from i reaches as far as the
    ``least``-th longest match that covers i; it counts where it reaches further than the one from i - 1.
    """
    if least <= 1:
        return found.withColumn("_in", contained(found, ["query_id", "strand"], "oqb", "oqe", strictly=True)).where(~F.col("_in")).drop("_in")
    at = ["query_id", "strand"]
    starts = found.select(*at, F.col("oqb").alias("i")).distinct()
    both = starts.withColumn("p", F.explode(F.array(F.col("i"), F.col("i") - 1)))
    spans = found.select(*at, "oqb", "oqe")
    covering = both.join(spans, at).where((F.col("oqb") <= F.col("p")) & (F.col("oqe") - F.col("p") >= k))
    ranked = covering.withColumn("at", F.row_number().over(Window.partitionBy(*at, "i", "p").orderBy(F.desc("oqe")))).where(F.col("at") == least)
    reach = ranked.groupBy(*at, "i").agg(F.max(F.when(F.col("p") == F.col("i"), F.col("oqe"))).alias("reach"), F.max(F.when(F.col("p") < F.col("i"), F.col("oqe"))).alias("before"))
    kept = reach.where(F.col("reach").isNotNull() & (F.col("before").isNull() | (F.col("reach") > F.col("before")))).select(*at, "i", "reach")
    placed = found.join(kept, at).where((F.col("oqb") <= F.col("i")) & (F.col("oqe") >= F.col("reach")))
    n = F.col("reach") - F.col("i")
    shifted = F.when(F.col("strand") == "+", F.col("qb") + F.col("i") - F.col("oqb")).otherwise(F.col("qb") + F.col("oqe") - F.col("reach"))
    return placed.select("ref_id", (F.col("rb") + F.col("i") - F.col("oqb")).alias("rb"), "query_id", shifted.alias("qb"), n.alias("len"), "strand", F.col("i").alias("oqb"), F.col("reach").alias("oqe")).distinct()


def fast(found: DataFrame) -> DataFrame:
    """The unique matches, and of the others those not inside the merged stretches that the unique ones cover."""
    unique = mams(found)
    span = lambda df: df.withColumn("begin", F.col("qb")).withColumn("end", F.col("qb") + F.col("len"))
    cover = union(span(unique), ["query_id", "strand"])
    rest = covered_by(span(found), cover, ["query_id", "strand"]).where(~F.col("covered")).drop("covered", "begin", "end")
    return unique.unionByName(rest)


def seeds(reference: DataFrame, queries: DataFrame, mode: str = "fast", k: int = MIN_MATCH, least: int = 1, indexed: DataFrame | None = None) -> DataFrame:
    """Distinct seeds of a mode: fast, mumreference (unique in the reference), mum, smem or maxmatch (all)."""
    if mode not in MODES:
        raise ValueError(f"unknown seed mode {mode!r}")
    found = mems(reference, queries, k, indexed=indexed)
    if mode in ("fast", "smem"):
        found = found.persist()  # read several times
    chosen = {"fast": fast, "mumreference": mams, "mum": mums, "smem": lambda m: smems(m, k, least), "maxmatch": lambda m: m}[mode](found)
    return chosen.select("ref_id", "rb", "query_id", "qb", "len", "strand").distinct()


def merge_diagonals(rows: DataFrame) -> DataFrame:
    """Seeds of one diagonal that overlap or touch made one."""
    diagonal = F.when(F.col("strand") == "+", F.col("qb") - F.col("rb")).otherwise(F.col("qb") + F.col("len") + F.col("rb"))
    placed = rows.select(*KEY, "rb", "qb", "len", diagonal.alias("diagonal"), (F.col("rb") + F.col("len")).alias("re"))
    merged = union(placed, [*KEY, "diagonal"], "rb", "re")
    n = F.col("re") - F.col("rb")
    qb = F.when(F.col("strand") == "+", F.col("diagonal") + F.col("rb")).otherwise(F.col("diagonal") - F.col("re"))
    return merged.select("ref_id", "rb", "query_id", qb.alias("qb"), n.alias("len"), "strand")


def band_edges(rows: DataFrame, max_gap: int = 90, diag_diff: int = 5, diag_factor: float = 0.12) -> DataFrame:
    """(KEY, a_rb, a_qb, a_len, b_rb, b_qb, b_len): pairs of seeds near each other along the query and in diagonal.

    b follows a in order of (qb, rb, len); b begins at most max_gap behind a's end. Seeds are binned by the end of what they
    reach, so a seed meets the bins between its begin and its reach and no others.
    """
    width = 256
    order = F.struct("qb", "rb", "len")
    diagonal = F.when(F.col("strand") == "+", F.col("qb") - F.col("rb")).otherwise(-F.col("qb") - F.col("rb"))
    a = rows.select(*KEY, *[F.col(c).alias(f"a_{c}") for c in ("rb", "qb", "len")], order.alias("a_at"), diagonal.alias("a_d"))
    a = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a_qb") / width), F.floor((F.col("a_qb") + F.col("a_len") + max_gap) / width))))
    b = rows.select(*KEY, *[F.col(c).alias(f"b_{c}") for c in ("rb", "qb", "len")], order.alias("b_at"), diagonal.alias("b_d"), F.floor(F.col("qb") / width).alias("bin"))
    sep = F.col("b_qb") - F.col("a_qb") - F.col("a_len")
    near = F.abs(F.col("b_d") - F.col("a_d")) <= F.greatest(F.lit(diag_diff), (sep * F.lit(diag_factor)).cast("long"))
    joined = a.join(b, [*KEY, "bin"]).where((F.col("a_at") < F.col("b_at")) & (sep <= max_gap) & near)
    return joined.select(*KEY, "a_rb", "a_qb", "a_len", "b_rb", "b_qb", "b_len")


def inexact(rows: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    """Seeds whose bases differ: none if all are exact."""
    refs = reference.select(F.col("seq_id").alias("ref_id"), F.col("bases").alias("ref_bases"))
    both = oriented(queries).select("query_id", "strand", "length", "bases")
    joined = rows.join(refs, "ref_id").join(both, ["query_id", "strand"])
    start = F.when(F.col("strand") == "+", F.col("qb")).otherwise(F.col("length") - F.col("qb") - F.col("len"))
    left, right = F.substring(F.col("ref_bases"), F.col("rb") + 1, F.col("len")), F.substring(F.col("bases"), start + 1, F.col("len"))
    return joined.where(left != right).select(rows.columns)
