"""Queries of the alignment operators over the tables, and the same in SQL.

References are the documents, queries the benchmark items, both with their letters folded to bases. A query goes on with parts of
the document of its id: one as it is, one reversed, one behind a deletion and one once more, so that a pair has many matches on
both strands. CIGARs come from the lines of an order: each line is an operation, its quantity the length.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import cigar, scoring, sequence
from strandline.operators import chain, copies, intervals, orientation, seeds, select
from strandline.plans import align as plan
from strandline.sinks import formats
from strandline.sources import fasta, index

K = 20


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def references(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("seq_id"), sequence.folded(F.col("text")).alias("bases"))


#: (begin from 1, length, reversed) of the parts of a document behind a query's own bases; None is a stretch that matches nothing.
PARTS = ((1, 120, False), None, (121, 60, False), (61, 140, True), (184, 100, False), None, (61, 60, False))
#: Such a stretch: the query's first bases in reverse.
SPACER = 40


def query_sequences(spark: SparkSession, d: str) -> DataFrame:
    own = _table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("seq_id"), sequence.folded(F.col("text")).alias("own"))
    part = lambda b, n, turned: F.reverse(F.translate(F.substring("doc", b, n), "ACGT", "TGCA")) if turned else F.substring("doc", b, n)
    parts = [F.reverse(F.substring("own", 1, SPACER)) if p is None else part(*p) for p in PARTS]
    # Only the documents of these ids are folded and moved; the few queries are read at many places.
    docs = references(spark, d).join(F.broadcast(own.select("seq_id")), "seq_id", "left_semi")
    both = own.join(docs.withColumnRenamed("bases", "doc"), "seq_id", "left")
    return both.select("seq_id", F.concat("own", F.coalesce(F.concat(*parts), F.lit(""))).alias("bases")).persist()


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents and queries of equal id, (pair_id, bases)."""
    queries = query_sequences(spark, d).withColumnRenamed("seq_id", "pair_id")
    return references(spark, d).withColumnRenamed("seq_id", "pair_id").join(queries.select("pair_id"), "pair_id", "left_semi"), queries


def _pair_extents(spark: SparkSession, d: str) -> DataFrame:
    refs, queries = _pairs(spark, d)
    n = F.length("bases").cast("long")
    return refs.select("pair_id", n.alias("reference_length")).join(queries.select("pair_id", n.alias("query_length")), "pair_id")


def _pair_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The matches of a pair that are unique on both sides, numbered along the reference."""
    refs, queries = _pairs(spark, d)
    named = lambda df: df.withColumnRenamed("pair_id", "seq_id")
    found = seeds.mems(named(refs), named(queries), K).where("ref_id = query_id")
    unique = seeds.mums(found).select(F.col("ref_id").alias("pair_id"), "rb", "qb", F.col("len").cast("long").alias("len"), "strand").distinct()
    return unique.withColumn("anchor_id", F.row_number().over(Window.partitionBy("pair_id").orderBy("rb", "qb", "strand", "len")).cast("long"))


def _mems(spark: SparkSession, d: str, strands: str = "+-") -> DataFrame:
    return seeds.mems(references(spark, d), query_sequences(spark, d), K, strands)


def _seeds(mode: str, least: int = 1):
    return lambda spark, d: seeds.seeds(references(spark, d), query_sequences(spark, d), mode, K, least)


SEED = ["ref_id", "rb", "query_id", "qb", "len", "strand"]


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return _mems(spark, d).select("query_id", "strand", "ref_id", F.col("qb").alias("begin"), (F.col("qb") + F.col("len")).alias("end"))


def _extents(spark: SparkSession, d: str) -> DataFrame:
    return query_sequences(spark, d).select(F.col("seq_id").alias("query_id"), F.length("bases").cast("long").alias("length"))


def seq_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", sequence.normalized(F.col("text")).alias("bases"))


def seq_stats(spark: SparkSession, d: str) -> DataFrame:
    bases = sequence.normalized(F.col("text"))
    return _table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("records"), F.sum(F.length(bases)).alias("total_bases"), F.sum(sequence.ambiguous(bases)).alias("ambiguous_bases"))


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return references(spark, d).select("seq_id", sequence.reverse_complement(F.col("bases")).alias("bases"))


def canonical_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), sequence.normalized(F.col("text")).alias("bases"))
    return sequence.canonical_runs(rows)


def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return sequence.kmer_counts(references(spark, d), 8)


def unique_kmers32(spark: SparkSession, d: str) -> DataFrame:
    return sequence.unique_words(references(spark, d), query_sequences(spark, d), 32)


def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union(_spans(spark, d), ["query_id", "strand"])


def coverage_length(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_length(_spans(spark, d), ["query_id", "strand"])


def coverage_complement(spark: SparkSession, d: str) -> DataFrame:
    return intervals.complement(_spans(spark, d), _extents(spark, d), ["query_id"])


def covered_matches(spark: SparkSession, d: str) -> DataFrame:
    found = _mems(spark, d)
    cover = intervals.union(seeds.mams(found).select("query_id", "strand", F.col("qb").alias("begin"), (F.col("qb") + F.col("len")).alias("end")), ["query_id", "strand"])
    spans = found.select(*SEED, F.col("qb").alias("begin"), (F.col("qb") + F.col("len")).alias("end"))
    return intervals.covered_by(spans, cover, ["query_id", "strand"]).groupBy("query_id", "strand", "covered").agg(F.count("*").alias("n"), F.sum("len").alias("bases"))


def window_starts(spark: SparkSession, d: str) -> DataFrame:
    return intervals.window_starts(_extents(spark, d), ["query_id"], 100, 50)


def interval_intersections(spark: SparkSession, d: str) -> DataFrame:
    windows = intervals.window_starts(_extents(spark, d), ["query_id"], 100, 50).select("query_id", F.col("begin").alias("id"), "begin", "end")
    cover = intervals.union(_spans(spark, d), ["query_id"]).select("query_id", F.col("begin").alias("id"), "begin", "end")
    return intervals.intersections(windows, cover, ["query_id"])


def window_votes(spark: SparkSession, d: str) -> DataFrame:
    windows = intervals.window_starts(_extents(spark, d), ["query_id"], 100, 50).select("query_id", F.col("begin").alias("w_begin"), F.col("end").alias("w_end"))
    middle = F.col("qb") + F.floor(F.col("len") / 2)
    found = _mems(spark, d).select("query_id", "strand", "len", middle.alias("m_begin"), (middle + 1).alias("m_end"))
    joined = intervals.binned_join(windows, found, ["query_id"], F.lit(True), ("w_begin", "w_end"), ("m_begin", "m_end"), 256)
    side = lambda s, v: F.sum(F.when(F.col("strand") == s, v).otherwise(F.lit(0)))
    counted = joined.groupBy("query_id", "w_begin", "w_end").agg(side("+", F.lit(1)).alias("forward"), side("-", F.lit(1)).alias("reverse"), side("+", F.col("len")).alias("forward_length"), side("-", F.col("len")).alias("reverse_length"))
    # A label with fewer members than three, so that all of them occur.
    return counted.withColumn("label", intervals.label(*[F.col(c) for c in ("forward", "reverse", "forward_length", "reverse_length")], least=2))


def event_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = _spans(spark, d).withColumn("bit", F.pmod("ref_id", F.lit(3)).cast("int"))
    return intervals.sweep(rows, ["query_id"])


def rarity_weight(spark: SparkSession, d: str) -> DataFrame:
    found = _mems(spark, d)
    there = F.count("*").over(Window.partitionBy("query_id", "strand", "oqb", "oqe"))
    here = F.count("*").over(Window.partitionBy("ref_id", "query_id", "strand", "rb", "len"))
    return found.select(*SEED, there.alias("reference_count"), here.alias("query_count")).withColumn("weight", scoring.rarity_weight(F.col("len"), F.col("reference_count"), F.col("query_count")))


def band_edges(spark: SparkSession, d: str) -> DataFrame:
    return seeds.band_edges(_seeds("maxmatch")(spark, d))


def seed_merge_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return seeds.merge_diagonals(_seeds("maxmatch")(spark, d))


def component_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _seeds("maxmatch")(spark, d).withColumn("re", F.col("rb") + F.col("len"))
    split = intervals.split_components(rows, seeds.KEY, "rb", "re", 50)
    return split.groupBy(*seeds.KEY, "component").agg(F.count("*").alias("n"), F.min("rb").alias("rb"), F.max("re").alias("re"))


def adjacency_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours along the query on one pair and strand, with the gaps between them and what they would cost."""
    merged = seeds.merge_diagonals(_seeds("maxmatch")(spark, d))
    order = Window.partitionBy(*seeds.KEY).orderBy("qb", "rb", "len")
    pairs = merged.withColumn("next_qb", F.lead("qb").over(order)).withColumn("next_rb", F.lead("rb").over(order)).withColumn("next_len", F.lead("len").over(order)).where("next_qb is not null")
    along = F.when(F.col("strand") == "+", F.col("next_rb") - F.col("rb") - F.col("len")).otherwise(F.col("rb") - F.col("next_rb") - F.col("next_len"))
    gaps = pairs.withColumn("qn", F.col("next_qb") - F.col("qb") - F.col("len")).withColumn("rn", along)
    return gaps.withColumn("discordance", scoring.discordance(F.col("rn"), F.col("qn"))).withColumn("cost", scoring.three_piece_gap(F.abs(F.col("rn") - F.col("qn"))))


def gap_costs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("long") * 25
    return _table(spark, d, "part").select("p_partkey", n.alias("n"), scoring.affine_gap(n).alias("affine"), scoring.two_piece_gap(n).alias("two"), scoring.three_piece_gap(n).alias("three"), scoring.automatic_band(n, n * 2).alias("band"))


def _cigars(spark: SparkSession, d: str) -> DataFrame:
    op = F.element_at(F.array(*[F.lit(c) for c in "=XID"]), F.col("l_linenumber") % 4 + 1)
    item = F.struct(F.col("l_linenumber").alias("at"), op.alias("op"), F.col("l_quantity").cast("long").alias("len"))
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("l_orderkey", F.transform("items", lambda c: F.struct(c["op"].alias("op"), c["len"].alias("len"))).alias("cigar"))


def cigar_lengths(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cigar")
    text = cigar.to_string(c)
    again = cigar.parsed(text)
    return _cigars(spark, d).select("l_orderkey", text.alias("cigar"), cigar.reference_length(again).alias("reference"), cigar.query_length(again).alias("query"), cigar.matches(again).alias("matches"), cigar.edits(again).alias("edits"), scoring.stitched_score(cigar.merged(c)).alias("score"))


def delta_encoding(spark: SparkSession, d: str) -> DataFrame:
    return _cigars(spark, d).select("l_orderkey", F.array_join(cigar.deltas(F.col("cigar")), ",").alias("deltas"))


def chain_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.transform(cigar.chain_blocks(F.col("cigar")), lambda b: F.concat_ws(" ", b["size"], b["dt"], b["dq"]))
    return _cigars(spark, d).select("l_orderkey", F.array_join(blocks, ",").alias("blocks"))


def sam_clips(spark: SparkSession, d: str) -> DataFrame:
    n = cigar.query_length(F.col("cigar"))
    strand = F.when(F.col("l_orderkey") % 2 == 0, F.lit("+")).otherwise(F.lit("-"))
    return _cigars(spark, d).select("l_orderkey", cigar.sam_cigar(F.col("cigar"), F.lit(2), F.lit(2) + n, n + 5, strand).alias("cigar"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """All matches as alignments, the first of each query in the final order being primary."""
    n = F.col("len").cast("long")
    path = F.array(F.struct(F.lit("=").alias("op"), n.alias("len")))
    rows = _seeds("maxmatch")(spark, d).select(
        "ref_id", "query_id", "strand", "rb", (F.col("rb") + n).alias("re"), "qb", (F.col("qb") + n).alias("qe"), path.alias("cigar"), (9 * n).alias("score"), n.alias("matches"), n.alias("columns"), F.lit(0).cast("long").alias("edits")
    )
    return select.with_primary(rows)


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("seq_id", F.concat(F.lit(prefix), "seq_id").alias("name"), "bases")


def sam_flags_primary(spark: SparkSession, d: str) -> DataFrame:
    lines = formats.sam(_matched(spark, d), _named(references(spark, d), "r"), _named(query_sequences(spark, d), "q")).where("part = 1")
    f = F.split("line", "\t")
    return lines.select(f[0].alias("query"), f[1].cast("int").alias("flag"), f[2].alias("ref"), f[3].cast("long").alias("pos"), f[5].alias("cigar"), f[12].alias("md"))


def paf_rows(spark: SparkSession, d: str) -> DataFrame:
    return formats.paf(_matched(spark, d), _named(references(spark, d), "r"), _named(query_sequences(spark, d), "q")).select("line")


def copy_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The open stretches of each pair and its scouts, with the anchors beside them."""
    return copies.jobs(_pair_anchors(spark, d), _pair_extents(spark, d))


def _self_found(spark: SparkSession, d: str) -> DataFrame:
    refs, queries = _pairs(spark, d)
    return copies.self_matches(refs, K).withColumn("axis", F.lit("reference")).unionByName(copies.self_matches(queries, K).withColumn("axis", F.lit("query")))


def self_repeats(spark: SparkSession, d: str) -> DataFrame:
    anchors = _pair_anchors(spark, d)
    return copies.self_repeats(_self_found(spark, d), copies.jobs(anchors, _pair_extents(spark, d)), anchors).drop("s", "d")


def copy_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The images of the repeats of each job through its anchors."""
    anchors, extents = _pair_anchors(spark, d).persist(), _pair_extents(spark, d)
    repeats = copies.self_repeats(_self_found(spark, d), copies.jobs(anchors, extents), anchors)
    return copies.merged(copies.projected(repeats, anchors, extents), extents).select("pair_id", "job", "axis", "rb", "qb", "len", "strand").distinct()


def unique_flanks(spark: SparkSession, d: str) -> DataFrame:
    refs, queries = _pairs(spark, d)
    anchors = _pair_anchors(spark, d)
    return copies.unique_flanks(copies.jobs(anchors, _pair_extents(spark, d)), anchors, refs, queries)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d).select(F.col("query_id").alias("pair_id"), "strand", "begin", "end")
    return intervals.union(spans, ["pair_id", "strand"])


def _label_cells(spark: SparkSession, d: str) -> DataFrame:
    bit = F.when(F.col("label") == "+", 0).when(F.col("label") == "-", 1).otherwise(2)
    labels = window_votes(spark, d).where("label <> '.'").select(F.col("query_id").alias("pair_id"), F.col("w_begin").alias("begin"), F.col("w_end").alias("end"), bit.alias("bit"))
    return intervals.sweep(labels, ["pair_id"])


def _one_sided(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of a query where the matches are of one strand only."""
    cells = intervals.sweep(_evidence(spark, d).withColumn("bit", F.when(F.col("strand") == "+", 0).otherwise(1)), ["pair_id"])
    return cells.where("mask in (1, 2)").select("pair_id", "begin", "end", F.when(F.col("mask") == 1, "+").otherwise("-").alias("strand"))


def connected_gaps(spark: SparkSession, d: str) -> DataFrame:
    unknown = _table(spark, d, "benchmark").select(F.col("item_id").alias("pair_id"), F.lit(0).cast("long").alias("begin"), F.lit(2).cast("long").alias("end"))
    return orientation.connected_gaps(_one_sided(spark, d), _label_cells(spark, d), _evidence(spark, d), unknown, 120, True)


def block_audit(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each query as one forward block, with its forward matches as anchors, once reverse windows are cut out."""
    blocks = _extents(spark, d).select(F.col("query_id").alias("pair_id"), F.lit(1).cast("long").alias("block_id"), F.lit("+").alias("strand"), F.lit(0).cast("long").alias("begin"), F.col("length").alias("end"))
    anchors = _evidence(spark, d).where("strand = '+'").select("pair_id", F.lit(1).cast("long").alias("block_id"), "begin", "end")
    return orientation.block_audit(blocks, anchors, _label_cells(spark, d), 30)[1]


def end_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips of the matches of a pair, by their length as weight."""
    n = _extents(spark, d)
    found = _seeds("maxmatch")(spark, d).join(n, "query_id")
    ub = F.when(F.col("strand") == "+", F.col("qb")).otherwise(F.col("length") - F.col("qb") - F.col("len"))
    rows = found.select(F.struct("ref_id", "query_id").alias("pair_id"), "strand", F.struct("rb", "qb", "len").alias("anchor_id"), "rb", ub.alias("ub"), "len", F.col("len").cast("double").alias("weight"))
    flat = lambda c: [F.col(f"{c}.{x}").alias(f"{c}_{x}" if c == "witness" else x) for x in ("rb", "qb", "len")]
    return orientation.end_clips(rows).select("pair_id.*", "strand", "end", "trim", *flat("anchor_id"), *flat("witness"))


def _order_chains(spark: SparkSession, d: str) -> DataFrame:
    """A chain of each strand for an order: its lines one after the other, those of odd number forward."""
    line = Window.partitionBy("l_orderkey", "strand").orderBy("l_linenumber", "len", "gap_r", "gap_q")
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 1, "+").otherwise("-").alias("strand"), F.col("l_quantity").cast("long").alias("len"), (F.col("l_partkey") % 40).alias("gap_r"), (F.col("l_suppkey") % 30).alias("gap_q"))
    up = line.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(F.col("l_orderkey").alias("pair_id"), "strand", (F.sum(F.col("len") + F.col("gap_r")).over(up) - F.col("len")).alias("rb"), (F.sum(F.col("len") + F.col("gap_q")).over(up) - F.col("len")).alias("u"), "len")


def initial_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the orders, whose lines make a chain of each strand."""
    found = _order_chains(spark, d)
    extents = found.groupBy("pair_id").agg((F.max(F.col("rb") + F.col("len")) + 10).alias("reference_length"), (F.max(F.col("u") + F.col("len")) + 5).alias("query_length"))
    qb = F.when(F.col("strand") == "+", F.col("u")).otherwise(F.col("query_length") - F.col("u") - F.col("len"))
    return orientation.initial_blocks(found.join(extents, "pair_id").select("pair_id", "strand", "rb", qb.alias("qb"), "len"), extents)


def overlap_violations(spark: SparkSession, d: str) -> DataFrame:
    """The matches that begin before an earlier one of their query and strand has ended; of their islands, none does."""
    spans = _spans(spark, d).select("query_id", "strand", "begin", "end").distinct()
    bad = intervals.overlap_violations(spans, ["query_id", "strand"])
    merged = intervals.union(spans, ["query_id", "strand"])
    still = intervals.overlap_violations(merged, ["query_id", "strand"])
    return bad.withColumn("merged", F.lit(False)).unionByName(still.withColumn("merged", F.lit(True)))


def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_shared(spark)}/fasta-{uuid.uuid4().hex}"
    rows = references(spark, d).where("bases <> ''").select(F.concat(F.lit("doc"), "seq_id").alias("name"), "bases")
    fasta.write_fasta(rows, path, width=70)
    return fasta.read_fasta(spark, path).select("name", "length", F.sha2("bases", 256).alias("sha256"))


def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_shared(spark)}/index-{uuid.uuid4().hex}"
    refs = references(spark, d).withColumn("name", F.concat(F.lit("doc"), "seq_id"))
    index.build(refs, path, K)
    loaded = index.load(spark, path, refs)
    per_record = loaded.kmers.groupBy("seq_id").agg(F.count("*").alias("kmers"))
    return loaded.manifest.join(per_record, "seq_id", "left").select("name", "length", "fingerprint", F.coalesce("kmers", F.lit(0)).alias("kmers"))


def best_chains(spark: SparkSession, d: str) -> DataFrame:
    return chain.chains(_seeds("fast")(spark, d)).drop("seeds")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cigar", cigar.to_string(F.col("cigar")))


def anchors_linked(spark: SparkSession, d: str) -> DataFrame:
    return _flat(plan.candidates(references(spark, d), query_sequences(spark, d)))


def bilateral_selection(spark: SparkSession, d: str) -> DataFrame:
    return _flat(select.bilateral(plan.candidates(references(spark, d), query_sequences(spark, d))))


def align_linked(spark: SparkSession, d: str) -> DataFrame:
    return _flat(plan.align(references(spark, d), query_sequences(spark, d)))


def _shared(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or tempfile.mkdtemp(prefix="strandline-")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "seq_normalize": seq_normalize,
    "seq_stats": seq_stats,
    "revcomp": revcomp,
    "canonical_runs": canonical_runs,
    "kmer_counts": kmer_counts,
    "unique_kmers32": unique_kmers32,
    "mem_forward": lambda spark, d: _mems(spark, d, "+").select(*SEED),
    "mem_reverse": lambda spark, d: _mems(spark, d, "-").select(*SEED),
    "mam": _seeds("mumreference"),
    "mum": _seeds("mum"),
    "smem_m1": _seeds("smem"),
    "smem_m2": _seeds("smem", 2),
    "seeds_fast": _seeds("fast"),
    "seeds_maxmatch": _seeds("maxmatch"),
    "seed_merge_diagonal": seed_merge_diagonal,
    "band_edges": band_edges,
    "coverage_union": coverage_union,
    "coverage_length": coverage_length,
    "coverage_complement": coverage_complement,
    "covered_matches": covered_matches,
    "window_starts": window_starts,
    "interval_intersections": interval_intersections,
    "window_votes": window_votes,
    "event_sweep": event_sweep,
    "rarity_weight": rarity_weight,
    "component_split": component_split,
    "adjacency_gaps": adjacency_gaps,
    "gap_costs": gap_costs,
    "cigar_lengths": cigar_lengths,
    "delta_encoding": delta_encoding,
    "chain_blocks": chain_blocks,
    "sam_clips": sam_clips,
    "sam_flags_primary": sam_flags_primary,
    "paf_rows": paf_rows,
    "copy_jobs": copy_jobs,
    "self_repeats": self_repeats,
    "copy_candidates": copy_candidates,
    "unique_flanks": unique_flanks,
    "connected_gaps": connected_gaps,
    "block_audit": block_audit,
    "end_clips": end_clips,
    "initial_blocks": initial_blocks,
    "overlap_violations": overlap_violations,
    "fasta_roundtrip": fasta_roundtrip,
    "index_roundtrip": index_roundtrip,
    "best_chains": best_chains,
    "anchors_linked": anchors_linked,
    "bilateral_selection": bilateral_selection,
    "align_linked": align_linked,
}

_FOLD = "translate(regexp_replace({0}, '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', '" + ("ACGT" * 7)[:26] * 2 + "')"
_NORMAL = "regexp_replace(translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'N', 'g')"
_REFS = f"refs AS (SELECT doc_id AS seq_id, {_FOLD.format('text')} AS bases FROM documents WHERE text IS NOT NULL)"
_PLANTED = " || ".join(f"reverse(substr(own, 1, {SPACER}))" if p is None else f"reverse(translate(substr(refs.bases, {p[0]}, {p[1]}), 'ACGT', 'TGCA'))" if p[2] else f"substr(refs.bases, {p[0]}, {p[1]})" for p in PARTS)
_QS = f"qs AS (SELECT item_id AS seq_id, own || coalesce({_PLANTED}, '') AS bases FROM (SELECT item_id, {_FOLD.format('text')} AS own FROM benchmark WHERE text IS NOT NULL) LEFT JOIN refs ON refs.seq_id = item_id)"
_MEM = f"""{_REFS}, {_QS},
ori AS (SELECT seq_id AS query_id, '+' AS strand, length(bases) AS n, bases FROM qs UNION ALL SELECT seq_id, '-', length(bases), reverse(translate(bases, 'ACGT', 'TGCA')) FROM qs),
qk AS (SELECT query_id, strand, n, j, substr(bases, j + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, n - {K - 1})) AS j FROM ori)),
rk AS (SELECT seq_id AS ref_id, i, substr(bases, i + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, length(bases) - {K - 1})) AS i FROM refs)),
hit AS (SELECT ref_id, query_id, strand, n, i, j FROM rk JOIN qk USING (kmer)),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY ref_id, query_id, strand, i - j ORDER BY i) AS g FROM hit),
mem AS (SELECT ref_id, query_id, strand, min(i) AS rb, min(j) AS oqb, count(*) + {K - 1} AS len, min(j) + count(*) + {K - 1} AS oqe,
  CASE WHEN strand = '+' THEN min(j) ELSE any_value(n) - min(j) - count(*) - {K - 1} END AS qb FROM isl GROUP BY ref_id, query_id, strand, i - j, g)"""
_COLS = "ref_id, rb, query_id, qb, len, strand"
_MAM = _MEM + """,
mam AS (SELECT * FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem o WHERE o.query_id = m.query_id AND o.strand = m.strand AND o.oqb <= m.oqb AND o.oqe >= m.oqe AND (o.ref_id <> m.ref_id OR o.rb <> m.rb OR o.oqb <> m.oqb)))"""
_SPAN = _MEM + ", span AS (SELECT query_id, strand, ref_id, qb AS b, qb + len AS e FROM mem)"
_ISLAND = """
w AS (SELECT *, max(e) OVER (PARTITION BY {0} ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT DISTINCT {0}, b, e FROM {1})),
v AS (SELECT *, sum(CASE WHEN r IS NULL OR b > r THEN 1 ELSE 0 END) OVER (PARTITION BY {0} ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM w),
u AS (SELECT {0}, min(b) AS b, max(e) AS e FROM v GROUP BY {0}, k)"""
_WIN = """,
ext AS (SELECT seq_id AS query_id, length(bases) AS n FROM qs),
st AS (SELECT DISTINCT query_id, n, b FROM (SELECT query_id, n, unnest(range(0, greatest(n - 100, 0) + 1, 50)) AS b FROM ext UNION ALL SELECT query_id, n, greatest(n - 100, 0) - unnest(range(0, greatest(n - 100, 0) + 1, 50)) FROM ext) WHERE n > 0),
win AS (SELECT query_id, b AS wb, least(b + 100, n) AS we FROM st)"""
_CIG = """c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS pos, substr('=XID', CAST(l_linenumber % 4 + 1 AS INTEGER), 1) AS op, CAST(l_quantity AS BIGINT) AS len FROM lineitem)"""
_THREE = "least({0} * 30 + 60, {0} * 5 + 800, {0} + 2500)"

_ANC = _MEM + """,
pm AS (SELECT * FROM mem WHERE ref_id = query_id),
um AS (SELECT DISTINCT query_id AS pair_id, rb, qb, len, strand FROM pm m WHERE NOT EXISTS (SELECT 1 FROM pm o WHERE o.query_id = m.query_id AND o.strand = m.strand AND (o.rb <> m.rb OR o.oqb <> m.oqb OR o.len <> m.len)
  AND (o.oqb <= m.oqb AND o.oqe >= m.oqe OR o.rb <= m.rb AND o.rb + o.len >= m.rb + m.len))),
anc AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY rb, qb, strand, len) AS anchor_id FROM um),
ext AS (SELECT qs.seq_id AS pair_id, length(refs.bases) AS reference_length, length(qs.bases) AS query_length FROM qs JOIN refs USING (seq_id))"""
_JOBS = _ANC + """,
sd AS (SELECT pair_id, 'query' AS axis, qb AS b, qb + len AS e, anchor_id FROM anc UNION ALL SELECT pair_id, 'reference', rb, rb + len, anchor_id FROM anc),
ln AS (SELECT pair_id, 'query' AS axis, query_length AS n FROM ext UNION ALL SELECT pair_id, 'reference', reference_length FROM ext),
ed AS (SELECT pair_id, axis, b, e FROM sd UNION ALL SELECT pair_id, axis, 0, 0 FROM ln UNION ALL SELECT pair_id, axis, n, n FROM ln),
rn AS (SELECT *, max(e) OVER (PARTITION BY pair_id, axis ORDER BY b, e) AS r, lead(b) OVER (PARTITION BY pair_id, axis ORDER BY b, e) AS nb FROM ed),
gp AS (SELECT pair_id, axis, r AS b, nb AS e, n FROM rn JOIN ln USING (pair_id, axis) WHERE nb > r),
jb AS (SELECT *, (SELECT arg_min(anchor_id, (-s.e, anchor_id)) FROM sd s WHERE s.pair_id = gp.pair_id AND s.axis = gp.axis AND s.e <= gp.b) AS left_id,
  (SELECT arg_min(anchor_id, (s.b, anchor_id)) FROM sd s WHERE s.pair_id = gp.pair_id AND s.axis = gp.axis AND s.b >= gp.e) AS right_id FROM gp),
ja AS (SELECT jb.pair_id, jb.axis, false AS scout, jb.b AS target_begin, jb.e AS target_end, least(greatest(jb.b - (jb.e - jb.b), 0), coalesce(l.b, jb.b)) AS source_begin, greatest(least(jb.e + jb.e - jb.b, n), coalesce(h.e, jb.e)) AS source_end, left_id, right_id
  FROM jb LEFT JOIN sd l ON l.pair_id = jb.pair_id AND l.axis = jb.axis AND l.anchor_id = left_id LEFT JOIN sd h ON h.pair_id = jb.pair_id AND h.axis = jb.axis AND h.anchor_id = right_id
  UNION ALL SELECT pair_id, axis, true, 0, n, 0, n, NULL, NULL FROM ln),
jobs AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY scout, CASE WHEN scout THEN 0 ELSE target_begin - target_end END, CASE WHEN scout = (axis = 'query') THEN 0 ELSE 1 END, target_begin) AS job FROM ja)"""
_REPEATS = _JOBS + f""",
sq AS (SELECT seq_id AS pair_id, 'query' AS axis, bases FROM qs WHERE seq_id IN (SELECT seq_id FROM refs) UNION ALL SELECT seq_id, 'reference', bases FROM refs WHERE seq_id IN (SELECT seq_id FROM qs)),
so AS (SELECT pair_id, axis, '+' AS strand, length(bases) AS n, bases FROM sq UNION ALL SELECT pair_id, axis, '-', length(bases), reverse(translate(bases, 'ACGT', 'TGCA')) FROM sq),
sa AS (SELECT pair_id, axis, i, substr(bases, i + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, length(bases) - {K - 1})) AS i FROM sq)),
sb AS (SELECT pair_id, axis, strand, n, j, substr(bases, j + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, n - {K - 1})) AS j FROM so)),
sh AS (SELECT pair_id, axis, strand, n, i, j FROM sa JOIN sb USING (pair_id, axis, kmer)),
si AS (SELECT *, i - row_number() OVER (PARTITION BY pair_id, axis, strand, i - j ORDER BY i) AS g FROM sh),
sm AS (SELECT pair_id, axis, strand, min(i) AS s, count(*) + {K - 1} AS n, CASE WHEN strand = '+' THEN min(j) ELSE any_value(n) - min(j) - count(*) - {K - 1} END AS d FROM si GROUP BY pair_id, axis, strand, i - j, g),
mt AS (SELECT j.pair_id, j.job, j.axis, j.scout, j.target_begin AS tb, j.target_end AS te, m.strand, m.s, m.d, m.n,
  greatest(tb - d, CASE WHEN strand = '+' THEN source_begin - s ELSE s + n - source_end END, 0) AS front, greatest(d + n - te, CASE WHEN strand = '+' THEN s + n - source_end ELSE source_begin - s END, 0) AS back
  FROM jobs j JOIN sm m USING (pair_id, axis) WHERE s <> d AND d < j.target_end AND j.target_begin < d + n),
ct AS (SELECT pair_id, job, axis, scout, tb, te, strand, d + front AS d, s + CASE WHEN strand = '+' THEN front ELSE back END AS s, n - front - back AS n FROM mt WHERE n > front + back),
cl AS (SELECT * REPLACE (CASE WHEN scout AND strand = '+' THEN least(n, abs(s - d)) ELSE n END AS n) FROM ct),
kp AS (SELECT * FROM cl c WHERE (s >= d + n OR d >= s + n) AND CASE WHEN scout THEN s + n = d OR d + n = s ELSE (s >= te OR tb >= s + n) AND
  (d = tb OR d + n = te OR EXISTS (SELECT 1 FROM sd x WHERE x.pair_id = c.pair_id AND x.axis = c.axis AND (x.b = c.s OR x.e = c.s + c.n))) END),
repeats AS (SELECT pair_id, job, axis, strand, s, d, n AS len FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, job, least(s, d), greatest(s, d), n, strand ORDER BY s, d) AS k FROM kp) WHERE k = 1)"""
_VOTES = _MEM + _WIN.replace("\next AS (", "\nwext AS (").replace("FROM ext", "FROM wext") + """,
vx AS (SELECT win.query_id, wb, we, sum(CASE WHEN strand = '+' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN strand = '-' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN strand = '+' THEN len ELSE 0 END) AS fl, sum(CASE WHEN strand = '-' THEN len ELSE 0 END) AS rl
 FROM win JOIN mem ON mem.query_id = win.query_id AND qb + len // 2 >= wb AND qb + len // 2 < we GROUP BY ALL),
vl AS (SELECT query_id AS pair_id, wb, we, CASE WHEN f >= 2 AND r <= f // 2 AND rl <= fl // 2 THEN 1 WHEN r >= 2 AND f <= r // 2 AND fl <= rl // 2 THEN 2 WHEN f >= 2 OR r >= 2 THEN 4 ELSE 0 END AS m FROM vx)"""


def _swept(source: str, name: str) -> str:
    """Cells (pair_id, b, e, m) of intervals (pair_id, b, e, m) that carry one bit each."""
    steps = lambda sign: ", ".join(f"CASE WHEN m = {1 << k} THEN {sign}1 ELSE 0 END AS s{k}" for k in range(3))
    mask = " + ".join(f"CASE WHEN sum(s{k}) OVER o > 0 THEN {1 << k} ELSE 0 END" for k in range(3))
    return f"""
{name}_e AS (SELECT pair_id, b AS p, {steps('')} FROM {source} UNION ALL SELECT pair_id, e, {steps('-')} FROM {source}),
{name}_a AS (SELECT pair_id, p, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2 FROM {name}_e GROUP BY ALL),
{name}_c AS (SELECT pair_id, p, lead(p) OVER o AS q, {mask} AS m FROM {name}_a WINDOW o AS (PARTITION BY pair_id ORDER BY p)),
{name}_f AS (SELECT *, CASE WHEN lag(m) OVER (PARTITION BY pair_id ORDER BY p) = m THEN 0 ELSE 1 END AS f FROM {name}_c WHERE q IS NOT NULL),
{name}_g AS (SELECT *, sum(f) OVER (PARTITION BY pair_id ORDER BY p) AS g FROM {name}_f),
{name} AS (SELECT pair_id, min(p) AS b, max(q) AS e, any_value(m) AS m FROM {name}_g WHERE m > 0 GROUP BY pair_id, g)"""


_CELLS = _VOTES + f""",
span AS (SELECT query_id, strand, qb AS b, qb + len AS e FROM mem), {_ISLAND.format('query_id, strand', 'span')},
ev AS (SELECT query_id AS pair_id, strand, b, e FROM u), evm AS (SELECT pair_id, b, e, CASE WHEN strand = '+' THEN 1 ELSE 2 END AS m FROM ev), vlm AS (SELECT pair_id, wb AS b, we AS e, m FROM vl WHERE m > 0),""" + _swept("evm", "ev_cell") + "," + _swept("vlm", "cell")

ORACLE_SQL: dict[str, str] = {
    "seq_normalize": f"SELECT doc_id, {_NORMAL.format('text')} AS bases FROM documents",
    "seq_stats": f"WITH b AS (SELECT source, {_NORMAL.format('text')} AS s FROM documents) SELECT source, count(*) AS records, CAST(sum(length(s)) AS BIGINT) AS total_bases, CAST(sum(length(regexp_replace(s, '[^N]', '', 'g'))) AS BIGINT) AS ambiguous_bases FROM b GROUP BY source",
    "revcomp": f"WITH {_REFS} SELECT seq_id, reverse(translate(bases, 'ACGT', 'TGCA')) AS bases FROM refs",
    "canonical_runs": f"""WITH b AS (SELECT item_id AS seq_id, regexp_extract_all({_NORMAL.format('text')}, 'N+|[ACGT]+') AS p FROM benchmark),
x AS (SELECT seq_id, unnest(p) AS s, unnest(range(len(p))) AS k FROM b),
y AS (SELECT *, sum(length(s)) OVER (PARTITION BY seq_id ORDER BY k) AS e FROM x)
SELECT seq_id, CAST(e - length(s) AS BIGINT) AS "begin", CAST(e AS BIGINT) AS "end" FROM y WHERE s NOT LIKE 'N%'""",
    "kmer_counts": f"WITH {_REFS} SELECT substr(bases, i + 1, 8) AS kmer, count(*) AS n FROM (SELECT bases, unnest(range(0, length(bases) - 7)) AS i FROM refs) GROUP BY 1",
    "unique_kmers32": f"""WITH {_REFS}, {_QS},
l AS (SELECT substr(bases, i + 1, 32) AS kmer, min(seq_id) AS left_id, min(i) AS left_pos FROM (SELECT *, unnest(range(0, length(bases) - 31)) AS i FROM refs) GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT substr(bases, i + 1, 32) AS kmer, min(seq_id) AS right_id, min(i) AS right_pos FROM (SELECT *, unnest(range(0, length(bases) - 31)) AS i FROM qs) GROUP BY 1 HAVING count(*) = 1)
SELECT * FROM l JOIN r USING (kmer)""",
    "mem_forward": f"WITH {_MEM} SELECT {_COLS} FROM mem WHERE strand = '+'",
    "mem_reverse": f"WITH {_MEM} SELECT {_COLS} FROM mem WHERE strand = '-'",
    "mam": f"WITH {_MAM} SELECT {_COLS} FROM mam",
    "mum": f"""WITH {_MAM} SELECT {_COLS} FROM mam m WHERE NOT EXISTS (SELECT 1 FROM mem o WHERE o.query_id = m.query_id AND o.strand = m.strand AND o.ref_id = m.ref_id AND o.rb <= m.rb AND o.rb + o.len >= m.rb + m.len AND (o.oqb <> m.oqb OR o.rb <> m.rb))""",
    "smem_m1": f"""WITH {_MEM} SELECT {_COLS} FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem o WHERE o.query_id = m.query_id AND o.strand = m.strand AND o.oqb <= m.oqb AND o.oqe >= m.oqe AND o.len > m.len)""",
    "smem_m2": f"""WITH {_MEM},
p AS (SELECT DISTINCT query_id, strand, oqb AS i FROM mem),
a AS (SELECT p.*, list_sort(list(m.oqe), 'DESC')[2] AS reach FROM p JOIN mem m USING (query_id, strand) WHERE m.oqb <= p.i AND m.oqe - p.i >= {K} GROUP BY ALL),
b AS (SELECT p.*, list_sort(list(m.oqe), 'DESC')[2] AS before FROM p JOIN mem m USING (query_id, strand) WHERE m.oqb <= p.i - 1 AND m.oqe - p.i + 1 >= {K} GROUP BY ALL),
s AS (SELECT a.query_id, a.strand, a.i, a.reach FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.strand = b.strand AND a.i = b.i WHERE a.reach IS NOT NULL AND (b.before IS NULL OR a.reach > b.before))
SELECT DISTINCT m.ref_id, m.rb + s.i - m.oqb AS rb, m.query_id, CASE WHEN m.strand = '+' THEN m.qb + s.i - m.oqb ELSE m.qb + m.oqe - s.reach END AS qb, s.reach - s.i AS len, m.strand
FROM s JOIN mem m ON m.query_id = s.query_id AND m.strand = s.strand AND m.oqb <= s.i AND m.oqe >= s.reach""",
    "seeds_fast": f"""WITH {_MAM}, span AS (SELECT query_id, strand, qb AS b, qb + len AS e FROM mam), {_ISLAND.format('query_id, strand', 'span')}
SELECT {_COLS} FROM mam UNION SELECT {_COLS} FROM mem m WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.query_id = m.query_id AND u.strand = m.strand AND u.b <= m.qb AND u.e >= m.qb + m.len)""",
    "seeds_maxmatch": f"WITH {_MEM} SELECT DISTINCT {_COLS} FROM mem",
    "seed_merge_diagonal": f"""WITH {_MEM}, span AS (SELECT ref_id, query_id, strand, CASE WHEN strand = '+' THEN qb - rb ELSE qb + len + rb END AS dg, rb AS b, rb + len AS e FROM mem), {_ISLAND.format('ref_id, query_id, strand, dg', 'span')}
SELECT ref_id, b AS rb, query_id, CASE WHEN strand = '+' THEN dg + b ELSE dg - e END AS qb, e - b AS len, strand FROM u""",
    "band_edges": f"""WITH {_MEM}, s AS (SELECT DISTINCT {_COLS}, CASE WHEN strand = '+' THEN qb - rb ELSE -qb - rb END AS dg FROM mem)
SELECT a.ref_id, a.query_id, a.strand, a.rb AS a_rb, a.qb AS a_qb, a.len AS a_len, b.rb AS b_rb, b.qb AS b_qb, b.len AS b_len FROM s a JOIN s b ON a.ref_id = b.ref_id AND a.query_id = b.query_id AND a.strand = b.strand
AND (a.qb, a.rb, a.len) < (b.qb, b.rb, b.len) AND b.qb - a.qb - a.len <= 90 AND abs(b.dg - a.dg) <= greatest(5, CAST(trunc((b.qb - a.qb - a.len) * 0.12::DOUBLE) AS BIGINT))""",
    "coverage_union": f"WITH {_SPAN}, {_ISLAND.format('query_id, strand', 'span')} SELECT query_id, strand, b AS \"begin\", e AS \"end\" FROM u",
    "coverage_length": f"WITH {_SPAN}, {_ISLAND.format('query_id, strand', 'span')} SELECT query_id, strand, CAST(sum(e - b) AS BIGINT) AS covered FROM u GROUP BY ALL",
    "coverage_complement": f"""WITH {_SPAN}, {_ISLAND.format('query_id', 'span')},
t AS (SELECT query_id, b, e FROM u UNION ALL SELECT seq_id, 0, 0 FROM qs UNION ALL SELECT seq_id, length(bases), length(bases) FROM qs),
x AS (SELECT *, lead(b) OVER (PARTITION BY query_id ORDER BY b, e) AS nb FROM t) SELECT query_id, e AS "begin", nb AS "end" FROM x WHERE nb > e""",
    "covered_matches": f"""WITH {_MAM}, span AS (SELECT query_id, strand, qb AS b, qb + len AS e FROM mam), {_ISLAND.format('query_id, strand', 'span')},
x AS (SELECT *, EXISTS (SELECT 1 FROM u WHERE u.query_id = m.query_id AND u.strand = m.strand AND u.b <= m.qb AND u.e >= m.qb + m.len) AS covered FROM mem m)
SELECT query_id, strand, covered, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM x GROUP BY ALL""",
    "window_starts": f"WITH {_REFS}, {_QS}{_WIN} SELECT query_id, wb AS \"begin\", we AS \"end\" FROM win",
    "interval_intersections": f"""WITH {_SPAN}, {_ISLAND.format('query_id', 'span')}{_WIN}
SELECT win.query_id, wb AS left_id, u.b AS right_id, greatest(wb, u.b) AS "begin", least(we, u.e) AS "end" FROM win JOIN u ON win.query_id = u.query_id AND wb < u.e AND u.b < we""",
    "window_votes": f"""WITH {_MEM}{_WIN}, x AS (SELECT win.query_id, wb AS w_begin, we AS w_end,
 CAST(sum(CASE WHEN strand = '+' THEN 1 ELSE 0 END) AS BIGINT) AS forward, CAST(sum(CASE WHEN strand = '-' THEN 1 ELSE 0 END) AS BIGINT) AS reverse,
 CAST(sum(CASE WHEN strand = '+' THEN len ELSE 0 END) AS BIGINT) AS forward_length, CAST(sum(CASE WHEN strand = '-' THEN len ELSE 0 END) AS BIGINT) AS reverse_length
 FROM win JOIN mem ON mem.query_id = win.query_id AND qb + len // 2 >= wb AND qb + len // 2 < we GROUP BY ALL)
SELECT *, CASE WHEN forward >= 2 AND reverse <= forward // 2 AND reverse_length <= forward_length // 2 THEN '+'
 WHEN reverse >= 2 AND forward <= reverse // 2 AND forward_length <= reverse_length // 2 THEN '-' WHEN forward >= 2 OR reverse >= 2 THEN '?' ELSE '.' END AS label FROM x""",
    "event_sweep": f"""WITH {_SPAN}, ev AS (SELECT query_id, b AS p, CASE WHEN ref_id % 3 = 0 THEN 1 ELSE 0 END AS s0, CASE WHEN ref_id % 3 = 1 THEN 1 ELSE 0 END AS s1, CASE WHEN ref_id % 3 = 2 THEN 1 ELSE 0 END AS s2 FROM span
 UNION ALL SELECT query_id, e, CASE WHEN ref_id % 3 = 0 THEN -1 ELSE 0 END, CASE WHEN ref_id % 3 = 1 THEN -1 ELSE 0 END, CASE WHEN ref_id % 3 = 2 THEN -1 ELSE 0 END FROM span),
al AS (SELECT query_id, p, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2 FROM ev GROUP BY ALL),
cell AS (SELECT query_id, p, lead(p) OVER o AS q, CASE WHEN sum(s0) OVER o > 0 THEN 1 ELSE 0 END + CASE WHEN sum(s1) OVER o > 0 THEN 2 ELSE 0 END + CASE WHEN sum(s2) OVER o > 0 THEN 4 ELSE 0 END AS mask FROM al WINDOW o AS (PARTITION BY query_id ORDER BY p)),
fr AS (SELECT *, CASE WHEN lag(mask) OVER (PARTITION BY query_id ORDER BY p) = mask THEN 0 ELSE 1 END AS f FROM cell WHERE q IS NOT NULL),
gr AS (SELECT *, sum(f) OVER (PARTITION BY query_id ORDER BY p) AS g FROM fr)
SELECT query_id, min(p) AS "begin", max(q) AS "end", CAST(any_value(mask) AS INTEGER) AS mask FROM gr WHERE mask > 0 GROUP BY query_id, g""",
    "rarity_weight": f"""WITH {_MEM}, x AS (SELECT *, count(*) OVER (PARTITION BY query_id, strand, oqb, oqe) AS reference_count, count(*) OVER (PARTITION BY ref_id, query_id, strand, rb, len) AS query_count FROM mem)
SELECT {_COLS}, reference_count, query_count, len / sqrt(CAST(reference_count * query_count AS DOUBLE)) AS weight FROM x""",
    "component_split": f"""WITH {_MEM}, s AS (SELECT DISTINCT {_COLS}, rb + len AS re FROM mem),
a AS (SELECT *, max(re) OVER (PARTITION BY ref_id, query_id, strand ORDER BY rb, re, qb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
b AS (SELECT *, sum(CASE WHEN r IS NULL OR rb > r + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id, query_id, strand ORDER BY rb, re, qb ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM a)
SELECT ref_id, query_id, strand, CAST(c AS BIGINT) AS component, count(*) AS n, min(rb) AS rb, max(re) AS re FROM b GROUP BY ref_id, query_id, strand, c""",
    "adjacency_gaps": f"""WITH {_MEM}, span AS (SELECT ref_id, query_id, strand, CASE WHEN strand = '+' THEN qb - rb ELSE qb + len + rb END AS dg, rb AS b, rb + len AS e FROM mem), {_ISLAND.format('ref_id, query_id, strand, dg', 'span')},
m AS (SELECT ref_id, b AS rb, query_id, CASE WHEN strand = '+' THEN dg + b ELSE dg - e END AS qb, e - b AS len, strand FROM u),
x AS (SELECT *, lead(qb) OVER o AS next_qb, lead(rb) OVER o AS next_rb, lead(len) OVER o AS next_len FROM m WINDOW o AS (PARTITION BY ref_id, query_id, strand ORDER BY qb, rb, len)),
y AS (SELECT *, next_qb - qb - len AS qn, CASE WHEN strand = '+' THEN next_rb - rb - len ELSE rb - next_rb - next_len END AS rn FROM x WHERE next_qb IS NOT NULL)
SELECT *, 2 * log2(CAST(abs(rn - qn) + 1 AS DOUBLE)) AS discordance, CASE WHEN abs(rn - qn) > 0 THEN {_THREE.format('abs(rn - qn)')} ELSE 0 END AS cost FROM y""",
    "gap_costs": f"""WITH x AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 25 AS n FROM part) SELECT p_partkey, n, n * 3 + 40 AS affine, least(n * 2 + 4, n + 12) AS two, {_THREE.format('n')} AS three, 200 + CAST(floor((n + n) * 0.1::DOUBLE) AS BIGINT) AS band FROM x""",
    "cigar_lengths": f"""WITH {_CIG}, s AS (SELECT l_orderkey, string_agg(CAST(len AS VARCHAR) || op, '' ORDER BY pos) AS cigar,
 CAST(sum(CASE WHEN op <> 'I' THEN len ELSE 0 END) AS BIGINT) AS reference, CAST(sum(CASE WHEN op <> 'D' THEN len ELSE 0 END) AS BIGINT) AS query,
 CAST(sum(CASE WHEN op = '=' THEN len ELSE 0 END) AS BIGINT) AS matches, CAST(sum(CASE WHEN op <> '=' THEN len ELSE 0 END) AS BIGINT) AS edits FROM c GROUP BY l_orderkey),
f AS (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY l_orderkey ORDER BY pos) = op THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY pos) AS run FROM f),
g AS (SELECT l_orderkey, run, any_value(op) AS op, CAST(sum(len) AS BIGINT) AS len FROM r GROUP BY l_orderkey, run),
t AS (SELECT l_orderkey, CAST(sum(CASE WHEN op = '=' THEN len * 20 WHEN op = 'X' THEN -len * 80 ELSE -({_THREE.format('len')}) END) AS BIGINT) AS score FROM g GROUP BY l_orderkey)
SELECT s.*, t.score FROM s JOIN t USING (l_orderkey)""",
    "delta_encoding": f"""WITH {_CIG}, p AS (SELECT *, sum(CASE WHEN op IN ('=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS paired FROM c),
g AS (SELECT *, paired - coalesce(lag(paired) OVER (PARTITION BY l_orderkey ORDER BY pos), 0) + 1 AS first, CASE WHEN op = 'D' THEN 1 ELSE -1 END AS sign FROM p WHERE op IN ('I', 'D') AND len > 0),
e AS (SELECT l_orderkey, pos, unnest(range(len)) AS k, first, sign FROM g),
j AS (SELECT l_orderkey, string_agg(CAST(CAST(CASE WHEN k = 0 THEN sign * first ELSE sign END AS BIGINT) AS VARCHAR), ',' ORDER BY pos, k) AS ds FROM e GROUP BY l_orderkey)
SELECT o.l_orderkey, coalesce(j.ds || ',', '') || '0' AS deltas FROM (SELECT DISTINCT l_orderkey FROM c) o LEFT JOIN j USING (l_orderkey)""",
    "sam_clips": f"""WITH {_CIG}, s AS (SELECT l_orderkey, string_agg(CAST(len AS VARCHAR) || op, '' ORDER BY pos) AS t FROM c GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN '2H' || t || '3H' ELSE '3H' || t || '2H' END AS cigar FROM s""",
    "chain_blocks": f"""WITH {_CIG}, p AS (SELECT *, op IN ('=', 'X') AS pair FROM c),
f AS (SELECT *, CASE WHEN pair AND coalesce(NOT lag(pair) OVER (PARTITION BY l_orderkey ORDER BY pos), true) THEN 1 ELSE 0 END AS fresh FROM p),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY pos) AS block FROM f),
b AS (SELECT l_orderkey, block, sum(CASE WHEN pair THEN len ELSE 0 END) AS size, sum(CASE WHEN op = 'D' THEN len ELSE 0 END) AS dt, sum(CASE WHEN op = 'I' THEN len ELSE 0 END) AS dq FROM r WHERE block > 0 GROUP BY l_orderkey, block),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY block DESC) = 1 AS last FROM b),
j AS (SELECT l_orderkey, string_agg(CAST(CAST(size AS BIGINT) AS VARCHAR) || CASE WHEN last THEN ' 0 0' ELSE ' ' || CAST(CAST(dt AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(dq AS BIGINT) AS VARCHAR) END, ',' ORDER BY block) AS blocks FROM l GROUP BY l_orderkey)
SELECT o.l_orderkey, coalesce(j.blocks, '') AS blocks FROM (SELECT DISTINCT l_orderkey FROM c) o LEFT JOIN j USING (l_orderkey)""",
    "sam_flags_primary": f"""WITH {_MEM}, s AS (SELECT DISTINCT {_COLS} FROM mem), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY qb, ref_id, rb, strand, len) AS k FROM s)
SELECT 'q' || query_id AS query, CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN k > 1 THEN 2048 ELSE 0 END AS flag, 'r' || ref_id AS ref, rb + 1 AS pos,
 CASE WHEN strand = '+' THEN a ELSE z END || len || '=' || CASE WHEN strand = '+' THEN z ELSE a END AS cigar, 'MD:Z:' || len AS md
FROM (SELECT r.*, CASE WHEN qb > 0 THEN qb || 'H' ELSE '' END AS a, CASE WHEN length(qs.bases) > qb + len THEN (length(qs.bases) - qb - len) || 'H' ELSE '' END AS z FROM r JOIN qs ON qs.seq_id = r.query_id)""",
    "paf_rows": f"""WITH {_MEM}, s AS (SELECT DISTINCT {_COLS} FROM mem), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY qb, ref_id, rb, strand, len) AS k FROM s)
SELECT concat_ws(chr(9), 'q' || r.query_id, length(qs.bases), qb, qb + len, strand, 'r' || r.ref_id, length(refs.bases), rb, rb + len, len, len, '255', 'cg:Z:' || len || '=', 'NM:i:0', 'AS:i:' || 9 * len, 'tp:A:' || CASE WHEN k = 1 THEN 'P' ELSE 'S' END) AS line
FROM r JOIN refs ON refs.seq_id = r.ref_id JOIN qs ON qs.seq_id = r.query_id""",
    "copy_jobs": f"""WITH {_JOBS} SELECT * FROM jobs""",
    "self_repeats": f"""WITH {_REPEATS} SELECT pair_id, job, axis, least(s, d) AS first_begin, greatest(s, d) AS second_begin, len, strand FROM repeats""",
    "copy_candidates": f"""WITH {_REPEATS},
own AS (SELECT pair_id, 'query' AS axis, anchor_id, strand AS a_strand, qb AS ab, qb + len AS ae, rb AS ob FROM anc UNION ALL SELECT pair_id, 'reference', anchor_id, strand, rb, rb + len, qb FROM anc),
met AS (SELECT r.*, o.anchor_id, o.a_strand, o.ab, o.ae, o.ob, greatest(r.s, o.ab) AS b, least(r.s + r.len, o.ae) AS e FROM repeats r JOIN own o USING (pair_id, axis) WHERE r.s < o.ae AND o.ab < r.s + r.len),
im AS (SELECT *, CASE WHEN strand = '+' THEN d + b - s ELSE d + s + len - e END AS target, ob + CASE WHEN a_strand = '+' THEN b - ab ELSE ae - e END AS there FROM met),
pr AS (SELECT pair_id, job, axis, anchor_id, CASE WHEN axis = 'query' THEN there ELSE target END AS rb, CASE WHEN axis = 'query' THEN target ELSE there END AS qb, e - b AS n, CASE WHEN a_strand = strand THEN '+' ELSE '-' END AS st,
 CASE WHEN (CASE WHEN axis = 'query' THEN a_strand ELSE strand END) = '+' THEN b ELSE (CASE WHEN axis = 'query' THEN query_length ELSE reference_length END) - e END AS sb, CASE WHEN axis = 'query' THEN a_strand ELSE strand END AS tr FROM im JOIN ext USING (pair_id)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, job, rb, qb, n, st ORDER BY anchor_id, sb, tr) AS k FROM pr) WHERE k = 1),
lined AS (SELECT o.*, rb - CASE WHEN st = '+' THEN qb ELSE query_length - qb - n END AS line FROM once o JOIN ext USING (pair_id))
SELECT DISTINCT pair_id, job, axis, rb, qb, n AS len, st AS strand FROM lined x WHERE NOT EXISTS (SELECT 1 FROM lined y WHERE y.pair_id = x.pair_id AND y.job = x.job AND y.st = x.st AND y.line = x.line AND y.anchor_id = x.anchor_id AND y.rb <= x.rb AND y.rb + y.n >= x.rb + x.n AND y.n > x.n)""",
    "unique_flanks": f"""WITH {_JOBS},
occ AS (SELECT a.pair_id, a.anchor_id, a.strand, a.rb, a.qb, a.len, r.bases AS rs, q.bases AS qq, substr(r.bases, a.rb + 1, a.len) AS p, CASE WHEN a.strand = '+' THEN substr(r.bases, a.rb + 1, a.len) ELSE reverse(translate(substr(r.bases, a.rb + 1, a.len), 'ACGT', 'TGCA')) END AS x FROM anc a JOIN refs r ON r.seq_id = a.pair_id JOIN qs q ON q.seq_id = a.pair_id),
u AS (SELECT pair_id, anchor_id, strand, rb, qb, len, len(list_filter(range(length(rs) - len + 1), lambda i: substr(rs, i + 1, len) = p)) = 1 AND len(list_filter(range(length(qq) - len + 1), lambda i: substr(qq, i + 1, len) = x)) = 1 AS once FROM occ)
SELECT j.pair_id, j.job, coalesce(l.strand = h.strand AND l.anchor_id <> h.anchor_id AND l.once AND h.once AND
 CASE WHEN j.axis = 'query' THEN CASE WHEN l.strand = '+' THEN l.rb + l.len <= h.rb ELSE h.rb + h.len <= l.rb END ELSE CASE WHEN l.strand = '+' THEN l.qb + l.len <= h.qb ELSE h.qb + h.len <= l.qb END END, false) AS "unique"
FROM jobs j LEFT JOIN u l ON l.pair_id = j.pair_id AND l.anchor_id = j.left_id LEFT JOIN u h ON h.pair_id = j.pair_id AND h.anchor_id = j.right_id WHERE NOT j.scout""",
    "connected_gaps": f"""WITH {_CELLS},
one AS (SELECT pair_id, b, e, CASE WHEN m = 1 THEN '+' ELSE '-' END AS strand FROM ev_cell WHERE m IN (1, 2)),
nx AS (SELECT pair_id, e AS b, lead(b) OVER o AS e, strand, lead(strand) OVER o AS n_strand FROM one WINDOW o AS (PARTITION BY pair_id ORDER BY b)),
g AS (SELECT pair_id, b, e, strand FROM nx WHERE strand = n_strand AND e > b),
j AS (SELECT g.*, g.b < 2 AS has_n,
 (SELECT coalesce(sum(least(c.e, g.e) - greatest(c.b, g.b)), 0) FROM cell c WHERE c.pair_id = g.pair_id AND c.b < g.e AND g.b < c.e AND c.m = CASE WHEN g.strand = '+' THEN 1 ELSE 2 END) AS pure,
 EXISTS (SELECT 1 FROM cell c WHERE c.pair_id = g.pair_id AND c.b < g.e AND g.b < c.e AND c.m & CASE WHEN g.strand = '+' THEN 6 ELSE 5 END <> 0) AS veto,
 EXISTS (SELECT 1 FROM ev v WHERE v.pair_id = g.pair_id AND v.b < g.e AND g.b < v.e AND v.strand <> g.strand) AS opp FROM g),
r AS (SELECT *, CASE WHEN e - b > 120 THEN 'gap_too_long' WHEN has_n THEN 'contains_N' WHEN pure = e - b THEN 'continuous_window_gap' WHEN veto THEN 'conflicting_or_uncovered_window' WHEN opp THEN 'opposite_exact_evidence' ELSE 'same_direction_unknown_gap' END AS reason FROM j)
SELECT pair_id, b AS "begin", e AS "end", strand, reason IN ('continuous_window_gap', 'same_direction_unknown_gap') AS accepted, reason FROM r""",
    "block_audit": f"""WITH {_CELLS},
gp AS (SELECT pair_id, e AS gb, lead(b) OVER (PARTITION BY pair_id ORDER BY b) AS ge FROM ev WHERE strand = '+'),
pc AS (SELECT gp.pair_id, greatest(gb, c.b) AS b, least(ge, c.e) AS e FROM gp JOIN cell c ON c.pair_id = gp.pair_id AND c.b < ge AND gb < c.e WHERE ge - gb > 30 AND c.m = 2),
x AS (SELECT pair_id, b, e FROM pc UNION ALL SELECT seq_id, 0, 0 FROM qs UNION ALL SELECT seq_id, length(bases), length(bases) FROM qs),
y AS (SELECT pair_id, e AS b, lead(b) OVER (PARTITION BY pair_id ORDER BY b, e) AS e FROM x)
SELECT pair_id, CAST(1 AS BIGINT) AS block_id, '+' AS strand, b AS "begin", e AS "end" FROM y WHERE e > b""",
    "end_clips": f"""WITH {_MEM}, s AS (SELECT DISTINCT {_COLS}, oqb AS ub FROM mem),
p AS (SELECT a.ref_id, a.query_id, a.strand, a.rb AS arb, a.qb AS aqb, a.len AS an, b.rb AS brb, b.qb AS bqb, b.len AS bn, a.ub AS aub, b.ub AS bub, greatest(a.rb + a.len - b.rb, a.ub + a.len - b.ub) AS trim
 FROM s a JOIN s b ON a.ref_id = b.ref_id AND a.query_id = b.query_id AND a.strand = b.strand AND a.rb < b.rb AND a.ub < b.ub AND a.rb + a.len < b.rb + b.len AND a.ub + a.len < b.ub + b.len AND (a.rb + a.len > b.rb OR a.ub + a.len > b.ub)),
t AS (SELECT *, abs((brb - arb) - (bub - aub)) AS delta, 2 * log2(CAST(abs((brb - arb) - (bub - aub)) + 1 AS DOUBLE)) AS cost, greatest(brb - arb - an, bub - aub - an) + trim AS gap FROM p WHERE 2 * trim < least(an, bn)),
o AS (SELECT ref_id, query_id, strand, 'back' AS "end", arb AS rb, aqb AS qb, an AS len, trim, delta, cost, gap, least(an - trim, bn) AS least, brb AS wrb, bqb AS wqb, bn AS wn FROM t
 UNION ALL SELECT ref_id, query_id, strand, 'front', brb, bqb, bn, trim, delta, cost, gap, least(bn - trim, an), arb, aqb, an FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY ref_id, query_id, strand, "end", rb, qb, len ORDER BY trim, cost, wrb, wqb, wn) AS k FROM o WHERE (gap = 0 OR gap < least) AND (delta = 0 OR cost < least))
SELECT ref_id, query_id, strand, "end", trim, rb, qb, len, wrb AS witness_rb, wqb AS witness_qb, wn AS witness_len FROM k WHERE k = 1""",
    "initial_blocks": """WITH l AS (SELECT l_orderkey AS pair_id, l_linenumber AS k, CASE WHEN l_linenumber % 2 = 1 THEN '+' ELSE '-' END AS strand, CAST(l_quantity AS BIGINT) AS n, l_partkey % 40 AS gr, l_suppkey % 30 AS gq FROM lineitem),
c AS (SELECT pair_id, strand, n, sum(n + gr) OVER w - n AS rb, sum(n + gq) OVER w - n AS u FROM l WINDOW w AS (PARTITION BY pair_id, strand ORDER BY k, n, gr, gq ROWS UNBOUNDED PRECEDING)),
x AS (SELECT pair_id, max(rb + n) + 10 AS rn, max(u + n) + 5 AS qn, CASE WHEN coalesce(sum(n) FILTER (WHERE strand = '-'), 0) > coalesce(sum(n) FILTER (WHERE strand = '+'), 0) THEN '-' ELSE '+' END AS bg FROM c GROUP BY pair_id),
a AS (SELECT c.*, x.rn, x.qn, x.bg, CASE WHEN strand = '+' THEN u ELSE qn - u - n END AS qb FROM c JOIN x USING (pair_id)),
sp AS (SELECT pair_id, rb, rb + n AS re, u, u + n AS ue, 0 AS side FROM a WHERE strand = bg UNION ALL SELECT pair_id, 0, 0, 0, 0, -1 FROM x UNION ALL SELECT pair_id, rn, rn, qn, qn, 1 FROM x),
gp AS (SELECT pair_id, re AS rb, lead(rb) OVER o AS re, ue AS u, lead(u) OVER o AS ue, side = 0 AND lead(side) OVER o = 0 AS mid FROM sp WINDOW o AS (PARTITION BY pair_id ORDER BY rb, side, re)),
bl AS (SELECT pair_id, rb, re, u, ue, true AS skeleton, false AS mid FROM sp WHERE side = 0 UNION ALL SELECT pair_id, rb, re, u, ue, false, mid FROM gp WHERE re > rb OR ue > u),
b AS (SELECT bl.pair_id, bg, skeleton, mid, rb, re, CASE WHEN bg = '-' THEN qn - ue ELSE u END AS qb, CASE WHEN bg = '-' THEN qn - u ELSE ue END AS qe, row_number() OVER (PARTITION BY bl.pair_id ORDER BY rb, re, u) AS block_id FROM bl JOIN x USING (pair_id)),
i AS (SELECT b.pair_id, b.block_id, a.strand, greatest(0, a.n - greatest(b.rb - a.rb, CASE WHEN a.strand = '+' THEN b.qb - a.qb ELSE a.qb + a.n - b.qe END, 0) - greatest(a.rb + a.n - b.re, CASE WHEN a.strand = '+' THEN a.qb + a.n - b.qe ELSE b.qb - a.qb END, 0)) AS n
 FROM b JOIN a ON a.pair_id = b.pair_id WHERE NOT skeleton AND a.rb < b.re AND b.rb < a.rb + a.n),
s AS (SELECT pair_id, block_id, sum(CASE WHEN strand = '+' THEN n ELSE 0 END) AS f, sum(CASE WHEN strand = '-' THEN n ELSE 0 END) AS r FROM i GROUP BY ALL),
j AS (SELECT b.*, CAST(CASE WHEN skeleton THEN CASE WHEN bg = '+' THEN re - rb ELSE 0 END ELSE coalesce(f, 0) END AS BIGINT) AS forward_support, CAST(CASE WHEN skeleton THEN CASE WHEN bg = '-' THEN re - rb ELSE 0 END ELSE coalesce(r, 0) END AS BIGINT) AS reverse_support FROM b LEFT JOIN s USING (pair_id, block_id)),
d AS (SELECT *, NOT skeleton AND forward_support = reverse_support AS tentative, CASE WHEN skeleton OR forward_support = reverse_support THEN bg WHEN reverse_support > forward_support THEN '-' ELSE '+' END AS strand FROM j)
SELECT pair_id, block_id, skeleton, tentative, mid AND strand <> bg AS inversion_candidate, strand, CAST(rb AS BIGINT) AS rb, CAST(re AS BIGINT) AS re, CAST(qb AS BIGINT) AS qb, CAST(qe AS BIGINT) AS qe, forward_support, reverse_support FROM d""",
    "overlap_violations": f"""WITH {_SPAN}, s AS (SELECT DISTINCT query_id, strand, b, e FROM span)
SELECT query_id, strand, b AS "begin", e AS "end", false AS merged FROM (SELECT *, max(e) OVER (PARTITION BY query_id, strand ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s) WHERE r > b""",
    "fasta_roundtrip": f"WITH {_REFS} SELECT 'doc' || seq_id AS name, length(bases) AS length, sha256(bases) AS sha256 FROM refs WHERE bases <> ''",
    "index_roundtrip": f"WITH {_REFS} SELECT 'doc' || seq_id AS name, length(bases) AS length, sha256(bases) AS fingerprint, greatest(length(bases) - {K - 1}, 0) AS kmers FROM refs",
}
