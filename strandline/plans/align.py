"""Pairwise alignment of two collections: seeds, chains, linked anchors, selection, main path."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.errors import InputError, StrandlineError, UsageError
from strandline.functions import sequence
from strandline.operators import seeds as seed_operators
from strandline.operators.chain import ChainOptions, chains
from strandline.operators.link import align_chains
from strandline.operators.mainpath import link_main_path
from strandline.operators.select import one_to_one, with_primary
from strandline.operators.steps import cut
from strandline.sinks import formats, runs, validate
from strandline.sources import index
from strandline.sources.fasta import read_fasta


@dataclass(frozen=True)
class Options:
    mode: str = "fast"
    min_match: int = 20
    smem_min_occurrences: int = 1
    chain: ChainOptions = field(default_factory=ChainOptions)

    def __post_init__(self) -> None:
        if self.mode not in seed_operators.MODES:
            raise UsageError(f"unknown seed mode {self.mode!r}")
        if self.min_match < 1 or self.smem_min_occurrences < 1:
            raise UsageError("min_match and smem_min_occurrences are 1 or more")


def check_seeds(rows: DataFrame, reference: DataFrame, queries: DataFrame, least: int = 1) -> None:
    """An InputError if given seeds have unknown ids, are out of bounds, shorter than ``least``, or not exact."""
    sizes = lambda df, name: df.select(F.col("seq_id").alias(f"{name}_id"), F.length("bases").alias(f"{name}_n"))
    known = rows.join(sizes(reference, "ref"), "ref_id", "left").join(sizes(queries, "query"), "query_id", "left")
    inside = (F.col("rb") >= 0) & (F.col("qb") >= 0) & (F.col("rb") + F.col("len") <= F.col("ref_n")) & (F.col("qb") + F.col("len") <= F.col("query_n")) & (F.col("len") >= least) & F.col("strand").isin("+", "-")
    if known.where(~F.coalesce(inside, F.lit(False))).limit(1).count():
        raise InputError("a seed is of no known sequence, out of bounds or too short")
    if seed_operators.inexact(rows, reference, queries).limit(1).count():
        raise InputError("a seed isn't exact")


def candidates(reference: DataFrame, queries: DataFrame, options: Options = Options(), seeds: DataFrame | None = None, indexed: index.Index | None = None) -> DataFrame:  # noqa: B008
    """All linked anchors of (seq_id, bases) against (seq_id, bases), from their own seeds or from given ones; the reference's k-mers may come from its index."""
    if seeds is None:
        if indexed is not None and indexed.k != options.min_match:
            raise UsageError(f"the index is of {indexed.k} bases, not {options.min_match}")
        seeds = seed_operators.seeds(reference, queries, options.mode, options.min_match, options.smem_min_occurrences, None if indexed is None else indexed.kmers)
    else:
        check_seeds(seeds, reference, queries)
    return align_chains(chains(seeds, options.chain), reference, queries)


def align(reference: DataFrame, queries: DataFrame, options: Options = Options(), seeds: DataFrame | None = None, selection: str = "linked", indexed: index.Index | None = None) -> DataFrame:  # noqa: B008
    """Alignments with primary. selection: ``all`` candidates, ``one_to_one`` ones, or those ``linked`` along the main path."""
    found = candidates(reference, queries, options, seeds, indexed).persist()  # read once for each axis; made again if an executor is lost
    if selection == "all":
        return with_primary(found)
    if selection not in ("one_to_one", "linked"):
        raise UsageError(f"unknown selection {selection!r}")
    chosen = one_to_one(found)
    if selection == "linked":
        chosen = link_main_path(cut(chosen), reference, queries, options.min_match, options.chain.min_cluster).drop("members")
    return with_primary(chosen)


def written(rows: DataFrame, reference: DataFrame, queries: DataFrame, outputs: dict[str, str]) -> None:
    """The ``outputs`` (format: path), all or none: what was put in place is taken back if a later one fails. Each is checked where it lies."""
    spark = rows.sparkSession
    done: list[str] = []
    try:
        for kind, path in outputs.items():
            formats.publish(formats.lines(kind, rows, reference, queries), path)
            done.append(path)
            validate.check(spark, kind, path)
    except BaseException:
        for path in done:
            formats.withdrawn(spark, path)
        raise


def align_files(spark: SparkSession, reference: str, query: str, outputs: dict[str, str], options: Options = Options(), selection: str = "linked", index_path: str | None = None, save: str | None = None) -> int:  # noqa: B008
    """Align two FASTA files and write ``outputs`` (format: path); the number of alignments. The reference's index is read from ``index_path``, or made and kept at ``save``."""
    if index_path and save:
        raise UsageError("an index is either read or saved")
    refs, qs = read_fasta(spark, reference).persist(), read_fasta(spark, query).persist()
    if save:
        index.build(refs, save, options.min_match)
    indexed = index.load(spark, index_path or save, refs) if index_path or save else None
    rows = align(refs, qs, options, selection=selection, indexed=indexed).persist()
    written(rows, refs, qs, outputs)
    return rows.count()


def batch(spark: SparkSession, reference: str, queries: list[tuple[str, str]], folder: str, formats_: tuple[str, ...] = ("paf",), options: Options = Options(), index_path: str | None = None) -> DataFrame:  # noqa: B008
    """Align each (name, path) to one reference, all candidates; (name, status, exit_code, alignments, message) of each. A failed query doesn't stop the others.

    ``folder`` gets batch.tsv, with a row a query as it ends, and a log for each. The reference's k-mers are made once, or read from its index.
    """
    refs = read_fasta(spark, reference).persist()
    if index_path:
        indexed = index.load(spark, index_path, refs)
    else:
        own = sequence.kmers(refs, options.min_match, packed=options.min_match <= sequence.MOST_PACKED).persist()
        indexed = index.Index(own, index.manifest_of(refs, options.min_match), options.min_match)
    table = runs.BatchTable(spark, folder)
    done = []
    for order, (name, path) in enumerate(queries, 1):
        began = time.time()
        log = runs.RunLog(spark, f"{folder}/{name}", ["align", reference, path])
        status, code, n, message = "ok", 0, 0, ""
        try:
            qs = read_fasta(spark, path)
            rows = align(refs, qs, options, selection="all", indexed=indexed).persist()
            written(rows, refs, qs, {kind: f"{folder}/{name}/alignments.{kind}" for kind in formats_})
            n = rows.count()
            rows.unpersist()
        except StrandlineError as e:
            status, code, message = "failed", e.exit_code, str(e)
        except Exception as e:  # a query's own trouble, such as a file that can't be read
            status, code, message = "failed", 1, str(e).splitlines()[0] if str(e) else type(e).__name__
        log.put(alignments=n)
        log.close(status, code)
        table.row(order, name, path, status, code, f"{time.time() - began:.3f}", n, f"{folder}/{name}", log.path, message)
        done.append((name, status, code, n, message))
    table.close()
    return spark.createDataFrame(done, "name string, status string, exit_code int, alignments long, message string")
