"""Command line: align, index and batch. Exit codes are those of ``errors``; 2 is wrong usage, 130 and 143 an interrupt and an end."""

from __future__ import annotations

import argparse
import signal
import sys
import threading

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.errors import StrandlineError, UnsupportedError, UsageError
from strandline.operators.chain import ChainOptions
from strandline.operators.seeds import MODES
from strandline.plans import align as plan
from strandline.plans.centromere import align_centromere
from strandline.sinks import centromere as segments
from strandline.sinks.formats import FORMATS, publish, withdrawn
from strandline.sinks.runs import RunLog
from strandline.sources import index
from strandline.sources.fasta import read_fasta
from strandline.sources.regions import check_bounds, read_bed, read_directions, read_query_list


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    commands = top.add_subparsers(dest="command", required=True)

    def seeds(p: argparse.ArgumentParser) -> None:
        p.add_argument("--mode", choices=MODES, default="fast")
        p.add_argument("--min-match", type=int, default=20)
        p.add_argument("--smem-min-occurrences", type=int, default=1)
        p.add_argument("--max-gap", type=int, default=90)
        p.add_argument("--diag-diff", type=int, default=5)
        p.add_argument("--diag-factor", type=float, default=0.12)
        p.add_argument("--min-cluster", type=int, default=65)
        p.add_argument("--print-effective-config", action="store_true")

    one = commands.add_parser("align", help="align two FASTA files")
    one.add_argument("reference")
    one.add_argument("query")
    one.add_argument("-o", "--output", action="append", required=True, help="a file; its suffix is the format")
    one.add_argument("-c", "--centromere", action="store_true", help="one record on each side, rich in repeats; tables are written beside the outputs")
    one.add_argument("--directions", help="with -c, a table of regions and their directions")
    one.add_argument("--ref-cen", "--reference-centromeres", help="regions of the reference, with --query-cen")
    one.add_argument("--query-cen", "--query-centromeres", help="regions of the queries, with --ref-cen")
    one.add_argument("--reference-index", help="an index made by index or --save")
    one.add_argument("--save", help="keep the reference's index here")
    seeds(one)
    made = commands.add_parser("index", help="index a reference")
    made.add_argument("reference")
    made.add_argument("--save", required=True)
    made.add_argument("--min-match", type=int, default=20)
    many = commands.add_parser("batch", help="align a list of queries to one reference")
    many.add_argument("reference")
    many.add_argument("queries")
    many.add_argument("-o", "--output", required=True, help="a folder")
    many.add_argument("--format", action="append", choices=FORMATS)
    many.add_argument("--reference-index", help="an index made by index or --save")
    seeds(many)
    for p in (one, made, many):
        p.add_argument("--log-dir", help="a folder for the run's log")
    return top


def outputs(paths: list[str]) -> dict[str, str]:
    """Format by suffix; a UsageError for an unknown suffix or a format given twice."""
    out: dict[str, str] = {}
    for path in paths:
        kind = path.rpartition(".")[2].lower()
        if kind not in FORMATS or kind in out:
            raise UsageError(f"{path}: an unknown format, or one given twice")
        out[kind] = path
    return out


def check_annotations(spark: SparkSession, given: argparse.Namespace) -> None:
    """The regions on both sides are read and checked against the sequences; they are given together and not with -c, and there is no alignment within them."""
    if given.centromere:
        raise UsageError("-c can't be combined with --ref-cen or --query-cen")
    if not (given.ref_cen and given.query_cen):
        raise UsageError("--ref-cen and --query-cen are given together")
    for bed, fasta in ((given.ref_cen, given.reference), (given.query_cen, given.query)):
        check_bounds(read_bed(spark, bed), read_fasta(spark, fasta))
    raise UnsupportedError("alignment within annotated regions isn't supported")


TABLES = {
    "regions": (("region_id", "query_begin", "query_end", "strand"), ["pair_id", "region_id"]),
    "anchors": (("region_id", "chain_index", "reference_begin", "reference_end", "query_begin", "query_end", "strand", "length", "weight"), ["pair_id", "region_id", "chain_index"]),
    "unanchored": (("begin", "end", "status"), ["pair_id", "begin"]),
    "copy-jobs": (("job", "axis", "scout", "target_begin", "target_end", "source_begin", "source_end", "left_id", "right_id"), ["pair_id", "job"]),
    "summary": (("reference_length", "query_length", "segments", "matches", "edits", "score", "gaps", "unresolved", "complete"), ["pair_id"]),
}


def align_pair(spark: SparkSession, given: argparse.Namespace) -> None:
    """One repeat-rich pair: its segments in the formats asked for, and beside the first one the tables of the run."""
    wanted = outputs(given.output)
    if any(kind not in segments.FORMATS for kind in wanted):
        raise UsageError(f"with -c, outputs are {', '.join(segments.FORMATS)}")
    refs, queries = read_fasta(spark, given.reference).persist(), read_fasta(spark, given.query).persist()
    if refs.count() != 1 or queries.count() != 1:
        raise UsageError("-c takes one record on each side")
    directions = None
    if given.directions:
        pair = queries.first()["seq_id"]
        directions = read_directions(spark, given.directions).withColumn("pair_id", F.lit(pair))
    found = align_centromere(refs.select("seq_id", "bases"), queries.select("seq_id", "bases"), directions, k=given.min_match)
    complete = found.summary.select("pair_id", "complete")
    texts = {path: segments.lines(kind, found.segments, refs, queries, complete) for kind, path in wanted.items()}
    stem = given.output[0].rpartition(".")[0]
    texts |= {f"{stem}.segments.tsv": segments.segment_table(found.segments), f"{stem}.gaps.tsv": segments.gap_table(found.gaps)}
    texts |= {f"{stem}.{name}.tsv": segments.table_lines(getattr(found, name.replace("-", "_")), *shape) for name, shape in TABLES.items()}
    done: list[str] = []
    try:
        for path, text in texts.items():
            publish(text, path)
            done.append(path)
    except BaseException:
        for path in done:
            withdrawn(spark, path)
        raise


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    mine = threading.current_thread() is threading.main_thread()
    before = signal.signal(signal.SIGTERM, _ended) if mine else None
    try:
        return _run(given, args, spark)
    finally:
        if mine:
            signal.signal(signal.SIGTERM, before)


def _run(given: argparse.Namespace, args: list[str] | None, spark: SparkSession | None) -> int:
    log = None
    try:
        wanted = {} if given.command != "align" or given.centromere else outputs(given.output)
        options = None
        if given.command != "index":
            options = plan.Options(given.mode, given.min_match, given.smem_min_occurrences, ChainOptions(given.max_gap, given.diag_diff, given.diag_factor, given.min_cluster))
            if given.print_effective_config:
                print("\n".join(f"{k}={v}" for k, v in sorted(vars(given).items())))
        spark = spark or SparkSession.builder.appName("strandline").getOrCreate()
        if given.log_dir:
            log = RunLog(spark, given.log_dir, ["strandline", *(args if args is not None else sys.argv[1:])])
        if given.command == "index":
            index.build(read_fasta(spark, given.reference), given.save, given.min_match)
        elif given.command == "batch":
            done = plan.batch(spark, given.reference, read_query_list(spark, given.queries), given.output, tuple(given.format or ("paf",)), options, given.reference_index).collect()
            for r in done:
                print(f"{r['name']}\t{r['status']}\t{r['alignments']}\t{r['message']}")
            code = next((r["exit_code"] for r in done if r["exit_code"]), 0)
            if log is not None:
                log.close("ok" if not code else "failed", code)
            return code
        elif given.ref_cen or given.query_cen:
            check_annotations(spark, given)
        elif given.centromere:
            align_pair(spark, given)
        else:
            n = plan.align_files(spark, given.reference, given.query, wanted, options, index_path=given.reference_index, save=given.save)
            if log is not None:
                log.put(alignments=n)
    except StrandlineError as e:
        print(f"strandline: {e}", file=sys.stderr)
        if log is not None:
            log.close("failed", e.exit_code)
        return e.exit_code
    except (KeyboardInterrupt, Ended) as e:
        code = 143 if isinstance(e, Ended) else 130
        if spark is not None:
            spark.sparkContext.cancelAllJobs()
        if log is not None:
            log.close("interrupted", code)
        return code
    if log is not None:
        log.close("ok", 0)
    return 0


class Ended(Exception):
    """The process was asked to end."""


def _ended(*_: object) -> None:
    raise Ended


if __name__ == "__main__":
    sys.exit(main())
