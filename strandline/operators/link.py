"""Anchors from chains, and anchors linked across gaps that close, by components of near anchors.

A component is one row: its chains, and the stretch of both sequences that they span and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.functions import kernels
from strandline.functions.kernels import Cigar
from strandline.operators.chain import Seed, pruned
from strandline.operators.intervals import split_components
from strandline.operators.seeds import KEY
from strandline.operators.steps import cut, dealt, made, rows_of

# How far anchors are linked, and how many candidates are looked at.
REACH = 10_000
LOOK = 2_000
NEAR = 200

ALIGNMENT = "ref_id long, rb long, re long, query_id long, qb long, qe long, strand string, cigar array<struct<op:string,len:bigint>>, score long, edits long, matches long, columns long"


@dataclass
class Anchor:
    """Places on the reference and on the oriented query."""

    rb: int
    re: int
    qb: int
    qe: int
    cigar: Cigar


def anchor_of(chain: list[Seed], ref: str, query: str) -> Anchor | None:
    """A chain of oriented seeds with the gaps between them aligned end to end; None if one is too large."""
    chain = sorted(chain)
    cigar: Cigar = []
    for k, (rb, qb, n) in enumerate(chain):
        if k:
            r, q, m = chain[k - 1]
            gap = kernels.global_alignment(ref[r + m : rb], query[q + m : qb])
            if gap is None:
                return None
            cigar = kernels.joined(cigar, gap[0])
        kernels.push(cigar, "=", n)
    return Anchor(chain[0][0], chain[-1][0] + chain[-1][2], chain[0][1], chain[-1][1] + chain[-1][2], cigar)


def linked(anchors: list[Anchor], ref: str, query: str) -> list[Anchor]:
    """Anchors that grow over the nearest next one as long as the gap to it closes. One that can't go on takes over the gap to that of those
    given out before which is nearest, if it closes. What it encloses up to the one it couldn't reach is dropped, and so is what begins before its end on the reference."""
    todo = sorted(anchors, key=lambda a: (a.rb, a.qb, a.re))
    used = [False] * len(todo)
    out: list[Anchor] = []

    def gap(a: Anchor, b: Anchor) -> tuple[int, int]:
        return b.rb - a.re, b.qb - a.qe

    def cost(r: int, q: int) -> int:
        return 2 * max(r, q) - min(r, q)

    def ahead(now: Anchor, at: int) -> int | None:
        """The first unused one that is near in either sense, else that of least cost."""
        best, looked = None, 0
        for k in range(at + 1, len(todo)):
            if used[k]:
                continue
            looked += 1
            if looked > LOOK:
                break
            r, q = gap(now, todo[k])
            if min(r, q) < 0:
                continue
            if max(r, q) < NEAR or abs(r - q) <= NEAR:
                return k
            if best is None or cost(r, q) < best[0]:
                best = (cost(r, q), k)
        return None if best is None else best[1]

    def behind(now: Anchor) -> Anchor | None:
        """Of those given out last, that of least cost within reach; of equal ones the latest."""
        gaps = [(cost(r, q), -k) for k, (r, q) in enumerate(gap(o, now) for o in out[-LOOK:]) if 0 <= min(r, q) and max(r, q) <= REACH]
        return out[-LOOK:][-min(gaps)[1]] if gaps else None

    def closed(a: Anchor, b: Anchor) -> Cigar | None:
        r, q = gap(a, b)
        if r > REACH or q > REACH:
            return None
        if not r and not q:
            return []
        found = kernels.extension(ref[a.re : b.rb], query[a.qe : b.qb])
        return None if found is None else found[0]

    at = 0
    while at < len(todo):
        now = todo[at]
        while True:
            k = ahead(now, at)
            path = None if k is None else closed(now, todo[k])
            if k is None or path is None:
                break
            used[k] = True
            now = Anchor(now.rb, todo[k].re, now.qb, todo[k].qe, kernels.joined(now.cigar, path, todo[k].cigar))
        before = behind(now)
        path = closed(before, now) if before is not None else None
        if before is not None and path:
            now = Anchor(before.re, now.re, before.qe, now.qe, kernels.joined(path, now.cigar))
        out.append(now)
        for x in range(at + 1, len(todo) if k is None else k):
            if todo[x].re <= now.re and todo[x].qe <= now.qe:
                used[x] = True
        at = next((x for x in range(at + 1, len(todo)) if not used[x] and todo[x].rb >= now.re), len(todo))
    return out


#: Sequences are looked up by a broadcast of their ids up to this number (16 MB), else all are shuffled.
BROADCAST_IDS = 1_000_000


def only(sequences: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """The sequences (seq_id, ...) that ``rows`` name in ``column``: what isn't asked for isn't moved. ``rows`` are read for this."""
    ids = cut(rows.select(F.col(column).alias("seq_id")).distinct())
    return sequences.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "seq_id", "left_semi")


def stretches(parts: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows (KEY, rb, re, qb, qe) with ref_part and query_part: their bases, the query's as it is on the forward strand."""
    refs = only(reference, parts, "ref_id").select(F.col("seq_id").alias("ref_id"), F.col("bases").cast("binary").alias("_r"))
    qs = queries.select(F.col("seq_id").alias("query_id"), F.col("bases").cast("binary").alias("_q"))
    cut_r = F.expr("cast(substring(_r, int(rb + 1), int(re - rb)) as string)").alias("ref_part")
    cut_q = F.expr("cast(substring(_q, int(qb + 1), int(qe - qb)) as string)").alias("query_part")
    return parts.join(refs, "ref_id").select(*parts.columns, cut_r).join(qs, "query_id").select(*parts.columns, "ref_part", cut_q)


def align_chains(chains: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    """ALIGNMENT: linked anchors of all chains; qb and qe are on the forward query, the CIGAR follows the reference."""
    split = cut(split_components(chains, KEY, "rb", "re", REACH).select(*KEY, "component", "rb", "re", "qb", "qe", "seeds"))
    by = [*KEY, "component"]
    spans = [F.min("rb").alias("rb"), F.max("re").alias("re"), F.min("qb").alias("qb"), F.max("qe").alias("qe")]
    extents = split.groupBy(*by).agg(*spans, F.array_sort(F.collect_list("seeds")).alias("chains"))
    bases = stretches(extents, reference, queries)
    kind = to_arrow_schema(StructType.fromDDL(ALIGNMENT))

    def aligned(row: tuple) -> Iterator[tuple]:
        ref_id, query_id, strand, _, rb, _, qb, qe, chains, ref, query = row
        size = qe - qb
        query = query if strand == "+" else kernels.reverse_complement(query)

        def local(s: dict) -> Seed:
            q = s["qb"] - qb
            return s["rb"] - rb, (q if strand == "+" else size - q - s["len"]), s["len"]

        kept = pruned([[local(s) for s in seeds] for seeds in chains])
        anchors = [a for a in (anchor_of(c, ref, query) for c in kept) if a is not None]
        for a in linked(anchors, ref, query):
            cigar, score, edits = kernels.replay(a.cigar, ref[a.rb : a.re], query[a.qb : a.qe])
            first, last = (a.qb, a.qe) if strand == "+" else (size - a.qe, size - a.qb)
            matches = sum(n for op, n in cigar if op == "=")
            yield ref_id, rb + a.rb, rb + a.re, query_id, qb + first, qb + last, strand, [{"op": op, "len": n} for op, n in cigar], score, edits, matches, sum(n for _, n in cigar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made((out for row in rows_of(batches) for out in aligned(row)), kind)

    return dealt(bases, by).mapInArrow(run, ALIGNMENT)
