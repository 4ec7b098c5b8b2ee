"""Clusters of seeds and their best chains, one pair of sequences and strand at a time.

Seeds more than the longest gap apart along the query can't be in one cluster, so they are split there first, by a
window over the pair; each part is a group of its own, and no task holds a whole pair.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.intervals import split_components
from strandline.operators.seeds import KEY
from strandline.operators.steps import by_group


@dataclass(frozen=True)
class ChainOptions:
    max_gap: int = 90
    diag_diff: int = 5
    diag_factor: float = 0.12
    min_cluster: int = 65


Seed = tuple[int, int, int]  # rb, qb, len


def _loser(a: Seed, b: Seed) -> Seed | None:
    """Of two seeds that begin at the same place on one sequence, that which yields: the shorter one if the other covers half of it
    or more. An equally long one yields to neither at first (the later one, b, is returned)."""
    axis = 1 if a[0] == b[0] else 0  # where they differ
    short = b if b[2] <= a[2] else a
    return short if a[axis] + a[2] - b[axis] >= short[2] // 2 else None


def filtered(seeds: list[Seed]) -> list[Seed]:
    """Seeds in order of (qb, rb, len): those of one diagonal that meet are one, and of two that begin at the same place on either sequence the
    shorter yields to the longer if half of it or more is reached. Of equally long ones the later is in doubt, and one in doubt yields to a later equal."""
    # Islands along each diagonal.
    by_diagonal: dict[int, list[list[int]]] = {}
    for rb, qb, n in sorted(seeds, key=lambda s: (s[1], s[0], s[2])):
        island = by_diagonal.setdefault(qb - rb, [])
        if island and qb <= island[-1][1]:
            island[-1][1] = max(island[-1][1], qb + n)
        else:
            island.append([qb, qb + n])
    whole = sorted(((b - d, b, e - b) for d, spans in by_diagonal.items() for b, e in spans), key=lambda s: (s[1], s[0], s[2]))
    # Rivals: the seeds behind one, in order, that begin where it does and are reached by it.
    rivals: list[list[int]] = [[] for _ in whole]
    for own, other in ((0, 1), (1, 0)):
        groups: dict[int, list[int]] = {}
        for k, s in enumerate(whole):
            groups.setdefault(s[own], []).append(k)
        for group in groups.values():
            group.sort(key=lambda k: (whole[k][other], k))
            for at, k in enumerate(group):
                for x in group[at + 1 :]:
                    if whole[x][other] > whole[k][other] + whole[k][2]:
                        break
                    rivals[min(k, x)].append(max(k, x))
    out: set[int] = set(range(len(whole)))
    doubted: set[int] = set()
    for k in range(len(whole)):
        for x in sorted(rivals[k]):
            if k not in out:
                break
            yields = _loser(whole[k], whole[x]) if x in out else None
            if yields is None:
                continue
            if whole[k][2] == whole[x][2]:
                doubted.add(x)
                if k in doubted:
                    out.discard(k)
            else:
                out.discard(k if yields is whole[k] else x)
    return [whole[k] for k in sorted(out)]


def clusters(seeds: list[Seed], strand: str, options: ChainOptions) -> list[list[Seed]]:
    """Connected components of seeds near each other along the query and in diagonal, in order of their first seed."""
    sign = 1 if strand == "+" else -1
    parent = list(range(len(seeds)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    begins = [qb for _, qb, _ in seeds]
    for i, (rb, qb, n) in enumerate(seeds):
        for j in range(i + 1, bisect_right(begins, qb + n + options.max_gap)):
            apart = begins[j] - qb - n
            off = abs((sign * begins[j] - seeds[j][0]) - (sign * qb - rb))
            if off <= max(options.diag_diff, int(options.diag_factor * apart)):
                parent[root(i)] = root(j)
    groups: dict[int, list[Seed]] = {}
    for i, s in enumerate(seeds):
        groups.setdefault(root(i), []).append(s)
    return list(groups.values())


def best_chain(seeds: list[Seed], strand: str) -> list[Seed]:
    """The chain of largest length less diagonal shifts. Neighbours have a base or more between them on both sequences;
    on the reverse strand the reference falls as the query rises. Of equal ones the first is taken."""
    rows = sorted(seeds, key=lambda s: (s[1], s[0], s[2]))
    if not rows:
        return []
    r, q, n = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    diagonal = (q if strand == "+" else -q) - r
    score, back = n.copy(), np.full(len(rows), -1)
    for i in range(1, len(rows)):
        ahead = (q[i] > q[:i] + n[:i]) & ((r[i] > r[:i] + n[:i]) if strand == "+" else (r[i] + n[i] < r[:i]))
        value = np.where(ahead, score[:i] + n[i] - np.abs(diagonal[i] - diagonal[:i]), -1)
        j = int(value.argmax())
        if value[j] > score[i]:
            score[i], back[i] = value[j], j
    at = int(score.argmax())
    out = []
    while at >= 0:
        out.append(rows[at])
        at = int(back[at])
    return out[::-1]


def pruned(chains: list[list[Seed]]) -> list[list[Seed]]:
    """Chains in order of their first place on the reference, without what overlaps the one kept before on either sequence."""
    out: list[list[Seed]] = []
    for chain in sorted(chains, key=lambda c: (min(s[0] for s in c), min(s[1] for s in c), len(c))):
        if out:
            end = max(rb + n for rb, _, n in out[-1])
            low, high = min(qb for _, qb, _ in out[-1]), max(qb + n for _, qb, n in out[-1])
            chain = [s for s in chain if s[0] >= end and (s[1] >= high or s[1] + s[2] <= low)]
        if chain:
            out.append(chain)
    return out


CHAIN = "ref_id long, query_id long, strand string, chain long, rb long, re long, qb long, qe long, weight long, seeds array<struct<rb:bigint,qb:bigint,len:bigint>>"


def chains(seeds: DataFrame, options: ChainOptions = ChainOptions()) -> DataFrame:  # noqa: B008
    """CHAIN: the best chain of each cluster whose seeds have min_cluster bases or more."""
    ends = seeds.withColumn("_qe", F.col("qb") + F.col("len"))
    parts = split_components(ends, KEY, "qb", "_qe", options.max_gap).drop("_qe")
    # No chain is longer than all seeds of its part; most parts are a chance match or two.
    size = F.sum("len").over(Window.partitionBy(*KEY, "component"))
    parts = parts.withColumn("_size", size).where(F.col("_size") >= options.min_cluster).drop("_size")

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        strand = key[2]
        found = filtered([row[-3:] for row in rows])
        out = []
        for k, cluster in enumerate(clusters(found, strand, options)):
            chain = best_chain(cluster, strand)
            weight = sum(n for _, _, n in chain)
            if weight >= options.min_cluster:
                items = [{"rb": int(r), "qb": int(q), "len": int(n)} for r, q, n in chain]
                out.append((key[0], key[1], strand, key[3] * (1 << 20) + k, min(s[0] for s in chain), max(s[0] + s[2] for s in chain), chain[0][1], chain[-1][1] + chain[-1][2], weight, items))
        return out

    return by_group(parts.select(*KEY, "component", "rb", "qb", "len"), [*KEY, "component"], run, CHAIN)
