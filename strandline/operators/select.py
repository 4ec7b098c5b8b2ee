"""Selection of alignments: the heaviest set without overlaps on each reference and on each query, and primary ones."""

from __future__ import annotations

from bisect import bisect_right
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.steps import by_group, cut

#: An alignment's predecessor is among so many before it.
WINDOW = 5_000
ORDER = ["query_id", "qb", "ref_id", "rb", "strand", "qe", "re"]


def heaviest(begins: list[int], ends: list[int], weights: list[float], window: int = WINDOW) -> list[bool]:
    """Which of the intervals, in order of begin, make up the heaviest set without overlaps; of equal ones the earliest.

    An interval becomes a possible predecessor once its end is passed, and stops being one when it is more than
    ``window`` behind; the best of those is at the top of a heap.
    """
    n = len(begins)
    total, back = [0.0] * n, [-1] * n
    by_end = sorted(range(n), key=lambda k: (ends[k], k))
    ready = [ends[k] for k in by_end]
    given = 0
    heap: list[tuple[float, int]] = []
    waiting: list[tuple[int, int]] = []
    for i in range(n):
        # Only intervals before i have a total yet; begins are in order, so those that end by now began earlier.
        stop = bisect_right(ready, begins[i])
        while given < stop:
            heappush(waiting, (by_end[given], by_end[given]))
            given += 1
        later = []
        while waiting:
            _, k = heappop(waiting)
            if k < i:
                heappush(heap, (-total[k], k))
            else:
                later.append(k)
        for k in later:
            heappush(waiting, (k, k))
        while heap and heap[0][1] < i - window:
            heappop(heap)
        total[i] = weights[i]
        if heap and -heap[0][0] + weights[i] > weights[i]:
            total[i], back[i] = -heap[0][0] + weights[i], heap[0][1]
    kept = [False] * n
    at = max(range(n), key=lambda k: (total[k], -k), default=-1)
    while at >= 0:
        kept[at] = True
        at = back[at]
    return kept


def weight(matches: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Columns times the square of the identity, matches rounded to single precision."""
    return columns * (matches.astype(np.float32).astype(np.float64) / columns) ** 2


def _one_axis(rows: DataFrame, by: str, begin: str, end: str, flag: str) -> DataFrame:
    narrow = rows.select(by, begin, end, "aid", "matches", "columns")

    def run(_: tuple, group: list[tuple]) -> list[tuple]:
        _, begins, ends, aids, matches, columns = zip(*sorted(group), strict=True)
        kept = heaviest(list(begins), list(ends), weight(np.array(matches), np.array(columns)).tolist()) if len(group) > 1 else [True]
        return list(zip(aids, kept, strict=True))

    return by_group(narrow, [by], run, f"aid long, {flag} boolean")


def numbered(alignments: DataFrame) -> DataFrame:
    """With aid, a hash of what identifies an alignment."""
    return alignments.withColumn("aid", F.xxhash64("ref_id", "rb", "re", "query_id", "qb", "qe", "strand"))


def bilateral(alignments: DataFrame) -> DataFrame:
    """The alignments with ref_selected and query_selected; what is selected on both axes is one to one."""
    rows = cut(numbered(alignments).dropDuplicates(["aid"]))  # read once for each axis
    on_ref = _one_axis(rows, "ref_id", "rb", "re", "ref_selected")
    on_query = _one_axis(rows, "query_id", "qb", "qe", "query_selected")
    return rows.join(on_ref, "aid").join(on_query, "aid").drop("aid")


def one_to_one(alignments: DataFrame) -> DataFrame:
    return bilateral(alignments).where("ref_selected and query_selected").drop("ref_selected", "query_selected")


def with_primary(alignments: DataFrame) -> DataFrame:
    """With primary: the first alignment of each query in the final order."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*[c for c in ORDER if c != "query_id"]))
    return alignments.withColumn("primary", rank == 1)
