"""Words of k bases as numbers, straight from the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Two bits a base fill an unsigned long.
MOST = 32
#: Places are looked at in steps of so many.
STEP = 1 << 18

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def packed(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The word of k bases at each byte, two bits a base, and which of them have canonical bases only (None: all)."""
    base = _CODE[data]
    n = len(base) - k + 1
    bad = base > 3
    ok = None
    if bad.any():
        so_far = np.concatenate([[0], np.cumsum(bad)])
        ok = so_far[k:] == so_far[:-k]
    out, at, size, word = np.zeros(n, np.uint64), 0, 1, base & 3
    parts = {}
    while size <= k:
        parts[size] = word
        wider = {1: np.uint8, 2: np.uint8, 4: np.uint16, 8: np.uint32, 16: np.uint64}.get(size)
        if wider is None or 2 * size > k:
            break
        wide = word.astype(wider)
        word = (wide[:-size] << wider(2 * size)) | wide[size:]
        size *= 2
    for size in sorted(parts, reverse=True):
        if k & size:
            piece = parts[size][at : at + n].astype(np.uint64)
            out = piece if not at else (out << np.uint64(2 * size)) | piece
            at += size
    return out, ok


class Wanted:
    """A set of words, asked for many at once: a table of hashes first, then the sorted words."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self.shift = np.uint64(64 - max(16, int(32 * len(self.words)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.words * _SPREAD) >> self.shift] = True

    def among(self, words: np.ndarray) -> np.ndarray:
        """The places of the words that are in the set."""
        if not len(self.words):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(words * _SPREAD) >> self.shift])
        there = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        return at[self.words[there] == words[at]]


#: Hits are made into matches so many at a time, or those of one place.
HITS = 1 << 20


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its rows begin and end in them."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8), offsets


class Places:
    """Where a set of oriented queries has its words: their places lie beside each other, in order of the words."""

    def __init__(self, word: np.ndarray, query: np.ndarray, at: np.ndarray):
        order = np.argsort(word, kind="stable")
        self.wanted, self.query, self.at = Wanted(word), query[order], at[order]
        self.begin = np.searchsorted(word[order], self.wanted.words)
        self.count = np.diff(np.append(self.begin, len(word)))


def _runs(batch: pa.RecordBatch, k: int, places: Places) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, query, begin in the row, begin in the query, hits): the hits that follow each other on a diagonal, made one.

    What reaches the end of a step goes on in the next.
    """
    data, offsets = _bytes(batch.column(1))
    kept = tuple(np.zeros(0, np.int64) for _ in range(5))  # row, query, diagonal, first and last place
    for begin in range(int(offsets[0]), int(offsets[-1]) - k + 1, STEP):
        words, ok = packed(data[begin : min(begin + STEP + k - 1, int(offsets[-1]))], k)
        at = places.wanted.among(words)
        row = np.searchsorted(offsets, begin + at, "right") - 1
        inside = begin + at + k <= offsets[row + 1]
        if ok is not None:
            inside &= ok[at]
        at, row = at[inside], row[inside]
        which = np.searchsorted(places.wanted.words, words[at])
        total = np.cumsum(places.count[which])
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + HITS, "right")))
            n = places.count[which[first:last]]
            own = np.repeat(np.arange(first, last), n)
            there = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(places.begin[which[first:last]], n)
            i = begin + at[own]
            fresh = (row[own], places.query[there], i - places.at[there], i, i)
            r, q, d, b, e = (np.concatenate(x) for x in zip(kept, fresh, strict=True))
            order = np.lexsort((b, d, q, r))
            r, q, d, b, e = (x[order] for x in (r, q, d, b, e))
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (q[1:] != q[:-1]) | (d[1:] != d[:-1]) | (b[1:] != e[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(r)) - 1
            r, q, d, b, e = r[head], q[head], d[head], b[head], e[tail]
            open_ = e == begin + at[last - 1]
            kept = tuple(x[open_] for x in (r, q, d, b, e))
            done = ~open_
            yield r[done], q[done], b[done] - offsets[r[done]], b[done] - d[done], (e - b)[done] + 1
            first = last
    r, q, d, b, e = kept
    yield r, q, b - offsets[r], b - d, e - b + 1


def matches(reference: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(ref_id, rb, query_id, qb, len, strand, oqb, oqe): the maximal exact matches of k bases or more of (seq_id, bases) with few oriented queries
    (query_id, strand, length, bases), which go to all tasks. A sequence's matches are made where it is read; no hit is moved.
    """
    if not 1 <= k <= MOST:
        raise ValueError(f"words have 1 to {MOST} bases")
    kinds = reference.schema["seq_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    given = queries.where("bases is not null").select("query_id", "bases", "strand", "length").toArrow()
    given = given.combine_chunks().to_batches()
    word, query, at = ([np.zeros(0, np.int64)] for _ in range(3))
    for batch in given:
        data, offsets = _bytes(batch.column(1))
        for x in range(len(batch)):
            own = data[offsets[x] : offsets[x + 1]]
            if len(own) >= k:
                w, ok = packed(own, k)
                j = np.arange(len(w)) if ok is None else np.flatnonzero(ok)
                word, query, at = [*word, w[j].view(np.int64)], [*query, np.full(len(j), x)], [*at, j]
    columns = [given[0].column(c) for c in ("query_id", "strand", "length")] if given else None
    asked = reference.sparkSession.sparkContext.broadcast((np.concatenate(word).view(np.uint64), np.concatenate(query), np.concatenate(at), columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *listed, columns = asked.value
        if columns is None:
            return
        places = Places(*listed)
        length = columns[2].to_numpy()
        reverse = np.array(columns[1].to_pylist()) == "-"
        for batch in batches:
            for row, query, rb, oqb, hits in _runs(batch, k, places):
                if len(row):
                    size = hits + k - 1
                    qb = np.where(reverse[query], length[query] - oqb - size, oqb)
                    of = pa.array(query)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(rb), columns[0].take(of), pa.array(qb), pa.array(size), columns[1].take(of), pa.array(oqb), pa.array(oqb + size)], ["ref_id", "rb", "query_id", "qb", "len", "strand", "oqb", "oqe"]
                    )

    # Null bases are left to _bytes: a filter would make the column of bases once more.
    return reference.select("seq_id", "bases").mapInArrow(run, f"ref_id {kinds[0]}, rb long, query_id {kinds[1]}, qb long, len long, strand string, oqb long, oqe long")


def _found(batch: pa.RecordBatch, k: int, wanted: Wanted | None) -> Iterator[pa.RecordBatch]:
    ids = batch.column(0)
    data, offsets = _bytes(batch.column(1))
    for begin in range(int(offsets[0]), int(offsets[-1]) - k + 1, STEP):
        words, ok = packed(data[begin : min(begin + STEP + k - 1, int(offsets[-1]))], k)
        at = np.arange(len(words)) if wanted is None else wanted.among(words)
        row = np.searchsorted(offsets, begin + at, "right") - 1
        inside = begin + at + k <= offsets[row + 1]
        if ok is not None:
            inside &= ok[at]
        at, row = at[inside], row[inside]
        if len(at):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(begin + at - offsets[row]), pa.array(words[at].view(np.int64))], [batch.schema.names[0], "pos", "kmer"])


def words(sequences: DataFrame, k: int, wanted: DataFrame | None = None, id_column: str = "seq_id", bases: str = "bases") -> DataFrame:
    """(id, pos, kmer) of every window of k canonical bases, packed; with ``wanted`` (kmer), which goes to all tasks, of those in it only.

    Up to MOST_PACKED bases a word is that of ``sequence.kmer_code``; with 32 the highest bit is the sign.
    """
    if not 1 <= k <= MOST:
        raise ValueError(f"words have 1 to {MOST} bases")
    kind = sequences.schema[id_column].dataType.simpleString()
    asked = None
    if wanted is not None:
        listed = wanted.select("kmer").distinct().toPandas()["kmer"].to_numpy(np.int64).view(np.uint64)
        asked = sequences.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = None if asked is None else Wanted(asked.value)
        for batch in batches:
            yield from _found(batch, k, chosen)

    return sequences.select(id_column, bases).mapInArrow(run, f"{id_column} {kind}, pos long, kmer long")
