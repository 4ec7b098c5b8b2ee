"""Vectorised words, word hashes and shingles over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes, whatever the size of an Arrow batch; a longer text is a run of its own.
RUN_BYTES = 1 << 20

_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of texts ``first`` to ``last - 1`` of a batch; those of the k-th of them lie from ``bounds[k]`` to ``bounds[k + 1]``."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows within them); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(texts: pa.Array, lower: bool = True, size: int = RUN_BYTES) -> Iterator[Words]:
    for first, last, data, offsets in runs(texts, size):
        data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a word ends with its text
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        yield Words(first, last, data, starts, ends, np.searchsorted(starts, offsets), offsets)


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    lengths = w.ends - w.starts
    index = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.ones(int(lengths.max()), np.uint64)
    power[1:] = _MULTIPLIER
    power = np.multiply.accumulate(power)
    part = _BYTE[w.data[np.repeat(w.starts, lengths) + index]] * power[index]
    return mix(np.add.reduceat(part, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row and, for each text, where its own begin; a text of 1 to n - 1 words has one, of all its words."""
    count = np.diff(bounds)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(own)])
    total = int(at[-1])
    begin = np.repeat(bounds[:-1], own) + (np.arange(total) - np.repeat(at[:-1], own))
    left = np.repeat(np.minimum(count, n), own)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        use = k < left
        if use.all():
            out = mix(out * _MULTIPLIER + h[begin + k])
        else:
            sub = out[use]
            out[use] = mix(sub * _MULTIPLIER + h[begin[use] + k])
    return out, at
