"""Toxicity of texts under a noisy channel: deobfuscate by Viterbi decoding, then score the restored words.

* A character trigram model is counted over the words of all documents.
* A word that holds digits, signs or invisible separators among its letters, a letter twice in a row, or pieces of one or
  two letters between separators or spaces, becomes a lattice: each sign may stand for the letters it resembles, separators and repetitions
  may be dropped. The Viterbi path under the model and the channel's costs is the restored word.
* Words that mark labelled texts are learned from labelled rows: counts over all of them give candidates, and of
  those the ones that stand between various neighbours are kept. So words that merely come along with toxic ones
  (those of one text that was copied often, say) aren't.
* A text's score is a noisy or of the precisions of the kept words that it has, restored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textops
from strandline.llm.common import cut

#: A candidate is in so many toxic rows or more, and toxic rows are this part of its rows or more.
LEAST_ROWS = 5
LEAST_PRECISION = 0.8
#: A kept word stands between so many different pairs of neighbours in toxic rows.
LEAST_CONTEXTS = 3
#: Labels are broadcast up to this number of rows (16 MB), else joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: A text is predicted toxic from this score on.
TOXIC = 0.7

# What signs stand for, in place of letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SEPARATORS = frozenset(".-_*~^'`,:;/\\|+=#​‌‍﻿­")
#: Costs of the channel: a sign for a letter, a hidden letter, a separator dropped, a repetition dropped, a sign kept.
_SIGN, _HIDDEN, _DROP, _AGAIN, _KEEP = 0.5, 2.5, 0.3, 0.2, 6.0

# Symbols of the model: 0 the edge of a word, 1 to 26 letters, 27 anything else.
_SYMBOLS = 28
_CODE = np.full(256, 27, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[[9, 10, 11, 12, 13, 32]] = 0
_OTHER_ASCII = np.zeros(256, bool)
_OTHER_ASCII[33:128] = True
_OTHER_ASCII[97:123] = False
_OTHER_ASCII[65:91] = False
_UNSEEN = [np.frombuffer(c.encode(), np.uint8) for c in sorted(SEPARATORS) if not c.isascii()]
_CORE = np.zeros(256, bool)  # what a word may begin or end with
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 36, 64]] = True


def _word_runs(texts: pa.Array) -> Iterator[textops.Words]:
    """Lower-cased words without the punctuation around them; one of nothing but punctuation stays as it is."""
    for w in textops.words(pc.utf8_lower(texts), lower=False):
        starts, ends = w.starts.copy(), w.ends.copy()
        core = np.concatenate([[0], np.cumsum(_CORE[w.data])])
        has = core[ends] > core[starts]
        where = np.flatnonzero(_CORE[w.data])
        if len(where):
            first = np.searchsorted(where, starts[has])
            last = np.searchsorted(where, ends[has]) - 1
            starts[has], ends[has] = where[first], where[last] + 1
        yield w._replace(starts=starts, ends=ends)


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    w = textops.Words(0, 1, data, np.array([0]), np.array([len(data)]), np.array([0, 1]), np.array([0, len(data)]))
    return int(textops.hashes(w).view(np.int64)[0]) if len(data) else 0


def _squeezed(word: str) -> str:
    return "".join(c for k, c in enumerate(word) if not k or word[k - 1] != c)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n): trigrams of the words of each run of texts."""
    for batch in batches:
        for _, _, data, _ in textops.runs(pc.utf8_lower(batch.column(0))):
            code = np.concatenate([[0], _CODE[data], [0]]).astype(np.int64)
            three = (code[:-2] * _SYMBOLS + code[1:-1]) * _SYMBOLS + code[2:]
            three = three[code[1:-1] != 0]  # nothing is centred on a space
            n = np.bincount(three, minlength=_SYMBOLS**3)
            kept = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(n[kept].astype(np.int64))], ["code", "n"])


@dataclass
class Model:
    cost: np.ndarray  # of a symbol after two others
    words: dict[str, float] = field(default_factory=dict)  # precision of each kept word
    rest: float = 0.0  # part of toxic rows among those without a kept word

    def __post_init__(self) -> None:
        self.costs = self.cost.reshape(-1, _SYMBOLS).tolist()
        self.decode = lru_cache(100_000)(self._decode)
        self.spelled = lru_cache(100_000)(lambda word: self.restored(word)[1])
        self.hashes = np.sort(np.array([_hash(w) for w in self.words], np.int64))
        by_hash = {_hash(w): p for w, p in self.words.items()}
        self.precision = np.array([by_hash[h] for h in self.hashes.tolist()])
        self.squeezed = {_squeezed(w): _hash(w) for w in self.words}
        self.lengths = sorted({len(k) for k in self.squeezed if len(k) > 3})

    def _decode(self, word: str) -> str:
        """The Viterbi path of a word's lattice."""
        # A state is the last two symbols; the path is kept as a linked list.
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for i, c in enumerate(word):
            run = i > 0 and word[i - 1] == c
            arcs: list[tuple[str, float]] = []
            if c.isalpha():
                arcs.append((c, 0.0))
                if run:
                    arcs.append(("", _AGAIN))
            else:
                letters = LEET.get(c, "")
                arcs += [(x, _HIDDEN if len(letters) > 2 else _SIGN) for x in letters]
                if c in SEPARATORS or run:
                    arcs.append(("", _DROP))
                if not arcs or c.isdigit():
                    arcs.append((c, _KEEP))
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for (a, b, last), (spent, path) in states.items():
                row = self.costs[a * _SYMBOLS + b]
                for x, extra in arcs:
                    if not x:
                        if run and c.isalpha() and last != c:
                            continue  # only what repeats the letter before is a repetition
                        key, total, link = (a, b, last), spent + extra, path
                    else:
                        s = ord(x) - 96 if "a" <= x <= "z" else 27
                        key, total, link = (b, s, x), spent + extra + row[s], (x, path)
                    if key not in after or total < after[key][0]:
                        after[key] = (total, link)
            states = after
        best, chosen = float("inf"), None
        for (a, b, _), (spent, path) in states.items():
            total = spent + self.costs[a * _SYMBOLS + b][0]
            if total < best:
                best, chosen = total, path
        out = []
        while chosen is not None:
            out.append(chosen[0])
            chosen = chosen[1]
        return "".join(reversed(out))

    def restored(self, word: str) -> tuple[str, list[int]]:
        """The Viterbi path of an obfuscated word, and the hashes of the kept words that it is or spells out; doubled letters count once."""
        path = self.decode(word)
        plain = _squeezed(path)
        return path, self._spelled(plain)

    def _spelled(self, plain: str) -> list[int]:
        parts = {plain, *(plain[at : at + n] for n in self.lengths for at in range(len(plain) - n + 1))}
        return [self.squeezed[k] for k in parts if k in self.squeezed]

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Noisy or over the distinct kept words of each text."""
        out = np.full(len(texts), self.rest)
        if not len(self.hashes):
            return out
        for w in _word_runs(texts):
            h = textops.hashes(w).view(np.int64)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            rows = np.searchsorted(w.bounds, hit, "right") - 1
            found: dict[int, set[int]] = {}
            for row, k in zip(rows.tolist(), at[hit].tolist(), strict=True):
                found.setdefault(row, set()).add(k)
            for row, word in self._obfuscated(w):
                for h in self.spelled(word):
                    found.setdefault(row, set()).add(int(np.searchsorted(self.hashes, h)))
            for row, kept in found.items():
                out[w.first + row] = 1 - (1 - self.rest) * float(np.prod(1 - self.precision[sorted(kept)]))
        return out

    def _obfuscated(self, w: textops.Words) -> Iterator[tuple[int, str]]:
        """(row, word) of what may hide a word: words with signs, invisible separators or doubled letters, and runs of three or more pieces of one
        or two characters, joined."""
        if not len(w.starts):
            return
        data, size = w.data, len(w.data)
        sign = np.concatenate([[0], np.cumsum(_OTHER_ASCII[data])])
        letter = np.concatenate([[0], np.cumsum(~_OTHER_ASCII[data])])
        twice = np.zeros(size, bool)
        twice[1:] = (data[1:] == data[:-1]) & (data[1:] > 57) & (data[1:] < 128)
        twice[3:] |= (data[3:] == data[1:-2]) & (data[2:-1] == data[:-3]) & (data[3:] >= 128) & (data[2:-1] >= 0xC0)  # letters of two bytes
        unseen = np.zeros(size, bool)
        for c in _UNSEEN:
            if size >= len(c):
                unseen[: size - len(c) + 1] |= np.logical_and.reduce([data[k : size - len(c) + 1 + k] == x for k, x in enumerate(c.tolist())])
        mark = np.concatenate([[0], np.cumsum(twice | unseen)])
        length = w.ends - w.starts
        signed = (length > 2) & (letter[w.ends] > letter[w.starts]) & (sign[w.ends] > sign[w.starts])
        odd = (length > 2) & (signed | (mark[w.ends] > mark[w.starts]))
        row_of = np.searchsorted(w.bounds, np.arange(len(w.starts)), "right") - 1
        text = lambda k: data[w.starts[k] : w.ends[k]].tobytes().decode("utf-8", "replace")
        for k in np.flatnonzero(odd).tolist():
            yield int(row_of[k]), text(k)
        single = (length == 1) & (data[w.starts] > 32)
        for a, b in self._runs(single, row_of):
            if b - a >= 3:
                yield int(row_of[a]), "".join(text(k) for k in range(a, b))
        # Pieces of two letters are common words too, so what they spell has to begin and end with pieces.
        longest = max(map(len, self.words), default=0)
        for a, b in self._runs((length <= 2) & (data[w.starts] > 32), row_of):
            if b - a < 3 or single[a:b].all():
                continue
            pieces = [text(k) for k in range(a, b)]
            for x in range(len(pieces) - 2):
                joined = "".join(pieces[x : x + 2])
                for piece in pieces[x + 2 :]:
                    joined += piece
                    if len(joined) > 2 * longest:
                        break
                    if _squeezed(joined if joined.isalpha() else self.decode(joined)) in self.squeezed:
                        yield int(row_of[a]), joined

    @staticmethod
    def _runs(mask: np.ndarray, row_of: np.ndarray) -> Iterator[tuple[int, int]]:
        """(begin, end) of the runs of marked words within a row."""
        at = np.flatnonzero(mask)
        if len(at):
            cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(row_of[at]) != 0)) + 1
            yield from zip(at[np.concatenate([[0], cuts])].tolist(), (at[np.concatenate([cuts - 1, [len(at) - 1]])] + 1).tolist(), strict=True)


def character_costs(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Minus the logarithms of the trigram model of all texts, interpolated with bigrams; the table is of a fixed size."""
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(_SYMBOLS**3)
    n[counted["code"].to_numpy()] = counted["n"].to_numpy()
    three = n.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    # Trigrams are centred on a symbol of a word, so the first of a word is seen as (edge, edge, it) through (edge, it, .).
    first = three[0].sum(1)
    two = three.sum(2)  # (a, b)
    bigram = (two + 0.1) / (two.sum(1, keepdims=True) + 0.1 * _SYMBOLS)  # b after a
    out = (three + 2 * bigram[None]) / (three.sum(2, keepdims=True) + 2)
    start = first + 0.1
    out[0, 0] = start / start.sum()
    return -np.log(out).reshape(-1)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n1, n0): in how many toxic and other rows of the partition each word is."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([x for x, _, _ in held]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([x for _, x, _ in held]), len(h)), np.bincount(at, np.concatenate([x for _, _, x in held]), len(h))

    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for w in _word_runs(batch.column("text")):
            h = textops.hashes(w).view(np.int64)
            row = np.repeat(np.arange(w.last - w.first), np.diff(w.bounds))
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, toxic = h[new], label[w.first + row[new]]
            value, at = np.unique(h, return_inverse=True)
            held.append((value, np.bincount(at, toxic == 1, len(value)), np.bincount(at, toxic == 0, len(value))))
            if sum(len(x) for x, _, _ in held) > 1 << 20:
                held[:] = [merged()]
    if held:
        h, n1, n0 = merged()
        for at in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000].astype(np.int64)) for x in (h, n1, n0)], ["h", "n1", "n0"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, w, c): the words of texts, each with the hashes of its neighbours, once for each run of texts."""
    for batch in batches:
        for w in _word_runs(batch.column("text")):
            h = textops.hashes(w).view(np.int64)
            before, after = np.concatenate([[0], h[:-1]]), np.concatenate([h[1:], [0]])
            edges = w.bounds[:-1][np.diff(w.bounds) > 0], w.bounds[1:][np.diff(w.bounds) > 0] - 1
            before[edges[0]] = after[edges[1]] = 0  # no neighbour in another text
            around = before ^ (after << 1)
            order = np.lexsort((around, h))
            new = np.ones(len(h), bool)
            new[1:] = (np.diff(h[order]) != 0) | (np.diff(around[order]) != 0)
            kept = order[new]
            words = [w.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(w.starts[kept].tolist(), w.ends[kept].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h[kept]), pa.array(words, pa.string()), pa.array(around[kept])], ["h", "w", "c"])


def _without(hashes: np.ndarray):
    """(missed): how many texts of a batch have none of these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = np.zeros(batch.num_rows, bool)
            for w in _word_runs(batch.column("text")):
                hit = np.flatnonzero(np.isin(textops.hashes(w).view(np.int64), hashes))
                has[w.first + np.searchsorted(w.bounds, hit, "right") - 1] = True
            yield pa.RecordBatch.from_arrays([pa.array([int((~has).sum())], pa.int64())], ["missed"])

    return run


def learn(docs: DataFrame, labels: DataFrame, corpus: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model: labels of ``docs``, characters of ``corpus``. Without labels every score is 0.

    A row labelled more than once is toxic if any label says so; null labels count as none.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = cut(known)
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).cast("string").alias("text")).join(known, "_id")
    costs = character_costs(corpus, text)
    counts = rows.select("label", "text").mapInArrow(_presence, "h long, n1 long, n0 long").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    good = counts.where((F.col("n1") >= LEAST_ROWS) & (F.col("n1") >= LEAST_PRECISION * (F.col("n1") + F.col("n0"))))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not toxic:
        return Model(costs, {}, 0.0)
    marked = rows.where("label = 1").select("text")
    contexts = marked.mapInArrow(_contexts, "h long, w string, c long").join(good, "h").groupBy("h", "c").agg(F.min("w").alias("w"), F.first("n1").alias("n1"), F.first("n0").alias("n0"))
    varied = contexts.groupBy("h").agg(F.min("w").alias("w"), F.first("n1").alias("n1"), F.first("n0").alias("n0"), F.count("*").alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS)
    kept = {r["w"]: (r["n1"] + 0.5) / (r["n1"] + r["n0"] + 1) for r in varied.orderBy(F.desc("n1"), "w").collect()}
    if not kept:
        return Model(costs, {}, toxic / (toxic + other))
    missed = marked.mapInArrow(_without(np.sort(np.array([_hash(x) for x in kept], np.int64))), "missed long").agg(F.sum("missed")).first()[0]
    return Model(costs, kept, missed / max(1, missed + other))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Each row with score (0 to 1) and predicted (1 from TOXIC on); columns of these names are replaced.

    Null and empty texts have the score of texts without a marked word.
    """
    docs = docs.drop("score", "predicted")
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    cost, words, rest = model.cost, model.words, model.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(cost, words, rest)
        for batch in batches:
            s = own.scores(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= TOXIC).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
