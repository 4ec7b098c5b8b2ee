"""Language ID: a bit-sliced Bloom filter from n-grams to a bit mask of languages.

Learning counts the n-grams of each language over all learning rows. A language keeps its most frequent n-grams that
are not much rarer in it than in any other language. The filter has one row of bits, one bit a language, for each of
its places; an n-gram sets its language's bit at ``HASHES`` places. Looking an n-gram up ANDs the rows at its places,
which gives all languages that contain it at once. A text's n-grams are counted by language; of n n-grams, a
language whose bits fill the share f of the places gets n * f ** HASHES by chance, which is corrected for; the highest
corrected count decides. The filter has a fixed size, so it is all that is broadcast.

N-grams are of bytes of lower-cased UTF-8, with everything but letters made into single spaces.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut
from strandline.llm.textops import mix, runs

#: Bytes in an n-gram; also the lengths that are looked up.
GRAMS = (3, 5)
HASHES = 3
#: log2 of the filter's places.
PLACES = 20
#: A language keeps an n-gram that makes up this part of its n-grams of that length or more, so no more than 1 / LEAST_SHARE.
LEAST_SHARE = 1e-5
#: A language keeps an n-gram if its share of the language's n-grams is at least this part of the highest share in any.
SHARE = 0.3
#: Undetermined: no letter.
UND = "und"

_LETTER = np.zeros(256, np.uint8) + 32
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_CLOSED = 1 << 20  # counted n-grams that a task holds before it adds them up


def _normal(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``runs``, of normalised texts: each begins and ends with a space, no two spaces in a row."""
    for first, last, data, offsets in runs(pc.utf8_lower(texts)):
        size = np.diff(offsets)
        wide = np.full(len(data) + 2 * len(size), 32, np.uint8)
        at = np.concatenate([[0], np.cumsum(size + 2)])
        wide[np.arange(len(data)) + np.repeat(2 * np.arange(len(size)) + 1, size)] = _LETTER[data]
        keep = np.ones(len(wide), bool)
        keep[1:] = (wide[1:] != 32) | (wide[:-1] != 32)
        keep[at[:-1]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        yield first, last, wide[keep], kept[at]


def _grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text as integers, and the text each is of."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        value = (value << np.uint64(8)) | data[k : k + len(value)]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: len(value)] == row[n - 1 :]
    return value[inside] | np.uint64(n << 56), row[: len(value)][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition of (lang, text)."""
    held: dict[str, list] = {}

    def add(lang: str, grams: np.ndarray) -> None:
        value, n = np.unique(grams, return_counts=True)
        have = held.setdefault(lang, [])
        have.append((value, n))
        if sum(len(v) for v, _ in have) > _CLOSED:
            have[:] = [merge(have)]

    def merge(have: list) -> tuple[np.ndarray, np.ndarray]:
        value, at = np.unique(np.concatenate([v for v, _ in have]), return_inverse=True)
        return value, np.bincount(at, np.concatenate([n for _, n in have]), len(value)).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, last, data, offsets in _normal(batch.column("text")):
            own = langs[first:last]
            names, code = np.unique(own.astype(str), return_inverse=True)
            for n in GRAMS:
                value, row = _grams(data, offsets, n)
                for k, name in enumerate(names):
                    add(name, value[code[row] == k])
    for lang, have in held.items():
        value, n = merge(have)
        for at in range(0, len(value), 100_000):
            part = value[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int64)), pa.array(n[at : at + 100_000])], ["lang", "gram", "n"])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (places, words of 64 languages)
    chance: np.ndarray  # of a false positive, by language

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram, the words of its language mask."""
        found, h = None, grams
        for _ in range(HASHES):
            h = mix(h + np.uint64(0x9E3779B97F4A7C15))
            rows = self.table[(h >> np.uint64(64 - PLACES)).astype(np.int64)]
            found = rows if found is None else found & rows
        return found

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By text: n-grams, and corrected counts by language."""
        texts = len(offsets) - 1
        total, hits = np.zeros(texts), np.zeros((texts, len(self.langs)))
        for n in GRAMS:
            grams, row = _grams(data, offsets, n)
            total += np.bincount(row, minlength=texts)
            masks = self.lookup(grams)
            for k in range(len(self.langs)):
                bit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[:, k] += np.bincount(row, bit, texts)
        expected = total[:, None] * self.chance
        return total, np.maximum(hits - expected, 0) / (1 - self.chance)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from all rows whose text and language are known; None if there are none."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counted = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    size = F.expr("shiftright(gram, 56)")
    totals = counted.groupBy("lang", size.alias("size")).agg(F.sum("n").alias("total"))
    shares = counted.withColumn("size", size).join(F.broadcast(totals), ["lang", "size"]).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= LEAST_SHARE)
    best = shares.withColumn("best", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= SHARE * F.col("best"))
    own = best.select("lang", "gram")
    langs = sorted(r[0] for r in totals.select("lang").distinct().collect())
    if not langs:
        return None
    table = np.zeros((1 << PLACES, (len(langs) + 63) // 64), np.uint64)
    kept = own.toPandas()  # at most 1 / LEAST_SHARE for each language and length
    for k, name in enumerate(langs):
        h = kept.loc[kept["lang"] == name, "gram"].to_numpy().astype(np.uint64)
        for _ in range(HASHES):
            h = mix(h + np.uint64(0x9E3779B97F4A7C15))
            table[(h >> np.uint64(64 - PLACES)).astype(np.int64), k // 64] |= np.uint64(1) << np.uint64(k % 64)
    fill = np.array([((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
    return Model(langs, table, fill**HASHES)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Each row with lang_pred, score and lang_cover.

    lang_pred is a language of the model, or ``und`` with score 0 if the text is null, empty or has no letter, or if
    there is no model. score is the best language's part of the corrected counts of the best two; equal counts
    (or none at all) fall to the first language by name. lang_cover is the part of the text's n-grams that the
    language has. Columns of docs with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "lang_cover")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("lang_cover")).schema
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    del model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = pickle.loads(held.value)
        for batch in batches:
            texts = batch.column(text)
            n = len(texts)
            pred, score, cover = np.full(n, UND, object), np.zeros(n), np.zeros(n)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is not None and n:
                names = np.array(model.langs, object)
                for first, last, data, offsets in _normal(texts):
                    total, hits = model.counts(data, offsets)
                    best = hits.argmax(1)
                    top = hits[np.arange(len(best)), best]
                    second = np.partition(hits, -2, 1)[:, -2] if hits.shape[1] > 1 else np.zeros(len(best))
                    ok = lettered[first:last]
                    pred[first:last][ok] = names[best][ok]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score[first:last] = np.where(ok, np.where(top > 0, top / (top + second), 1 / len(names)), 0)
                        cover[first:last] = np.where(ok & (total > 0), np.minimum(top / np.maximum(total, 1), 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(cover)], [*batch.schema.names, "lang_pred", "score", "lang_cover"])

    return docs.mapInArrow(run, schema)
