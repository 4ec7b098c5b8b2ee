"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask looks at some of the tokens in a window and ignores the others, so a seed still hits where an ignored token was
substituted. The hashes under each mask of all benchmark items are broadcast in blocks of bounded size and joined to
those of all windows of all documents. A hit puts document and item on a diagonal; the tokens of the document along
the whole item are then compared with the item's, and a stretch of ``window`` tokens of which the part
``similarity`` or more are equal confirms it.

Tokens are the runs of letters and digits of the lower-cased text.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut

#: Offsets of the tokens that a mask looks at; the others of its span are ignored.
MASKS = ((0, 1, 2, 4, 7), (0, 2, 3, 5, 6), (0, 1, 4, 5, 8))
#: An item of fewer tokens than the widest mask spans is looked for as a whole; with fewer than this it isn't.
LEAST = 5
#: A confirmed stretch has so many tokens (or the whole item, if that has fewer), of which this part are equal.
WINDOW = 13
SIMILARITY = 0.8
#: Seeds in one broadcast, about 60 bytes each.
BLOCK_SEEDS = 400_000

_SPAN = max(m[-1] for m in MASKS) + 1


def tokens(text: Column) -> Column:
    """Tokens of a text; the first and the last can be empty."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _from_first(raw: Column) -> Column:
    """Without an empty first token, so that places count tokens."""
    return F.when(F.get(raw, F.lit(0)) == "", F.slice(raw, F.lit(2), F.size(raw))).otherwise(raw)


def _seed(toks: Column, at: Column, mask: tuple[int, ...], kind: int) -> Column:
    return F.xxhash64(F.lit(kind), *[F.get(toks, at + o) for o in mask])


def _masks(lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(kind, mask): the spaced ones, and a gapless one for each length of shorter items."""
    return [*enumerate(MASKS), *((100 + n, tuple(range(n))) for n in lengths)]


def items_of(benchmark: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, toks) of the distinct token sequences of a benchmark with LEAST tokens or more; the smallest id stands for equal ones."""
    toks = F.filter(tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: t != "")
    rows = benchmark.select(F.col(id_column).alias("item_id"), toks.alias("toks")).where(F.size("toks") >= LEAST)
    return rows.groupBy("toks").agg(F.min("item_id").alias("item_id")).select("item_id", "toks")


def seeds_of(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """(key, item_id, at) of every mask at every position of every item, and the lengths of the items shorter than a mask."""
    lengths = sorted(r[0] for r in items.where(F.size("toks") < _SPAN).select(F.size("toks")).distinct().collect())  # at most _SPAN - LEAST
    placed = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("toks") - LEAST)))
    n = F.size("toks")
    keys = [F.when((n >= _SPAN) & (F.col("at") + m[-1] < n), _seed(F.col("toks"), F.col("at"), m, k)) for k, m in _masks([])]
    keys += [F.when((n == length) & (F.col("at") == 0), _seed(F.col("toks"), F.col("at"), tuple(range(length)), 100 + length)) for length in lengths]
    return placed.select("item_id", "at", n.alias("item_n"), F.explode(F.array(*keys)).alias("key")).where("key is not null"), lengths


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, length, equal): the best confirmed stretch of each document and item.

    Starts count tokens. The best has the largest part of equal tokens, then the smallest starts. Null and empty texts have no
    hits; rows with the same id are searched each and reported together; of items with the same tokens the
    smallest id is reported. Empty tables give an empty result.
    """
    items = cut(items_of(benchmark))
    seeds, lengths = seeds_of(items)
    seeds = cut(seeds)
    blocks = max(1, ceil(seeds.count() / BLOCK_SEEDS))
    rows = docs.select(F.col(id_column).alias("doc_id"), tokens(F.col(text)).alias("raw")).select("doc_id", _from_first(F.col("raw")).alias("toks")).withColumn("n", F.size("toks"))
    # Not a filter on n: that would split each text twice.
    placed = rows.withColumn("at", F.explode(F.when(F.col("n") >= LEAST, F.sequence(F.lit(0), F.col("n") - LEAST))))
    keys = [F.when(F.col("at") + m[-1] < F.col("n"), _seed(F.col("toks"), F.col("at"), m, k)) for k, m in _masks(lengths)]
    windows = placed.select("doc_id", "toks", "at", F.explode(F.array(*keys)).alias("key"))
    found = None
    for block in range(blocks):
        part = seeds.where(F.pmod(F.hash("item_id"), F.lit(blocks)) == block) if blocks > 1 else seeds
        part = part.select("key", "item_id", F.col("at").alias("item_at"), "item_n")
        diagonal = F.col("at") - F.col("item_at")
        hits = windows.join(F.broadcast(part), "key").select("doc_id", "item_id", diagonal.alias("diagonal"), F.expr("slice(toks, greatest(at - item_at, 0) + 1, item_n + least(at - item_at, 0))").alias("own"))
        found = hits if found is None else found.union(hits)
    distinct = found.groupBy("doc_id", "item_id", "diagonal", "own").agg(F.count("*").alias("hits"))
    pairs = distinct.join(items, "item_id")
    flags = F.zip_with("own", F.expr("slice(toks, greatest(-diagonal, 0) + 1, size(own))"), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    flagged = pairs.withColumn("flags", flags).withColumn("width", F.least(F.lit(window), F.size("toks"))).where(F.size("flags") >= F.col("width"))
    sums = F.expr("transform(sequence(0, size(flags) - width), i -> named_struct('equal', aggregate(slice(flags, i + 1, width), 0, (a, x) -> a + x), 'i', -i))")
    scored = flagged.withColumn("best", F.array_max(sums)).where(F.col("best.equal") >= F.ceil(F.col("width") * F.lit(similarity)))
    at = -F.col("best.i")
    rows = scored.select(
        "doc_id", "item_id", (F.greatest(F.col("diagonal"), F.lit(0)) + at).alias("doc_start"), (F.greatest(-F.col("diagonal"), F.lit(0)) + at).alias("item_start"), F.col("width").alias("length"), F.col("best.equal").alias("equal")
    )
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("equal") / F.col("length")).alias("part"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), "length", "equal")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), F.col("b.length").alias("length"), F.col("b.equal").alias("equal"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a confirmed overlap, unchanged; rows with a null id are one document."""
    id_column = options.get("id_column", "doc_id")
    hit = overlaps(docs, benchmark, **options).select("doc_id").distinct().alias("hit")
    return docs.alias("own").join(hit, F.col(f"own.{id_column}").eqNullSafe(F.col("hit.doc_id")), "left_anti")
