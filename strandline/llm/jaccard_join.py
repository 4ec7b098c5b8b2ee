"""Exact Jaccard join of n-gram sets by an inverted index with skipping, and the components of its links.

A document's set holds the hashes of its distinct word n-grams, in order of hash. Equal sets are one class. An n-gram that
no set of a size in reach shares can't count for any link, so a set with too many of them is alone, and of the others only
the rest is ordered: two sets that reach the threshold share an n-gram among the first n' - ceil(t * n) + 1 of
each, where n' is what remains of n. Which n-grams are shared is known exactly for all hashes up to a bound that
depends on the size of the sets alone; sets found alone leave, and what only they shared is unshared then, until few more leave.

* Index-level skipping: the entries of a list are in blocks by set size (sets that differ by more than the threshold
  allows lie more than one block apart), and an entry holds its position, which bounds how much two sets can share;
  blocks and pairs whose bound is too low are passed over.
* Answer-level skipping: in each block every set is first compared with two pivots, members with the largest part
  of their prefix in common with others. Sets found linked form components, and the answers of one member serve all of
  them: what is in one component already is not compared again, and a list with one component is left out. If the
  differences of two sets to a pivot are disjoint, the two can only be linked if both are linked to the pivot, so few
  pairs remain. A pair is made only where it can share its first entry (not where an entry shortly before is shared too).
  It gets a bound from parity bit maps (two maps differ in no more bits than the sets differ in members) and, if that
  doesn't settle it, a comparison of the whole sets.

No pair that could be linked is passed over unless both sets are in the same component already. Sets are compared as 64-bit
hashes of their n-grams, which aren't verified against the words: of m distinct n-grams, m * m / 2 ** 65 pairs collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import textops
from strandline.llm.common import components, cut, removed, stored

N = 3
#: Threshold in hundredths.
HUNDREDTHS = 90
#: A block spans a little more than the sizes that can be linked, so that those lie one block apart at most.
BLOCK_STEP = 1.000001
#: Words of 64 bits in the parity map that index entries carry. A set's own map has a power of two of them, for 4 bits a member or
#: more; the middle one an eighth of that or more, which tells most pairs apart and is carried by entries of large sets.
FOLDED_WORDS = 4
MIDDLE_PART = 8
#: Sizes of a list are counted in so many slots of 4 bits, by block; blocks so many apart share one, and lists of more than SLOT_MOST are left whole.
SLOTS = 15
SLOT_MOST = 15
#: N-grams are examined for being shared up to this part of the hashes, times 1 - t, and so many more of each set.
EXAMINED = 1.4
EXAMINED_MORE = 8
#: They are examined in so many slices of their hashes, one slice's shuffle on disk at a time.
SLICES = 6
#: Sets found alone leave until a round drops less than this part.
LEAST_DROPPED = 0.1
#: Documents to be compared are found by a broadcast of their ids up to this number (16 MB), else by a shuffle.
BROADCAST_IDS = 1_000_000


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text with words, in order."""
    for w in textops.words(batch.column("text")):
        h, at = textops.shingles(textops.hashes(w), w.bounds, n)
        for k in range(w.last - w.first):
            if at[k] < at[k + 1]:
                yield w.first + k, np.unique(h[at[k] : at[k + 1]])


def _key(s: np.ndarray) -> int:
    """Identifies a set: a hash of its size, sum and exclusive or."""
    x = textops.mix(np.array([s.sum(), np.bitwise_xor.reduce(textops.mix(s + np.uint64(77))), len(s)], np.uint64))
    y = textops.mix((x * np.array([3, 5, 7], np.uint64)).sum(keepdims=True))
    return int(y.view(np.int64)[0])


def _prefix(n: int, hundredths: int) -> int:
    return n - -(-n * hundredths // 100) + 1


def _bound(n: int, hundredths: int) -> np.uint64:
    """N-grams with hashes below this are examined in sets of this size; no larger for larger sets."""
    part = EXAMINED * (100 - hundredths) / 100 + EXAMINED_MORE / n
    return np.uint64(min(part, 1.0) * (2**64 - 2**12))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _keys(n: int):
    """(id, n, key) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, s in _sets(batch, n):
                size[row], key[row] = len(s), _key(s)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(key)], ["id", "n", "key"])

    return run


def _summaries(n: int, hundredths: int):
    """What is needed of each text's set to find candidates; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            size, key, examined, none = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int32), np.zeros(0, np.int64)
            head, maps, middle, small = [none] * rows, [none] * rows, [none] * rows, np.zeros((rows, FOLDED_WORDS), np.int64)
            for row, s in _sets(batch, n):
                size[row], key[row] = len(s), _key(s)
                # What the largest set in reach has examined too is known to be shared or not.
                examined[row] = np.searchsorted(s, _bound(len(s) * 100 // hundredths, hundredths))
                head[row] = s[: max(_prefix(len(s), hundredths), int(np.searchsorted(s, _bound(len(s), hundredths))))].view(np.int64)
                words = max(FOLDED_WORDS, 1 << (len(s) // 16).bit_length())
                place = (textops.mix(s + np.uint64(991)) & np.uint64(64 * words - 1)).astype(np.int64)
                maps[row] = np.packbits(np.bincount(place, minlength=64 * words) & 1 == 1).view(np.int64)
                middle[row] = np.bitwise_xor.reduce(maps[row].reshape(-1, max(FOLDED_WORDS, words // MIDDLE_PART)), 0)
                small[row] = np.bitwise_xor.reduce(maps[row].reshape(-1, FOLDED_WORDS), 0)
            made = pa.RecordBatch.from_arrays([pa.array(size), pa.array(key), pa.array(examined), _lists(head), _lists(maps), _lists(middle), _lists(list(small))], ["n", "key", "examined", "head", "map", "middle", "small"])
            yield made.filter(pa.array(size > 0))

    return run


def _whole(n: int):
    """(key, members) of the sets; with a column ``key``, only where a text's set has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("key").to_pylist() if "key" in batch.schema.names else None
            keys, members = [], []
            for row, s in _sets(batch, n):
                key = _key(s)
                if wanted is None or key == wanted[row]:
                    keys.append(key)
                    members.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(members, pa.binary())], ["key", "members"])

    return run


def _compare(hundredths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a_members"), batch.column("b_members"), strict=True):
                x, y = (np.frombuffer(m.as_buffer(), np.uint64) for m in (a, b))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= hundredths * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _near(apart, hundredths: int):
    """Whether sets of these sizes whose parity maps differ in so many bits can reach the threshold."""
    least = F.ceil(hundredths * (F.col("a_n") + F.col("b_n")) / F.lit(100 + hundredths))
    sizes = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * hundredths
    return sizes & (apart <= F.col("a_n") + F.col("b_n") - 2 * least)


def _differing(which: str = "map"):
    """In how many bits the whole maps of a pair differ; the longer one is folded to the length of the other, as sizes that can be linked are less than a factor of two apart."""
    half = lambda m: F.shiftright(F.size(m), 1)
    halved = lambda m: F.zip_with(F.slice(m, F.lit(1), half(m)), F.slice(m, half(m) + 1, half(m)), lambda x, y: x.bitwiseXOR(y))
    a, b = F.col(f"a_{which}"), F.col(f"b_{which}")
    left, right = F.when(F.size(a) > F.size(b), halved(a)).otherwise(a), F.when(F.size(b) > F.size(a), halved(b)).otherwise(b)
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _has_company(listed: str, slots: str):
    """Whether a list may have another entry in this entry's block or one beside it. Never false if it has."""
    around = [F.expr(f"shiftright({slots}, cast(4 * pmod(block + {d}, {SLOTS}) as int)) & 15") for d in (-1, 0, 1)]
    return (F.col(listed) > SLOT_MOST) | (sum(around, F.lit(0)) > 1)


def _sharing(hundredths: int):
    """Whether sets that share the entry at these positions can share enough members."""
    least = F.ceil(hundredths * (F.col("a_n") + F.col("b_n")) / F.lit(100 + hundredths))
    return F.least("a_pos", "b_pos") + 1 + F.least(F.col("a_left") - F.col("a_pos") - 1, F.col("b_left") - F.col("b_pos") - 1) >= least


def _first(hundredths: int):
    """Whether the entries at these positions can be the first that two linked sets share: all members before them then differ."""
    least = F.ceil(hundredths * (F.col("a_n") + F.col("b_n")) / F.lit(100 + hundredths))
    ahead = (F.col("a_pos") + F.col("b_pos") <= F.col("a_left") + F.col("b_left") - 2 * least) & (F.least(F.col("a_left") - F.col("a_pos"), F.col("b_left") - F.col("b_pos")) >= least)
    again = [F.coalesce(F.col(f"a_{x}") == F.col(f"b_{y}"), F.lit(False)) for x in ("before", "earlier") for y in ("before", "earlier")]
    return ahead & ~(again[0] | again[1] | again[2] | again[3])


def _shared_heads(owners: DataFrame, slots: Column, slices: int) -> tuple[DataFrame, list[str]]:
    """(key, head) of the sets that share any, where head has the (pos, token) that another set of a size in reach has too; and the paths of files."""
    parts, paths = [], []
    for k in range(slices):
        own = F.filter("head", lambda x: F.pmod(x["token"], F.lit(slices)) == k) if slices > 1 else F.col("head")
        entries = owners.select("key", "block", F.explode(own).alias("x")).select("x.token", "key", "block", "x.pos")
        listed = cut(entries.groupBy("token").agg(F.count("*").alias("listed"), F.try_sum(slots).alias("slots")).where("listed > 1"))  # so that a common token's entries can be split
        part, path = stored(entries.join(listed, "token").where(_has_company("listed", "slots")).select("key", "pos", "token"), "heads")
        parts.append(part)
        paths.append(path)
    return reduce(DataFrame.union, parts).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("head")), paths


def _not_alone(owners: DataFrame, hundredths: int) -> DataFrame:
    """(key, n, block, left, entries): the sets that may be linked, with the size that is left of them and the (pos, token) of their prefix, positions among what is left."""
    spark = owners.sparkSession
    slots = F.expr(f"shiftleft(1L, cast(4 * (block % {SLOTS}) as int))")
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(BLOCK_STEP * log(100 / hundredths))).cast("int")
    heads = owners.select("key", "n", "examined", block.alias("block"), F.transform("head", lambda x, i: F.struct(i.alias("pos"), x.alias("token"))).alias("head"))
    slices, before, held = SLICES, None, None
    while True:
        shared, paths = _shared_heads(heads, slots, slices)
        unshared = F.col("examined") - F.size(F.filter("head", lambda x: x["pos"] < F.col("examined")))
        prefix = F.col("n") - F.ceil(F.col("n") * hundredths / F.lit(100)) + 1
        heads = heads.drop("head").join(shared, "key").where(unshared < prefix)
        heads, path = stored(heads, "heads")
        for done in (*paths, *([held] if held else [])):
            removed(spark, done)
        held = path
        now = heads.count()
        if before is not None and now >= (1 - LEAST_DROPPED) * before:
            break
        before, slices = now, 1
    # All that is examined and not in the head any more is unshared and lies before what isn't examined.
    at = lambda x, i: F.when(x["pos"] < F.col("examined"), i).otherwise(x["pos"] - unshared.cast("int"))
    entries = F.filter(F.transform("head", lambda x, i: F.struct(at(x, i).alias("pos"), x["token"].alias("token"))), lambda x: x["pos"] < prefix - unshared)
    kept = cut(heads.select("key", "n", "block", (F.col("n") - unshared).alias("left"), entries.alias("entries")))
    removed(spark, held)
    return kept


def _mapped(pairs: DataFrame, maps: DataFrame, hundredths: int, by: tuple[str, ...]) -> DataFrame:
    """The pairs (a, a_n, b, b_n) that are possible by these maps, one after the other."""
    pairs = pairs.where(_near(F.lit(0), hundredths))
    for which in by:
        left = maps.select(F.col("key").alias("a"), F.col(which).alias("a_map"))
        right = maps.select(F.col("key").alias("b"), F.col(which).alias("b_map"))
        pairs = cut(pairs.join(left, "a").join(right, "b").where(_near(_differing(), hundredths)).select("a", "a_n", "b", "b_n"))
    return pairs.select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, reps: DataFrame, n: int, hundredths: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by comparing their whole sets."""
    wanted = cut(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    ids = cut(reps.where("id is not null").join(wanted, "key", "left_semi"))
    known = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = rows.join(known, "id").mapInArrow(_whole(n), "key long, members binary")
    unnamed = rows.where("id is null").mapInArrow(_whole(n), "key long, members binary").join(wanted, "key", "left_semi")
    sets = sets.union(unnamed).dropDuplicates(["key"])  # not cut: its shuffle serves both joins
    left = sets.select(F.col("key").alias("a"), F.col("members").alias("a_members"))
    right = sets.select(F.col("key").alias("b"), F.col("members").alias("b_members"))
    return cut(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_compare(hundredths), "a long, b long"))


def jaccard_components(docs: DataFrame, n: int = N, hundredths: int = HUNDREDTHS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    A text's words are separated by ASCII white space, A-Z lower-cased; with fewer than n words, but one, all of them are
    its one n-gram. Null, empty and blank texts have an empty set and are linked with nothing: their component is their
    own id. Rows with the same id are rows of their own, also those with a null id. A component's id is its smallest id that isn't
    null, and null if it has none. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    base = cut(rows.mapInArrow(_keys(n), "id long, n long, key long"))
    classes = base.where("n > 0").groupBy("key").agg(F.min("id").alias("least"), F.max("n").alias("n"))
    reps = classes.select("key", F.col("least").alias("id"))
    # Equal sets have equal summaries; they are made again from the texts rather than kept for every row.
    summaries = rows.mapInArrow(_summaries(n, hundredths), "n long, key long, examined int, head array<long>, map array<long>, middle array<long>, small array<long>")
    owners, owners_path = stored(summaries.dropDuplicates(["key"]), "owners")
    kept = _not_alone(owners, hundredths)
    owners = cut(owners.drop("examined", "head").join(kept.select("key"), "key", "left_semi"))
    removed(docs.sparkSession, owners_path)
    maps = owners.select("key", "map", "middle")
    shared, shared_path = stored(kept.select("block", "key", "n", "left", F.explode("entries").alias("x")).select("x.token", "block", "key", "n", "left", "x.pos"), "shared")

    # Answers for each set from its block's two pivots: of those that share most, the first and the last by key.
    prefix = F.col("n") - F.ceil(F.col("n") * hundredths / F.lit(100)) + 1
    support = shared.groupBy("key").agg((F.count("*") / F.first(prefix)).alias("support"))
    supported = shared.join(support, "key")
    pivots = supported.groupBy("token", "block").agg(*[F.max(F.struct("support", by.alias("by"), "key", "n", "left", "pos")).alias(name) for name, by in (("top", F.col("key")), ("other", F.bitwise_not("key")))], F.count("*").alias("m")).where("m > 1")
    pivots = pivots.select("token", "block", F.explode(F.array_distinct(F.array(F.struct("top.key", "top.n", "top.left", "top.pos"), F.struct("other.key", "other.n", "other.left", "other.pos")))).alias("p"))
    pivots = pivots.select("token", "block", F.col("p.key").alias("b"), F.col("p.n").alias("b_n"), F.col("p.left").alias("b_left"), F.col("p.pos").alias("b_pos"))
    own = shared.select("token", "block", F.col("key").alias("a"), F.col("n").alias("a_n"), F.col("left").alias("a_left"), F.col("pos").alias("a_pos"))
    star = own.join(pivots, ["token", "block"]).where((F.col("a") != F.col("b")) & _sharing(hundredths)).select("a", "a_n", "b", "b_n").distinct()
    star = _mapped(star, maps, hundredths, ("middle", "map"))

    links = _verified(star, rows, reps, n, hundredths)
    found = components(links, "a", "b").select(F.col("node").alias("key"), "component")

    # What is not in one component yet.
    placed = shared.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    spread = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    in_set = Window.partitionBy("key").orderBy("pos")
    small_maps = owners.select("key", "small", F.when(F.size("middle") > FOLDED_WORDS, F.col("middle")).alias("middle"))
    open_entries = placed.join(spread, "token").join(small_maps, "key").withColumns({"before": F.lag("token", 1).over(in_set), "earlier": F.lag("token", 2).over(in_set)})
    open_entries, open_path = stored(open_entries, "open")
    # a is the smaller set: what it shares first lies within the part of it that may be missing from a set of its own size.
    named = lambda side: [F.col(c).alias(side if c == "key" else f"{side}_{c}") for c in ("key", "n", "left", "pos", "component", "before", "earlier", "small", "middle")]
    indexed = open_entries.where(F.col("pos") <= F.col("left") - F.ceil(2 * hundredths * F.col("n") / F.lit(100 + hundredths)))
    own = indexed.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1))).select("token", "block", *named("a"))
    other = open_entries.select("token", "block", *named("b"))
    once = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    apart = sum((F.bit_count(F.col("a_small")[k].bitwiseXOR(F.col("b_small")[k])) for k in range(FOLDED_WORDS)), F.lit(0))
    open_pair = (F.col("a_component") != F.col("b_component")) & once & _first(hundredths) & _near(apart, hundredths)
    open_pair &= F.coalesce(_near(_differing("middle"), hundredths), F.lit(True))  # null: of a small set, whose middle map is the one above
    rest = own.join(other, (own["token"] == other["token"]) & (own["block"] == other["block"]) & open_pair).select("a", "a_n", "b", "b_n").distinct()
    rest, rest_path = stored(rest, "pairs")  # as a file of known size: if it is small, Spark broadcasts it instead of dealing the maps
    possible = _mapped(rest, maps, hundredths, ("map",))
    for path in (shared_path, open_path, rest_path):
        removed(docs.sparkSession, path)
    more = _verified(possible, rows, reps, n, hundredths)
    all_found = components(links.union(more), "a", "b").select(F.col("node").alias("key"), "component")

    by_component = classes.join(all_found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least_id = by_component.groupBy("component").agg(F.min("least").alias("component_id"))
    named = by_component.join(least_id, "component").select("key", "component_id")
    linked = base.where("n > 0").select("id", "n", "key").join(named, "key").select("id", "n", "component_id")
    alone = base.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
