import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence, words


def sequences(seed, n, alphabet="ACGT"):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices(alphabet, k=rng.choice([0, 5, 19, 20, 32, 33, 90, 200])))) for i in range(n)]
    return [*rows, (n, "T" * 70), (n + 1, None)]


def brute(rows, k):
    return Counter((i, p, s[p : p + k]) for i, s in rows if s for p in range(len(s) - k + 1) if set(s[p : p + k]) <= set("ACGT"))


@pytest.mark.parametrize("k", [1, 2, 7, 20, 31, 32])
def test_packed_words_are_those_of_each_text(k, monkeypatch, spark):
    monkeypatch.setattr(words, "STEP", 13)
    rows = sequences(k, 30, "ACGT" * 9 + "N")
    expected = brute(rows, k)
    code = lambda w: int(np.uint64(int(w.translate(str.maketrans("ACGT", "0123")), 4)).view(np.int64))
    batch = next(iter(__import__("pyarrow").table({"id": [r[0] for r in rows], "bases": [r[1] for r in rows]}).to_batches()))
    chosen = [code(w) for _, _, w in list(expected)[::7]]
    for wanted in (None, chosen):
        asked = None if wanted is None else words.Wanted(np.array(wanted, np.int64).view(np.uint64))
        got = Counter(tuple(r.values()) for part in words._found(batch, k, asked) for r in part.to_pylist())
        assert got == Counter((i, p, code(w)) for i, p, w in expected if wanted is None or code(w) in set(wanted))


@pytest.mark.parametrize("most", [500_000, 0])
def test_unique_words_count_only_what_the_other_side_has(most, monkeypatch, spark):
    monkeypatch.setattr(sequence, "BROADCAST_WORDS", most)
    left = sequences(1, 40)
    left.append((50, "ACGT" * 20 + "TTTT"))
    right = [(0, left[3][1] or "A" * 40), (1, "GG" + (left[50 - 10][1] or "") + "C"), (2, "T" * 40), (3, left[-1][1][10:] + "A")]
    right += [(4 + i, (s or "")[:60]) for i, s in left[:20]]
    table = lambda rows: spark.createDataFrame(rows, "seq_id long, bases string")
    asked = []
    plain = words.words
    monkeypatch.setattr(words, "words", lambda df, k, wanted=None, **more: asked.append(wanted is not None) or plain(df, k, wanted, **more))
    got = {tuple(r) for r in sequence.unique_words(table(left), table(right), 32).collect()}
    assert (True in asked) == (most > 0)

    def once(rows):
        places = {}
        for i, p, w in brute(rows, 32):
            places.setdefault(w, []).append((i, p))
        return {w: at[0] for w, at in places.items() if len(at) == 1}

    a, b = once(left), once(right)
    assert got == {(w, *a[w], *b[w]) for w in a.keys() & b.keys()} and got


def test_words_keep_the_wanted_ones_only(spark):
    rows = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "TTTTT")], "seq_id long, bases string")
    wanted = spark.createDataFrame([("TACG",)], "kmer string").select(sequence.kmer_code(F.col("kmer")).alias("kmer"))
    assert [tuple(r)[:2] for r in words.words(rows, 4, wanted).collect()] == [(1, 3)]
    assert words.words(rows, 4, wanted.limit(0)).count() == 0


def test_matches_are_made_in_the_scan(spark, monkeypatch):
    from strandline.operators import seeds

    rng = random.Random(5)
    refs = [(i, "".join(rng.choices("ACGT", k=90)) + "N" * (i % 2)) for i in range(5)] + [(9, "A" * 60), (10, "")]
    turned = refs[2][1][10:70].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    queries = [(0, refs[0][1][5:50] + refs[1][1][20:60]), (1, turned + "A" * 14 + refs[0][1][30:45]), (2, "ACG")]
    table = lambda rows: spark.createDataFrame(rows, "seq_id long, bases string")
    few = lambda: sorted(map(tuple, seeds.mems(table(refs), table(queries), 12).collect()))
    got = few()
    assert "Exchange" not in seeds.mems(table(refs), table(queries), 12)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(words, "STEP", 17)
    monkeypatch.setattr(words, "HITS", 3)
    assert few() == got and len(got) > 40
    monkeypatch.setattr(seeds, "BROADCAST_KMERS", 0)
    assert few() == got


def test_chance_matches_are_no_groups_of_their_own(spark):
    from strandline.operators import chain

    rows = [(r, 5, 1, 10 * r, 20, "+") for r in range(30)] + [(50, 0, 1, 0, 40, "+"), (50, 45, 1, 45, 40, "+")]
    found = chain.chains(spark.createDataFrame(rows, "ref_id long, rb long, query_id long, qb long, len long, strand string"))
    assert "_size#" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["ref_id"], r["weight"]) for r in found.collect()] == [(50, 80)]


def test_md_of_plain_and_other_paths(spark):
    from strandline.sinks import formats

    path = "cigar array<struct<op:string,len:bigint>>"
    rows = spark.createDataFrame(
        [(1, 0, 6, 1, 0, 6, "+", [("=", 6)], 54, 0, 6, 6, True), (1, 6, 12, 1, 6, 13, "+", [("=", 2), ("X", 1), ("I", 2), ("D", 1), ("=", 2)], 9, 4, 4, 8, False)],
        f"ref_id long, rb long, re long, query_id long, qb long, qe long, strand string, {path}, score long, edits long, matches long, columns long, primary boolean",
    )
    bases = spark.createDataFrame([(1, "a", "ACGTACGTACGTTT"), (2, "b", "AAAA")], "seq_id long, name string, bases string")
    lines = formats.sam(rows, bases, bases).where("part = 1").orderBy("at")
    assert [r["line"].split("\t")[12] for r in lines.collect()] == ["MD:Z:6", "MD:Z:2A0^C2"]
