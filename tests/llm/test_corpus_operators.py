"""Line dedup, decontamination, passages, mixing, Jaccard join and the pipeline against brute force on small cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, compact_windows, decontam, jaccard_join, line_dedup, mixing

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(tuple(x) for x in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {x: root(x) for x in nodes}


def brute_lines(rows, least):
    docs = [(i, t.split("\n")) for i, t in sorted((i, t) for i, t in rows if t is not None)]
    solid = {i: [k for k, x in enumerate(ls) if x.strip(" ")] for i, ls in docs}
    gone = defaultdict(set)
    seen = set()
    for i, ls in docs:
        at = solid[i]
        for p in range(len(at)):
            for n in (1, 2, 4, 8, 16, 32):
                if p + n > len(at):
                    continue
                run = tuple(ls[k] for k in at[p : p + n])
                if run in seen and sum(map(len, run)) >= least:
                    gone[i] |= set(range(at[p], at[p + n - 1] + 1))
                seen.add(run)
    out = {}
    for i, ls in docs:
        kept = [x for k, x in enumerate(ls) if k not in gone[i]]
        out[i] = ("\n".join(kept) if any(x.strip(" ") for x in kept) or not gone[i] else "", len(gone[i]))
    return out


def test_line_dedup(spark):
    r = random.Random(4)
    lines = ["Von.", "In.", "A line that is long enough to count alone.", "Another rather long line of the corpus.", "", "  ", "short", *[f"line number {k} of many others" for k in range(6)]]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for k in range(40)] + [(50, None), (51, ""), (52, "\n\n"), (53, "x\n" * 300)]
    extra = frame(spark, rows).withColumn("lines_removed", F.lit("mine")).withColumn("t", F.lit(1))
    got = {x.doc_id: (x.text, x.lines_removed) for x in line_dedup.dedup_lines(extra).collect()}
    expected = brute_lines(rows, 20) | {50: (None, 0)}
    assert got == expected
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_deep_runs_of_short_lines(spark):
    # Stretches of one or two lines have too few characters: only deeper intervals tell these copies.
    own = [[f"{a}{k}" for k in range(9)] for a in "abc"]
    rows = [(1, "\n".join([*own[0], "x"])), (2, "\n".join(["y", *own[0]])), (3, "\n".join([*own[1], *own[2][:4]])), (4, "\n".join([*own[2][:4], "z", *own[1]]))]
    docs = frame(spark, rows)
    got = {x.doc_id: (x.text, x.lines_removed) for x in line_dedup.dedup_lines(docs, least_chars=10).collect()}
    assert got == brute_lines(rows, 10)
    assert got[2] == ("y", 9) and got[4][1] == 9
    assert line_dedup.copied_runs(docs, least_chars=10).count() > 0
    shallow = [level.where("not first and chars >= 10").count() for level in line_dedup.levels(docs, deep=10)]
    assert shallow[0] == shallow[1] == shallow[2] == 0 < shallow[3]


def test_clashing_columns(spark):
    text = "A line that is long enough to count alone."
    docs = frame(spark, [(1, text), (2, text)])
    for names in (("_h", "_d", "_runs", "gone", "row"), ("_part", "_rank", "_base", "_rate", "_s", "_z", "_p", "rate", "part", "size")):
        extra = docs.select("*", F.lit("src").alias("source"), *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
        out = line_dedup.dedup_lines(extra).collect() if "row" in names else mixing.systematic_mix(extra).collect()
        assert len(out) == 2
        for x in out:
            assert all(x[n] == f"{n}{x.doc_id}" for n in names if n != "size")


def test_overlap_places_and_null_ids(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    rows = [(1, f"({item}) and more"), (2, f"before it: {item}"), (None, item), (3, "... clean, all of it is clean here, nothing else")]
    got = {x.doc_id: (x.doc_start, x.item_start, x.length, x.equal) for x in decontam.overlaps(frame(spark, rows), benchmark).collect()}
    assert got == {1: (0, 0, 13, 13), 2: (2, 0, 13, 13), None: (0, 0, 13, 13)}
    left = decontam.clean(frame(spark, rows).withColumn("_hit", F.lit(1)), benchmark)
    assert [x.doc_id for x in left.collect()] == [3] and left.columns == ["doc_id", "text", "_hit"]


def brute_overlaps(rows, items, window=13, similarity=0.8):
    """Pairs of document and item that have a stretch of equal places, compared one place at a time along every diagonal."""
    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    out = set()
    for i, text in rows:
        d = split(text)
        for j, other in items:
            b = split(other)
            width = min(window, len(b))
            for diagonal in range(-len(b) + 1, len(d)):
                same = [0 <= k + diagonal < len(d) and d[k + diagonal] == b[k] for k in range(len(b))]
                inside = [0 <= k + diagonal < len(d) for k in range(len(b))]
                if any(all(inside[k : k + width]) and sum(same[k : k + width]) >= -(-width * 8 // 10) for k in range(len(b) - width + 1)):
                    out.add((i, j))
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(21)
    items = [(k, " ".join(r.choice("abcdefgh") + str(r.randrange(12)) for _ in range(r.choice((6, 13, 20, 40))))) for k in range(12)]
    rows = []
    for k in range(70):
        words = [r.choice("abcdefgh") + str(r.randrange(12)) for _ in range(r.randrange(3, 60))]
        piece = items[k % 12][1].split()
        if k % 2:
            at = r.randrange(max(1, len(piece) - 13))
            piece = piece[at : at + r.choice((12, 13, 16, 40))]
            for _ in range(r.randrange(4)):
                piece[r.randrange(len(piece))] = "zz"
            at = r.randrange(len(words))
            words[at:at] = piece
        rows.append((k, " ".join(words)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.overlaps(frame(spark, rows), benchmark).collect()}
    expected = brute_overlaps(rows, items)
    assert got <= expected
    # Two substitutions in 13 tokens can't miss all masks; shorter items are looked for as a whole or by one mask.
    assert {p for p in expected if len(items[p[1]][1].split()) >= 13} <= got and len(got) > 20


def test_line_dedup_of_repeated_rows(spark):
    text = "A line that is long enough to count alone."
    got = line_dedup.dedup_lines(frame(spark, [(1, text), (1, text), (2, text), (None, "other text")])).collect()
    assert sorted((str(x.doc_id), x.text) for x in got) == [("1", text), ("1", text), ("2", ""), ("None", "other text")]


def test_suffix_array_levels_reach_the_longest_run(spark):
    lines = [f"line {k}" for k in range(11)]
    rows = frame(spark, [(1, "\n".join(lines)), (2, "\n".join(["other", *lines])), (3, "x")])
    assert len(line_dedup.levels(rows)) == 4  # runs of 1, 2, 4 and 8 lines
    runs = [tuple(x) for x in line_dedup.copied_runs(rows).select("d", "start", "end").collect()]
    assert runs == [(2, 1, 11)]


def test_decontamination_tolerates_substitutions(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(r.randrange(20, 40)))) for k in range(20)] + [(90, "only six words are in here"), (91, "too short"), (92, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, planted = [], set()
    for k in range(60):
        words = [word() for _ in range(30)]
        if k % 2:
            hit = items[k % 20][1].split()
            for x in range(len(hit)):
                if r.random() < 0.08:
                    hit[x] = word()
            words[10:10] = [w.upper() + "," for w in hit]
            planted.add((k, k % 20))
        rows.append((k, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "Only six, words are in HERE and more"), (104, "only six words are in there")]
    got = {(x.doc_id, x.item_id) for x in decontam.overlaps(frame(spark, rows), benchmark).collect()}
    assert {p for p in got if p[0] < 60} <= planted and len({p for p in got if p[0] < 60}) >= 0.95 * len(planted)
    assert {p for p in got if p[0] >= 60} == {(103, 90)}
    assert decontam.clean(frame(spark, rows), benchmark).count() == len(rows) - len({p[0] for p in got})
    assert decontam.overlaps(frame(spark, rows), benchmark.limit(0)).count() == 0


def test_compact_windows_against_brute_force():
    r = random.Random(3)
    for _ in range(100):
        lengths = [r.randrange(40) for _ in range(4)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        values = np.array([r.randrange(25) for _ in range(bounds[-1])], np.uint64)
        least = r.randrange(1, 9)
        expected = set()
        for k in range(4):
            x = values[bounds[k] : bounds[k + 1]].tolist()
            for c in range(len(x)):
                left = right = c
                while left > 0 and x[left - 1] > x[c]:
                    left -= 1
                while right + 1 < len(x) and x[right + 1] >= x[c]:
                    right += 1
                if right - left + 1 >= least:
                    expected.add((k, left, c, right))
        assert set(zip(*[x.tolist() for x in compact_windows.windows_of(values, bounds, least)], strict=True)) == expected


def test_passages_at_the_threshold_share_a_key():
    r = random.Random(5)
    fresh = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    for k in range(300):
        a = fresh(r.choice((50, 50, 59, 95, 140)))
        # As many substitutions, insertions or deletions as the threshold allows, dealt out evenly, or another end.
        changes = max(1, len(a) // 50)
        b = list(a)
        for c in range(changes):
            at = (2 * c + 1) * len(b) // (2 * changes)
            b[at : at + r.choice((0, 1))] = fresh(1) if k % 3 else []
        if k % 3 == 0 and b == a:
            b = [*a[5:], *fresh(5)]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        if len(x & y) / len(x | y) < 0.8:
            continue
        batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2]), "text": [" ".join(a), " ".join([*fresh(30), *b, *fresh(30)])]})
        keys = defaultdict(set)
        for part in compact_windows._members(5, compact_windows.RUN)([batch]):
            for key, id_ in zip(part["key"].to_pylist(), part["id"].to_pylist(), strict=True):
                keys[id_].add(key)
        assert keys[1] & keys[2], (len(a), changes)


def test_members_against_brute_force():
    r = random.Random(6)
    for _ in range(40):
        lengths = [r.randrange(60) for _ in range(3)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        s = np.array([r.randrange(1 << 40) for _ in range(bounds[-1])], np.uint64)
        run = r.randrange(2, 12)
        v = [compact_windows.textops.mix(s ^ np.uint64((0x51ED270B * (j + 1)) << 20)) for j in range(2)]
        expected = set()
        for k in range(3):
            least = {}
            for at in range(bounds[k], bounds[k + 1] - run + 1):
                places = tuple(at + int(x[at : at + run].argmin()) for x in v)
                lo, hi = least.get(places, (at, at))
                least[places] = min(lo, at), max(hi, at + run - 1)
            for (x, y), (lo, hi) in least.items():
                expected.add((k, *(int(z - bounds[k]) for z in (lo, hi, min(x, y), max(x, y)))))
        own, _, *places = compact_windows.members_of(s, bounds, run)
        got = zip(own.tolist(), *[x.tolist() for x in places], strict=True)
        assert {(k, max(lo, q - run + 1), min(hi, p + run - 1), p, q) for k, lo, hi, p, q in got} == expected


def brute_passages(rows):
    """Documents that have a passage with an earlier one, by comparing all texts with all."""
    texts = {}
    for i, t in rows:
        for w in compact_windows.textops.words(pa.array([t])):
            texts[i] = compact_windows.textops.shingles(compact_windows.textops.hashes(w), w.bounds, 5)[0]
    return {(b, a) for a in texts for b in texts if a < b and len(texts[a]) and len(texts[b]) and compact_windows.passages(texts[a], texts[b], 46, 0.8)}


def test_passages_against_brute_force(spark):
    r = random.Random(12)
    fresh = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    phrases, blocks, rows = [fresh(k) for k in (8, 14, 30, 38)], [fresh(r.choice((52, 70, 130))) for _ in range(8)], []
    for i in range(90):
        words = []
        for _ in range(r.randrange(1, 6)):
            words += r.choice([*phrases, *phrases, r.choice(blocks), fresh(r.randrange(10, 60))])
        for _ in range(len(words) // 90):
            words[r.randrange(len(words))] = fresh(1)[0]
        rows.append((i, " ".join(words)))
    expected = brute_passages(rows)
    found = compact_windows.repeated_passages(frame(spark, rows)).collect()
    texts = {i: t.split() for i, t in rows}
    shingles = lambda i, first, last: {tuple(texts[i][k : k + 5]) for k in range(first, last - 3)}
    for p in found:
        x, y = shingles(p.doc_id, p.start, p.end), shingles(p.other_id, p.other_start, p.other_end)
        assert p.end - p.start >= 49 and p.other_end - p.other_start >= 49 and len(x & y) / len(x | y) >= 0.8
        assert p.similarity == pytest.approx(len(x & y) / len(x | y))
    docs = {b for b, _ in expected}
    assert len(docs & {p.doc_id for p in found}) >= 0.98 * len(docs) > 0


def test_passages_in_another_order_are_found():
    fresh = iter(np.random.default_rng(4).permutation(100_000).astype(np.uint64))
    new = lambda k: np.array([next(fresh) for _ in range(k)], np.uint64)
    p1, p2 = new(56), new(56)
    covered = lambda got, where: all(any(g[0] <= a + 3 and g[1] >= a + 52 and g[2] <= b + 3 and g[3] >= b + 52 for g in got) for a, b in where)
    for gap in (30, 60, 400):
        got = compact_windows.passages(np.concatenate([p2, new(gap), p1]), np.concatenate([p1, new(4), p2]), 46, 0.8)
        assert covered(got, [(56 + gap, 0), (0, 60)]), gap
    # A long run that passes with a second passage elsewhere in a.
    long = new(300)
    got = compact_windows.passages(np.concatenate([p2, new(900), long]), np.concatenate([long, p2]), 46, 0.8)
    assert covered(got, [(0, 300)]) and any(g[3] - g[2] >= 295 for g in got)
    # Exact stretch beside one that is too loose, and a shingle that a has in several places.
    loose = new(40)
    loose_b = loose.copy()
    loose_b[4::8] = new(5)
    got = compact_windows.passages(np.concatenate([p1, new(9), p1[:9]]), np.concatenate([p1, new(9), loose_b]), 46, 0.8)
    assert covered(got, [(0, 0)])


def test_repeated_passages(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefghijklm") + str(r.randrange(3000))
    passages = [[word() for _ in range(r.choice((55, 60, 120)))] for _ in range(6)]
    rows, where = [], defaultdict(list)
    for i in range(90):
        words = [word() for _ in range(r.randrange(5, 150))]
        if i % 3 == 0:
            p = list(passages[i // 3 % 6])
            if len(p) > 100:
                p[50] = word()
            at = r.randrange(len(words) + 1)
            words[at:at] = p
            where[i // 3 % 6].append(i)
        rows.append((i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, "x y"), (403, rows[1][1])]
    got = compact_windows.repeated_passages(frame(spark, rows)).collect()
    assert {x for p in got if p.kind == "passage" for x in (p.doc_id, p.other_id)} == {i for own in where.values() for i in own}
    copies = [(p.doc_id, p.other_id) for p in got if p.kind == "copy"]
    assert copies == ([(403, 1)] if len(rows[1][1].split()) >= 50 else [])
    assert all(p.end - p.start + 1 >= 50 and p.similarity >= 0.8 for p in got)
    assert compact_windows.repeated_passages(frame(spark, rows).limit(0)).count() == 0


def test_all_families_of_a_signature_are_compared(spark, monkeypatch):
    # All members have the same signature, as around one phrase: whatever is found depends on who is compared.
    run = compact_windows._members

    def one_key(n, least):
        def of(batches):
            for b in run(n, least)(batches):
                yield b.set_column(0, "key", pa.array(np.zeros(b.num_rows, np.int64)))

        return of

    monkeypatch.setattr(compact_windows, "_members", one_key)
    r = random.Random(9)
    fresh = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    families = [fresh(60) for _ in range(7)]
    rows = [(k, " ".join([*fresh(3), *families[k % 7], *fresh(3)])) for k in range(21)]
    # What matches the first text elsewhere is still compared with the others of its group.
    extra = fresh(60)
    rows += [(30, " ".join([*families[0], *fresh(9), *extra])), (31, " ".join([*fresh(9), *extra]))]
    got = compact_windows.repeated_passages(frame(spark, rows)).collect()
    assert {(p.doc_id, p.other_id) for p in got} >= {(31, 30)} | {(k, k % 7) for k in range(7, 21)}


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in rest}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark):
    r = random.Random(6)
    rows = []
    for k in range(1500):
        source = r.choice(["a", "a", "a", "a", "a", "a", "b", "c", "é", None])
        rows.append((k, r.choice([None, "", "w " * r.randrange(1, 40)]) if r.random() < 0.1 else "w " * r.randrange(1, 40), source))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.systematic_mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in [*rows, rows[0]]:
        sizes[s] += len(WORD.findall(t or ""))
    expected = brute_targets(dict(sizes))
    taken = Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(expected[x.source])
        assert x.copies * x.size <= 3 * x.size
        taken[x.source] += x.copies * x.size
    assert len(got) == len(rows) + 1
    for s, target in expected.items():
        assert abs(taken[s] - target) <= 0.03 * target + 120
    again = mixing.systematic_mix(docs.repartition(7))
    assert sorted((x.doc_id, x.copies) for x in got) == sorted((x.doc_id, x.copies) for x in again.collect())
    assert mixing.systematic_mix(docs.limit(0)).count() == 0


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def test_jaccard_components(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(n)) for n in (30, 120, 120, 400)]
    rows = []
    for k in range(240):
        words = base[k % 4].split()
        for _ in range(r.choice((0, 0, 1, 2, 3, 5)) * len(words) // 120):
            words[r.randrange(len(words))] = r.choice("xyz") + str(r.randrange(1000))
        rows.append((k, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "one two three"), (1006, "one two  three"), (1007, "É a b"), (1008, "é a b")]
    got = sorted(tuple(x) for x in jaccard_join.jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)
    assert jaccard_join.jaccard_components(frame(spark, rows).limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    word = lambda: r.choice(["the", "river", "stone", "music", "window", "paper", "garden", "silver", "morning", "house"]) + r.choice(["", "s", "ly"])
    text = lambda n: " ".join(word() for _ in range(n))
    item, boiler = text(30), "All rights are reserved by the owner of this."
    body = [text(60) for _ in range(30)]
    rows = [(k, b, "en", f"s{k % 3}", len(b)) for k, b in enumerate(body)]
    add = lambda i, t: rows.append((i, t, "en", "s0", len(t)))
    add(100, "... 123 !!!")
    add(101, f"{body[0]} end")  # near copy
    add(102, f"{text(20)} {item} {text(20)}")
    add(103, f"{boiler}\n{text(40)}")
    add(104, f"{boiler}\n{text(40)}")
    add(105, body[1])  # exact copy
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({x.doc_id for x in docs.select("doc_id").collect()})
    everything = {x[0] for x in rows}
    assert ids[0] == everything - {100}
    assert ids[1] == ids[0] - {105}
    assert ids[2] == ids[1] - {101}
    assert ids[3] == ids[2] - {102}
    assert ids[4] <= ids[3] and "copy" in docs.columns
    deduped = spark.read.parquet(str(tmp_path / "line_dedup")).where("doc_id = 104").first()
    assert boiler not in deduped.text and deduped.n_chars == len(deduped.text)
    assert sorted(tuple(x) for x in pipeline.run(spark, str(tmp_path)).select("doc_id", "copy").collect()) == sorted(tuple(x) for x in docs.select("doc_id", "copy").collect())


def test_near_duplicates_stage_links_from_four_fifths_of_five_word_shingles(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(104)]
    longer, other = [*words, *[f"x{k}" for k in range(22)]], [*words[:60], *[f"y{k}" for k in range(44)]]
    sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (words, longer)]
    assert 0.81 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.83
    rows = frame(spark, [(k, " ".join(x)) for k, x in enumerate((words, longer, other))])
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, rows, "").collect()) == [0, 2]


@pytest.mark.parametrize("small", [16, 0])
def test_passages_of_later_families_under_one_key(spark, monkeypatch, small):
    monkeypatch.setattr(compact_windows, "SMALL", small)
    monkeypatch.setattr(compact_windows, "BLOCK", 4)
    r = random.Random(77)
    fresh = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    # Two texts for each phrase and tail, with a word between that is replaced; the first text with either has the other not.
    phrases, tails, rows, links = [fresh(26) for _ in range(4)], [fresh(26) for _ in range(4)], [], set()
    for phrase in phrases:
        for tail in tails:
            links.add((len(rows) + 1, len(rows)))
            rows += [(len(rows) + k, " ".join([*fresh(30), *phrase, *fresh(1), *tail, *fresh(30)])) for k in range(2)]
    found = {(p.doc_id, p.other_id) for p in compact_windows.repeated_passages(frame(spark, rows)).collect()}
    assert found == brute_passages(rows) >= links


def test_what_the_first_text_covers_is_compared_with_what_it_does_not(spark, monkeypatch):
    r = random.Random(4)
    fresh = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    before, phrase, after = fresh(30), fresh(26), fresh(30)
    texts = [" ".join(x) for x in ([*before, *phrase, *fresh(30)], [*before, *phrase, *after], [*fresh(30), *phrase, *after])]
    run = compact_windows._members
    found = pa.Table.from_batches(run(5, compact_windows.RUN)([pa.RecordBatch.from_pydict({"id": pa.array([0, 1, 2]), "text": texts})])).to_pylist()
    # Only the keys of the phrase: the second text is covered there by its passage with the first one, the third is not.
    shared = [k for k in {x["key"] for x in found} if {x["id"] for x in found if x["key"] == k} == {0, 1, 2}]

    def of_phrase(n, least):
        def of(batches):
            for b in run(n, least)(batches):
                yield b.filter(pa.array([k in shared for k in b["key"].to_pylist()]))

        return of

    monkeypatch.setattr(compact_windows, "_members", of_phrase)
    assert shared
    got = compact_windows.repeated_passages(frame(spark, list(enumerate(texts)))).collect()
    assert {(p.doc_id, p.other_id) for p in got} == {(1, 0), (2, 1)}


def test_a_family_that_the_first_text_does_not_cover_is_joined_without_all_its_pairs(spark, monkeypatch):
    run = compact_windows._members

    def one_key(n, least):
        def of(batches):
            for b in run(n, least)(batches):
                yield b.set_column(0, "key", pa.array(np.zeros(b.num_rows, np.int64)))

        return of

    monkeypatch.setattr(compact_windows, "_members", one_key)
    r = random.Random(23)
    fresh = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    families = [fresh(70) for _ in range(3)]
    # The first text has no passage with any; one family is joined to another by one text only.
    rows = [(0, " ".join(fresh(90)))] + [(k, " ".join([*fresh(3), *families[k % 3], *fresh(3)])) for k in range(1, 91)]
    rows.append((91, " ".join([*families[0], *families[1]])))
    found = {(p.doc_id, p.other_id) for p in compact_windows.repeated_passages(frame(spark, rows)).collect()}
    assert {b for b, _ in found} == set(range(4, 92)) and len(found) < 3 * len(rows)
    root = list(range(92))
    for b, a in sorted(found):
        root = [root[a] if x == root[b] else x for x in root]
    assert len({root[k] for k in range(1, 92) if k % 3 != 2}) == 1 and len({root[k] for k in range(1, 91)}) == 2


def test_runs_that_may_be_passages_are_kept():
    r = np.random.default_rng(8)
    # Codes of 200 shingles, 200 is foreign; every run of 46 or more that begins and ends as the scores ask for is seen, also those that go on beyond a part.
    for _ in range(300):
        parts = [np.where(r.random(k) < r.choice([0.7, 0.85, 0.95]), r.integers(0, 60, k), r.integers(60, 201, k)) for k in r.integers(50, 160, 6)]
        parts[0] = np.arange(60)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        goes_on = np.zeros((6, 2), bool)
        within = np.array([[len(x), 0] for x in parts])
        b = np.arange(1, 6)
        got = compact_windows.dense(np.concatenate(parts), bounds, goes_on, within, np.zeros(5, int), b, 200, 46, 0.8)
        for k in b.tolist():
            total = np.concatenate([[0], np.cumsum(np.where(parts[k] < 60, 1, -4))])
            spans = [(s, e) for s in range(len(total)) for e in range(s + 46, len(total)) if total[s] <= total[s : e + 1].min() and total[e] >= total[s : e + 1].max()]
            assert bool(got[k - 1]) == bool(spans)
