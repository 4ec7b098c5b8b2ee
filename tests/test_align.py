import gzip
import random

import pytest

from strandline.errors import IndexError_, InputError, OutputError, UnsupportedError, UsageError
from strandline.functions.kernels import reverse_complement
from strandline.operators.chain import best_chain, filtered
from strandline.operators.link import ALIGNMENT
from strandline.operators.mainpath import link_main_path
from strandline.plans import align as plan
from strandline.sinks import formats
from strandline.sources import fasta, index

RANDOM = random.Random(419)
REF = "".join(RANDOM.choice("ACGT") for _ in range(2400))
# An insertion and a deletion that can't be moved without a mismatch.
OTHER = {"A": "C", "C": "G", "G": "T", "T": "A"}
INSERT = OTHER[REF[700]] + "".join(RANDOM.choice("ACGT") for _ in range(5)) + OTHER[REF[699]]
GONE = next(k for k in range(1350, 1400) if REF[k] != REF[k + 5] and REF[k - 1] != REF[k + 4])
QUERY = REF[:300] + OTHER[REF[300]] + REF[301:700] + INSERT + REF[700:GONE] + REF[GONE + 5 :]


def frame(spark, name, bases):
    return spark.createDataFrame([(0, name, bases)], "seq_id long, name string, bases string")


def ancestry(reverse):
    shift = lambda i: i if i < 700 else i + 7 if i < GONE else i + 2
    return {("-" if reverse else "+", i, len(QUERY) - 1 - shift(i) if reverse else shift(i)) for i in range(2400) if not GONE <= i < GONE + 5}


@pytest.mark.parametrize("reverse", [False, True])
def test_alignment_and_formats_agree(spark, tmp_path, reverse):
    refs, queries = frame(spark, "r", REF), frame(spark, "q", reverse_complement(QUERY) if reverse else QUERY)
    rows = plan.align(refs, queries).persist()
    pairs = {(x.strand, x.r, x.q) for x in formats.aligned_pairs(rows).collect()}
    assert pairs and pairs <= ancestry(reverse)
    assert [r.primary for r in rows.collect()] == [True]
    path = str(tmp_path / "out.paf")
    formats.publish(formats.lines("paf", rows, refs, queries), path)
    again = formats.read_paf(spark, path).withColumnRenamed("ref", "ref_id").withColumnRenamed("query", "query_id")
    assert {(x.strand, x.r, x.q) for x in formats.aligned_pairs(again).collect()} == pairs
    with pytest.raises(OutputError):
        formats.publish(formats.lines("paf", rows, refs, queries), path)
    row = rows.first()
    sam = [x.line.split("\t") for x in formats.lines("sam", rows, refs, queries).where("part = 1").collect()]
    assert [(x[1], x[3], x[4]) for x in sam] == [("16" if reverse else "0", str(row.rb + 1), "255")]
    chain = formats.lines("chain", rows, refs, queries).first().line.split("\n")
    assert sum(int(x.split("\t")[0]) for x in chain[1:] if x) == sum(c.len for c in row.cigar if c.op in "=X")
    delta = [x.line for x in formats.lines("delta", rows, refs, queries).where("part = 1").collect()][0].split("\n")
    assert delta[0] == f">r q {len(REF)} {len(QUERY)}" and delta[-1] == "0"
    maf = formats.lines("maf", rows, refs, queries).where("part = 1").first().line.split("\n")
    assert len(maf[2].split()[-1]) == len(maf[3].split()[-1]) == row.columns


def test_unknown_bases_have_no_alignment(spark):
    assert plan.align(frame(spark, "r", "N" * 97), frame(spark, "q", "N" * 103)).count() == 0


def test_given_seeds(spark):
    refs = queries = frame(spark, "s", "A" * 80)
    seed = lambda n: spark.createDataFrame([(0, 0, 0, 0, n, "+")], "ref_id long, rb long, query_id long, qb long, len long, strand string")
    assert [r.score for r in plan.align(refs, queries, seeds=seed(80), selection="one_to_one").collect()] == [720]
    with pytest.raises(InputError):
        plan.align(refs, queries, seeds=seed(81))


def test_neighbours_that_touch_are_no_chain():
    assert len(best_chain([(0, 0, 5), (5, 5, 4)], "+")) == 1
    assert len(best_chain([(0, 0, 5), (6, 6, 4)], "+")) == 2
    assert filtered([(0, 0, 5), (5, 5, 4)]) == [(0, 0, 9)]


def write(path, data):
    path.write_bytes(data)
    return str(path)


def test_fasta(spark, tmp_path):
    plain = write(tmp_path / "a.fa", b">one first\r\nACgt\r\nnnX\r\n>two\nAC\n")
    rows = [tuple(r) for r in fasta.read_fasta(spark, plain, first_id=3).orderBy("seq_id").collect()]
    assert rows == [(3, "one", "one first", "ACGTNNN", 7, 3), (4, "two", "two", "AC", 2, 0)]
    packed = write(tmp_path / "b.fa.gz", gzip.compress(b">one\nAC\n"))
    assert fasta.read_fasta(spark, packed).first()["bases"] == "AC"


@pytest.mark.parametrize("data", [b"", b"@one\nAC\n+\n!!\n", b">one\nAC\n>one\nGG\n", b">one\n>two\nAC\n", b"> \nAC\n", b">one\nA C\n"])
def test_malformed_fasta(spark, tmp_path, data):
    with pytest.raises(InputError):
        fasta.read_fasta(spark, write(tmp_path / "bad.fa", data)).count()


def test_compression_is_told_by_content(spark, tmp_path):
    with pytest.raises(UnsupportedError):
        fasta.read_fasta(spark, write(tmp_path / "a.fa.xz", b"\xfd7zXZ\x00rest"))
    with pytest.raises(InputError):
        fasta.read_fasta(spark, write(tmp_path / "a.fa.gz", b">one\nAC\n"))


def test_index(spark, tmp_path):
    refs = frame(spark, "r", REF)
    path = str(tmp_path / "index")
    index.build(refs, path)
    assert index.load(spark, path, refs).kmers.count() == len(REF) - 19
    with pytest.raises(OutputError):
        index.build(refs, path)
    with pytest.raises(IndexError_):
        index.load(spark, path, frame(spark, "r", REF[:-1] + "N"))
    with pytest.raises(IndexError_):
        index.load(spark, str(tmp_path / "none"))


def test_batch_goes_on_after_a_failure(spark, tmp_path):
    ref = write(tmp_path / "r.fa", f">r\n{REF}\n".encode())
    good, bad = write(tmp_path / "q.fa", f">q\n{QUERY}\n".encode()), write(tmp_path / "bad.fa", b"")
    done = plan.batch(spark, ref, [("bad", bad), ("good", good)], str(tmp_path / "out"))
    assert [(r["name"], r["status"], r["exit_code"], r["alignments"]) for r in done.collect()] == [("bad", "failed", 3, 0), ("good", "ok", 0, 1)]


def test_options():
    with pytest.raises(UsageError):
        plan.Options(mode="other")


def test_all_gaps_of_the_main_path_are_filled(spark):
    # Each gap is 200 by 200 bases, so aligning both is far more work than the sequences have bases.
    changed = (100, 200, 400, 600, 700, 900, 1100, 1200)
    query = "".join(OTHER[b] if i in changed else b for i, b in enumerate(REF[:1300]))
    part = lambda b, e: [("=", 100), ("X", 1), ("=", 99), ("X", 1), ("=", e - b - 201)]
    rows = [(0, b, e, 0, b, e, "+", [{"op": o, "len": n} for o, n in part(b, e)], 0, 2, e - b - 2, e - b) for b, e in ((0, 300), (500, 800), (1000, 1300))]
    found = spark.createDataFrame(rows, ALIGNMENT)
    linked = link_main_path(found, frame(spark, "r", REF[:1300]), frame(spark, "q", query)).collect()
    assert [(r.rb, r.re, r.members, r.edits, r.matches) for r in linked] == [(0, 1300, 3, 8, 1292)]
