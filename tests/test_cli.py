import random

import pytest

from strandline import cli
from strandline.errors import InputError, OutputError, UsageError
from strandline.sinks import runs, validate
from strandline.sources import regions


def write(path, text):
    path.write_text(text)
    return str(path)


def test_align_command(spark, tmp_path):
    bases = "".join(random.Random(17031).choice("ACGT") for _ in range(600))
    ref, query = write(tmp_path / "r.fa", f">r\n{bases}\n"), write(tmp_path / "q.fa", f">q\n{bases[:300]}{bases[301:]}\n")
    out = tmp_path / "a.paf"
    assert cli.main(["align", ref, query, "-o", str(out)], spark) == 0
    assert len(out.read_text().splitlines()) == 1
    assert cli.main(["align", ref, query, "-o", str(out)], spark) == 7
    assert cli.main(["align", ref, write(tmp_path / "bad.fa", ""), "-o", str(tmp_path / "b.paf")], spark) == 3
    assert cli.main(["align", ref, query, "-o", str(tmp_path / "b.bam")], spark) == 2


def test_outputs():
    assert cli.outputs(["x.sam", "y.PAF"]) == {"sam": "x.sam", "paf": "y.PAF"}
    with pytest.raises(UsageError):
        cli.outputs(["x.sam", "y.sam"])


def test_region_files(spark, tmp_path):
    bed = regions.read_bed(spark, write(tmp_path / "a.bed", "#c\ntrack x\n\nchr1\t0\t5\tn\nchr1\t5\t9\n"))
    assert sorted(tuple(r) for r in bed.collect()) == [("chr1", 0, 5, "n"), ("chr1", 5, 9, None)]
    regions.check_bounds(bed, spark.createDataFrame([("chr1", 9)], "name string, length long"))
    with pytest.raises(InputError):
        regions.check_bounds(bed, spark.createDataFrame([("chr1", 8)], "name string, length long"))
    for text in ("chr1\t0\n", "chr1\t5\t5\n", "chr1\t0\t5\nchr1\t4\t9\n"):
        with pytest.raises(InputError):
            regions.read_bed(spark, write(tmp_path / "bad.bed", text))


def test_direction_tables(spark, tmp_path):
    text = "region_id\tsource_line\tquery_begin\tquery_end\tstrand\n1\t2\t0\t5\t+\n2\t3\t5\t9\t-\n"
    rows = regions.read_directions(spark, write(tmp_path / "d.tsv", text)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 5, "+"), (2, 5, 9, "-")]
    for bad in ("x\ty\n", text.replace("5\t9\t-", "4\t9\t-"), text.replace("\t-", "\t?")):
        with pytest.raises(InputError):
            regions.read_directions(spark, write(tmp_path / "bad.tsv", bad))


def test_query_list(spark, tmp_path):
    path = write(tmp_path / "q.txt", "# c\n\none a.fa\ntwo\t/x/b c.fa\n")
    assert regions.read_query_list(spark, path) == [("one", f"{tmp_path}/a.fa"), ("two", "/x/b c.fa")]
    with pytest.raises(InputError):
        regions.read_query_list(spark, write(tmp_path / "r.txt", "one a\none b\n"))


def test_pair_outputs(spark, tmp_path):
    r = random.Random(31)
    bases = "".join(r.choice("ACGT") for _ in range(1500))
    changed = bases[:500] + ("A" if bases[500] != "A" else "C") + bases[501:900] + bases[903:]
    ref, query = write(tmp_path / "r.fa", f">r\n{bases}\n"), write(tmp_path / "q.fa", f">q\n{changed}\n")
    regions_ = write(tmp_path / "d.tsv", f"block_id\tquery_begin\tquery_end\tstrand\n1\t0\t{len(changed)}\t+\n")
    names = [str(tmp_path / f"a.{kind}") for kind in ("paf", "sam", "maf")]
    assert cli.main(["align", "-c", ref, query, "--directions", regions_, *[x for n in names for x in ("-o", n)], "--log-dir", str(tmp_path / "logs")], spark) == 0
    (line,) = (tmp_path / "a.paf").read_text().splitlines()
    fields = line.split("\t")
    tags = dict((t.split(":", 2)[0], t.split(":", 2)[2]) for t in fields[12:])
    assert fields[:9] == ["q", "1497", "0", "1497", "+", "r", "1500", "0", "1500"] and tags["NM"] == "4" and tags["AS"] == tags["sc"] and tags["st"] == "complete"
    rows = (tmp_path / "a.segments.tsv").read_text().splitlines()
    assert len(rows) == 2 and len(rows[0].split("\t")) == 16 and dict(zip(rows[0].split("\t"), rows[1].split("\t"), strict=True))["cigar"] == tags["cg"]
    assert len((tmp_path / "a.gaps.tsv").read_text().splitlines()) == 3
    record = [x for x in (tmp_path / "a.sam").read_text().splitlines() if not x.startswith("@")]
    assert len(record) == 1 and record[0].split("\t")[1] == "0" and record[0].split("\t")[9] == changed
    for kind, path in zip(("paf", "sam"), names[:2], strict=True):
        validate.check(spark, kind, path)
    assert "status=ok" in next((tmp_path / "logs").glob("*.log")).read_text()
    assert cli.main(["align", "-c", ref, query, "-o", str(tmp_path / "b.delta")], spark) == 2
    bed = write(tmp_path / "x.bed", "r\t0\t5\n")
    assert cli.main(["align", ref, query, "-o", str(tmp_path / "b.paf"), "--ref-cen", bed], spark) == 2
    assert cli.main(["align", ref, query, "-o", str(tmp_path / "b.paf"), "--ref-cen", bed, "--query-cen", write(tmp_path / "y.bed", "q\t0\t5\n")], spark) == 4


def test_validators(spark, tmp_path):
    good = {
        "sam": "@HD\tVN:1.6\n" + "\t".join("abcdefghijk") + "\n",
        "paf": "\t".join("abcdefghijkl") + "\n",
        "delta": "a b\nNUCMER\n",
        "maf": "##maf version=1\n\na score=5\ns r 0 3 + 9 AC-T\ns q 1 4 - 9 ACGT\n",
        "chain": "chain 5 r 20 + 0 9 q 20 - 1 9 1\n5\t2\t1\n2\n\n",
    }
    bad = {
        "sam": ["@XX\ta\n", "@HD\tVN:1.6\na\tb\n", "\t".join("abcdefghijk") + "\n"],
        "paf": ["a\tb\n"],
        "delta": ["a b\n", "a b\nPROMER\n"],
        "maf": ["a score=5\n", good["maf"].replace("0 3 +", "0 4 +"), good["maf"].replace("s q 1 4 - 9 ACGT\n", ""), good["maf"].replace("ACGT", "ACGTT").replace("1 4", "1 5")],
        "chain": [good["chain"].replace("\n2\n", "\n3\n"), good["chain"].replace("5\t2\t1", "5"), "5\n\n", good["chain"].replace("0 9 q", "9 9 q")],
    }
    for kind, text in good.items():
        validate.check(spark, kind, write(tmp_path / f"good.{kind}", text))
        for k, wrong in enumerate(bad[kind]):
            with pytest.raises(OutputError):
                validate.check(spark, kind, write(tmp_path / f"bad{k}.{kind}", wrong))


def test_run_files(spark, tmp_path):
    assert runs.escaped("a\tb\\c\n") == "a\\tb\\\\c\\n" and runs.invocation(["x", "a b"]) == "x 'a b'"
    table = runs.BatchTable(spark, str(tmp_path))
    table.row(1, "n", "p", "ok", 0, 1.5, 2, "d", "l", "two\nlines")
    table.close()
    assert (tmp_path / "batch.tsv").read_text().splitlines()[1] == "1\tn\tp\tok\t0\t1.5\t2\td\tl\ttwo\\nlines"
    with pytest.raises(OutputError):
        runs.BatchTable(spark, str(tmp_path))


def test_index_is_used_and_kept(spark, tmp_path):
    bases = "".join(random.Random(7).choice("ACGT") for _ in range(400))
    ref, query = write(tmp_path / "r.fa", f">r\n{bases}\n"), write(tmp_path / "q.fa", f">q\n{bases[:380]}\n")
    place = str(tmp_path / "r.index")
    assert cli.main(["align", ref, query, "-o", str(tmp_path / "a.paf"), "--save", place], spark) == 0
    assert cli.main(["align", ref, query, "-o", str(tmp_path / "b.paf"), "--reference-index", place], spark) == 0
    assert (tmp_path / "a.paf").read_text() == (tmp_path / "b.paf").read_text() != ""
    other = write(tmp_path / "o.fa", f">r\n{bases[1:]}\n")
    assert cli.main(["align", other, query, "-o", str(tmp_path / "c.paf"), "--reference-index", place], spark) == 5
    assert cli.main(["align", ref, query, "-o", str(tmp_path / "c.paf"), "--reference-index", place, "--save", place], spark) == 2
