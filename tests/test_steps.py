"""Groups that stream through Python, and what the steps of an alignment make once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequence
from strandline.operators import chain, link, seeds, select
from strandline.operators.steps import by_group


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_go_on_over_batches(spark):
    rows = [(k % 7, f"s{k % 2}", k) for k in range(200)]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, 3)
    try:
        found = by_group(spark.createDataFrame(rows, "a int, b string, v long"), ["a", "b"], lambda key, group: [(*key, len(group), sum(r[2] for r in group))], "a int, b string, n long, total long").collect()
    finally:
        spark.conf.set(conf, before)
    expected = {(a, b): [v for x, y, v in rows if (x, y) == (a, b)] for a in range(7) for b in ("s0", "s1")}
    assert sorted(tuple(r) for r in found) == sorted((a, b, len(v), sum(v)) for (a, b), v in expected.items() if v)


def test_small_groups_are_no_pandas_frames(spark):
    reference = spark.createDataFrame([(1, "ACGTTGCATCGATTACGGATCCTAGCAT" * 4)], "seq_id long, bases string")
    found = seeds.seeds(reference, reference, "maxmatch", 20)
    chains = chain.chains(found)
    aligned = link.align_chains(chains, reference, reference)
    for df in (chains, aligned, select.bilateral(aligned)):
        assert "GroupsInPandas" not in _plan(df)
    assert aligned.count() >= 1


def test_bases_are_folded_once_for_matches(spark):
    texts = spark.createDataFrame([(1, "some prose that is folded to bases"), (2, None)], "seq_id long, text string").select("seq_id", sequence.folded(F.col("text")).alias("bases"))
    queries = spark.createDataFrame([(7, "ACGTTGCATCGATTACGGATCCTAGCAT")], "seq_id long, bases string")
    found = seeds.mems(texts, queries, 20)
    # A filter on the column of bases would make it a second time.
    assert _plan(found).split("MapInArrow")[-1].count("regexp_replace") == 1
    assert found.count() == 0
