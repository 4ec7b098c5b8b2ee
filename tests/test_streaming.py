import random

from strandline.streaming import align_stream


def test_files_are_aligned_as_they_arrive(spark, tmp_path):
    bases = "".join(random.Random(5).choice("ACGT") for _ in range(300))
    reference = spark.createDataFrame([(0, bases)], "seq_id long, bases string")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(7, bases[:200])], "seq_id long, bases string").coalesce(1).write.parquet(folder)
    query = align_stream(spark, reference, folder, out, str(tmp_path / "checkpoint"))
    query.awaitTermination(300)
    assert query.exception() is None
    assert [(r.query_id, r.rb, r.re) for r in spark.read.parquet(out).collect()] == [(7, 0, 200)]
