"""An extension: queries that arrive as files are aligned batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandline.plans.align import Options, align


def align_stream(spark: SparkSession, reference: DataFrame, folder: str, output: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:  # noqa: B008
    """Align each Parquet file of (seq_id, bases) that appears in ``folder`` to (seq_id, bases), all candidates, and append them to ``output``.

    A batch writes a folder of its own, so one that is run again after a failure replaces what it had written.
    """
    arriving = spark.readStream.schema("seq_id long, bases string").parquet(folder)

    def one(queries: DataFrame, batch: int) -> None:
        found = align(reference, queries, options, selection="all")
        found.write.mode("overwrite").parquet(f"{output}/batch={batch}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
