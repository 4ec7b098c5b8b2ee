"""Results that later steps begin from, and groups of rows for Python."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def cut(df: DataFrame) -> DataFrame:
    """``df``, made now and kept in the folder of ``spark.checkpoint.dir``. What is read several times is then made once, and plans don't grow with each step."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if configured is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="strandline-"))
    return df.checkpoint(eager=True)


#: Rows that go back from Python at once.
OUT = 2_000


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` by hash of ``by`` in all shuffle partitions: what takes Python long may be few bytes, of which adaptive execution makes one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def made(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, a few at a time."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == OUT:
            yield batch()
            held = []
    if held:
        yield batch()


def by_group(df: DataFrame, by: list[str], run: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``run`` on each group of rows of equal ``by``, which are the first columns: (key, rows) to rows of ``schema``.

    Groups follow each other in a stream of rows. With pandas each costs a millisecond or two, more than most of them take.
    """
    n, kind = len(by), to_arrow_schema(StructType.fromDDL(schema))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped = groupby(rows_of(batches), key=lambda row: row[:n])
        return made((out for key, rows in grouped for out in run(key, list(rows))), kind)

    return dealt(df.select(*by, *[c for c in df.columns if c not in by]), by).sortWithinPartitions(*by).mapInArrow(of, schema)
