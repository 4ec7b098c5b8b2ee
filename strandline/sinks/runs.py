"""What a run leaves beside its alignments: the table of a batch, a log, and how it was called."""

from __future__ import annotations

import shlex
import time
import uuid

from pyspark.sql import SparkSession

from strandline.errors import OutputError

BATCH = ("order", "name", "query_path", "status", "exit_code", "elapsed_seconds", "alignment_records", "output_dir", "log_path", "message")


def escaped(text: str) -> str:
    """For a field of a table: backslash, tab and line ends spelled out."""
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def invocation(args: list[str]) -> str:
    """A command line that gives these arguments again in a shell."""
    return shlex.join(args)


class TextFile:
    """A new text file in any file system that Spark reaches, line by line; an OutputError if it exists."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        try:
            self._out = files.create(place, False)
        except Exception as e:
            raise OutputError(f"{path} exists or can't be made") from e

    def line(self, text: str) -> None:
        self._out.write(bytearray(f"{text}\n".encode()))
        self._out.hflush()

    def close(self) -> None:
        self._out.close()


class BatchTable:
    """batch.tsv in a folder: one row a query, written as it ends."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._file = TextFile(spark, f"{folder}/batch.tsv")
        self._file.line("\t".join(BATCH))

    def row(self, *fields: object) -> None:
        self._file.line("\t".join(escaped("" if f is None else str(f)) for f in fields))

    def close(self) -> None:
        self._file.close()


class RunLog:
    """key=value lines of one run, each with the seconds since it began; every run has an id of its own."""

    def __init__(self, spark: SparkSession, folder: str, args: list[str]) -> None:
        self.id = f"{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"
        self.path = f"{folder}/{self.id}.log"
        self._began = time.time()
        self._file = TextFile(spark, self.path)
        self.put(run_id=self.id, application_id=spark.sparkContext.applicationId, invocation=invocation(args))

    def put(self, **values: object) -> None:
        for key, value in values.items():
            self._file.line(f"{time.time() - self._began:.3f}\t{key}={escaped(str(value))}")

    def close(self, status: str, exit_code: int) -> None:
        self.put(status=status, exit_code=exit_code)
        self._file.close()
