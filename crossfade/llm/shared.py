"""Where intermediate tables go, what may be kept meanwhile, and giving it back."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs in
    one process; on a cluster a session without one is refused, for its
    machines would each write to a disk of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="crossfade-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, through Hadoop so that any file system works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that a task writes, where a bound on their number is known: of a few numbers each, of a few hundred bytes, of whole sets of a document.
NARROW, MIDDLE, WIDE = 200_000, 10_000, 2_000

#: On a mounted disk Hadoop would keep a second file of checksums for each, and start a process for each file to set its mode.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_table(df: DataFrame, path: str, rows: int | None = None, per_task: int = NARROW) -> DataFrame:
    """Write ``df`` as Parquet and read it back; with a bound on its rows, by no more tasks than they need."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_task)))
    df.write.options(**_PLAIN_FILES if path.startswith("file:") else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, rows: int | None = None, per_task: int = NARROW) -> DataFrame:
    """``write_table`` into the shared folder.

    This cuts the lineage with files that outlive any executor.
    """
    return write_table(df, new_path(df.sparkSession, name), rows, per_task)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so once the driver has collected them, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables and broadcasts of a computation that go once its result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.sent = spark, [], []

    def table(self, df: DataFrame, name: str, rows: int | None = None, per_task: int = NARROW) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return write_table(df, self.paths[-1], rows, per_task)

    def broadcast(self, sent):
        """``sent``, destroyed with the tables."""
        self.sent.append(sent)
        return sent

    def clear(self) -> None:
        while self.sent:
            self.sent.pop().destroy()
        while self.paths:
            drop_path(self.spark, self.paths.pop())


def give_back(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``scan``, after which a worker returns its freed memory to the machine: workers are used again and would keep their peak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every C library has it
                pass

    return run
