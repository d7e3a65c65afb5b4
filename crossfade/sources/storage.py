"""Files next to tables, on whatever file system Spark writes to.

Paths without a scheme are those of the default file system. All access goes
through Hadoop's file systems, so that driver and executors see one folder.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that Hadoop unpacks as it reads lines.
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def uri_of(spark: SparkSession, path: str) -> str:
    """A path with its file system.

    One without a scheme belongs to the default file system; where that is each
    machine's own disk it is refused on a cluster, for driver and executors
    would not see the same files there.
    """
    if "://" in path or path.startswith("file:/"):
        return path.rstrip("/") or path
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        return fs.makeQualified(sc._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or path)).toString()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError(f"name the file system of {path!r}: the default one is each machine's own disk")
    return f"file://{os.path.abspath(path)}"


class Folder:
    """A folder, and what a publisher needs to do in it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self._jvm = spark, spark.sparkContext._jvm
        self.uri = uri_of(spark, path)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.uri).getFileSystem(self._conf)
        if self._fs.getScheme() == "file":
            # small files that others read: no second file of checksums beside each
            self._fs = self._fs.getRawFileSystem()

    def _at(self, uri: str):
        return self._jvm.org.apache.hadoop.fs.Path(uri)

    def of(self, name: str) -> str:
        """The URI of an entry."""
        return f"{self.uri}/{name}"

    def aside(self, name: str) -> str:
        """A hidden name that nobody else has."""
        return f".{name}-{uuid.uuid4().hex}.tmp"

    def there(self) -> bool:
        """Whether the path itself exists; it may be a file."""
        return self._fs.exists(self._at(self.uri))

    def make(self) -> None:
        self._fs.mkdirs(self._at(self.uri))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(self.of(name)))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(self.uri))) if self._fs.exists(self._at(self.uri)) else []

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(self.of(name)), True)

    def read(self, name: str) -> str | None:
        """The text of a small file, or None if there is none."""
        if not self.has(name):
            return None
        stream = self._fs.open(self._at(self.of(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A small file, replaced in one step."""
        aside = self.aside(name)
        self.make()
        stream = self._fs.create(self._at(self.of(aside)), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.move(aside, name, replace=True)

    def move(self, name: str, to: str, replace: bool = False) -> bool:
        """Rename an entry of this folder; False if ``to`` is there and may not be replaced."""
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.uri).toUri(), self._conf)
        try:
            context.rename(self._at(self.of(name)), self._at(self.of(to)), how)
        except Py4JJavaError:
            if replace or not self.has(to):
                self.drop(name)
                raise
            return False
        return True

    def status(self) -> tuple[str, int, int]:
        """Of the folder's own path, which may be a file: where it is, its size, and when it was changed."""
        s = self._fs.getFileStatus(self._at(self.uri))
        return s.getPath().toString(), s.getLen(), s.getModificationTime()

    def join(self, names: list[str], to: str, head: str = "") -> None:
        """One file of a text and the bytes of other files, in order, copied from stream to stream; it takes its name in one step."""
        aside = self.aside(to)
        out = self._fs.create(self._at(self.of(aside)), True)
        try:
            out.write(bytearray(head.encode()))
            for name in names:
                part = self._fs.open(self._at(self.of(name)))
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, COPIED, False)
                finally:
                    part.close()
        finally:
            out.close()
        self.move(aside, to, replace=True)

    def digests(self, pattern: str = "part-*") -> DataFrame:
        """(path, sha256) of the files in this folder, or of the file that it is, worked out by the executors.

        A file is read in splits, as lines, and passes through its digest in
        the order of its bytes: no row holds more than a line. Files with a
        name that Hadoop unpacks are read whole, and are refused from 2 GB on.
        """
        status = self._fs.getFileStatus(self._at(self.uri))
        reader = self.spark.read.option("recursiveFileLookup", "true")
        reader = reader if status.isFile() else reader.option("pathGlobFilter", pattern)
        names = [self.uri] if status.isFile() else self.names()
        if any(n.endswith(_PACKED) for n in names):
            return reader.format("binaryFile").load(self.uri).select("path", F.sha2("content", 256).alias("sha256"))
        lines = reader.option("lineSep", "\n").text(self.uri)
        meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_block_start")]
        lines = lines.select(*meta, F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("line"))
        lines = lines.repartition("file_path").sortWithinPartitions("file_path", "file_block_start", "n").drop("file_block_start", "n")
        return lines.mapInArrow(_digest, "path string, sha256 string")


COPIED = 1 << 20  # bytes that are copied at a time
_MARK = b"\xef\xbb\xbf"  # a byte order mark, which a line reader leaves out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of files in order to a digest for each file."""
    path, size, seen, digests = None, 0, 0, ()

    def done() -> pa.RecordBatch:
        missing = size - seen  # bytes that no line has shown
        if missing in (0, len(_MARK)):  # the last line has an end
            for d in digests:
                d.update(b"\n")
        said = digests[missing > 0].hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([said])], ["path", "sha256"])

    for batch in batches:
        for own, total, line in zip(*(c.to_pylist() for c in batch.columns)):
            if own == path:
                line = b"\n" + line
            else:
                if path is not None:
                    yield done()
                path, size, seen, digests = own, total, 0, (hashlib.sha256(), hashlib.sha256(_MARK))
            for d in digests:
                d.update(line)
            # with the end that each line but perhaps the last has
            seen += len(line) + (seen == 0)
    if path is not None:
        yield done()


def file_of(spark: SparkSession, path: str) -> tuple[Folder, str]:
    """The folder of a path, and the name in it."""
    head, _, name = path.rstrip("/").rpartition("/")
    return Folder(spark, head or ("/" if path.startswith("/") else ".")), name
