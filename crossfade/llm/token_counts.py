"""Token totals by source, language and tokenizer version, kept by signed deltas.

A ``TokenRollup`` is a folder of batches and a log of commits. A batch turns
inserts, deletes and revised counts into signed entries against what the
ledger holds for the same document and version, and sums them by group. Its
files stand in a folder of its own that nobody reads, until a commit names it:
one small file, called by the sequence number alone, that is made only if no
other writer has made it. So a batch is there as a whole or not at all, a
repeated batch changes nothing, and of two writers at one number one goes on
to the next.

Entries lie in buckets of a hash of their key, and a batch reads the buckets
that it touches. Every so many commits one also writes the ledger and the
totals anew, so that what a batch reads follows the live documents of its
buckets, not the history.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, drop_path, give_back, new_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before merges, as the vocabulary's documentation gives it (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GROUP = ("source", "lang", "version")
_KEY = ("doc_id", "version")
_ENTRY = "doc_id long, version string, source string, lang string, n_tokens long, alive boolean, seq long, bucket int"
_DELTA = "source string, lang string, version string, d_docs long, d_tokens long"
BUCKETS = 32  # of the ledger, by a hash of document and version; fixed for a folder by its first commit
FILE_ROWS = 2_000_000  # rows of a ledger file, about; a bucket of more has several, each of which is a task's work
COMPACT_EVERY = 8  # commits after which the ledger and the totals are written anew


@lru_cache(4)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, version: str = "byte-bpe-50k", words_version: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, version, n_tokens, copy): two rows per document, one of byte-pair tokens, one of words split at blanks.

    Ids must be whole numbers. Whole texts are encoded; null counts as empty and has 0 tokens. ``copy`` is
    a digest of the text, equal for exact copies. Missing columns ``source``
    and ``lang`` count as null.
    """

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary)
        for batch in batches:
            counts = []
            for t in batch.column(4):
                text = t.as_py() or ""
                counts.append([{"version": version, "n_tokens": len(enc.encode_ordinary(text))}, {"version": words_version, "n_tokens": len(text.encode().split())}])
            kind = pa.list_(pa.struct([("version", pa.string()), ("n_tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, kind)], ["doc_id", "source", "lang", "copy", "counts"])

    given = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in GROUP[:2]]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *given, F.sha2(F.coalesce(text, F.lit("")), 256).alias("copy"), text.alias("text"))
    out = rows.mapInArrow(scan, "doc_id long, source string, lang string, copy string, counts array<struct<version:string,n_tokens:long>>")
    return out.select("doc_id", "source", "lang", "copy", F.inline("counts"))


class TokenRollup:
    """Rollup state in ``path``, a folder that driver and executors share.

    Commits are atomic where the file system renames without overwriting in
    one step (HDFS and the like), or makes hard links (a local or mounted disk).
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or new_path(spark, "token-rollup")
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # the log

    def _record(self, seq: int) -> str:
        return f"{self.path}/commits/{seq:09d}"

    def _read_record(self, seq: int) -> dict:
        stream = self._fs.open(self._path(self._record(seq)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _log(self) -> tuple[list[dict], int]:
        """The last compacted commit and those after it, oldest first, and the next sequence number."""
        folder = self._path(f"{self.path}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        count = len([n for n in names if re.fullmatch(r"\d{9}", n)])
        return [self._read_record(i) for i in range(max(0, count // COMPACT_EVERY * COMPACT_EVERY - 1), count)], count

    def batches(self) -> list[str]:
        """Committed batches, oldest first."""
        return [self._read_record(i)["batch"] for i in range(self._log()[1])]

    def _marker(self, batch_id: str):
        return self._path(f"{self.path}/batches/{batch_id}")

    def _mark(self, log: list[dict]) -> None:
        """A file by the name of each of the log's batches; without it a batch is known by its record alone."""
        for record in log:
            if not self._fs.exists(self._marker(record["batch"])):
                self._fs.create(self._marker(record["batch"]), True).close()

    def _known(self, batch_id: str, log: list[dict]) -> bool:
        return any(r["batch"] == batch_id for r in log) or self._fs.exists(self._marker(batch_id))

    def _claim(self, seq: int, record: dict) -> bool:
        """Make the commit file of ``seq``, whole, unless it is there already."""
        target = self._path(self._record(seq))
        aside = self._path(f"{self.path}/aside/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: self._jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.String, 0))
                self._jvm.java.nio.file.Files.createLink(local(target), local(aside))
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(aside, target, none)
            return True
        except Py4JJavaError:
            if not self._fs.exists(target):
                raise
            return False
        finally:
            self._fs.delete(aside, False)

    # tables

    def _parts(self, log: list[dict], whole: str, part: str, schema: str) -> DataFrame:
        """The compacted table of the log's first commit, if it has one, and the parts of all others."""
        compacted = bool(log) and log[0]["compacted"]
        paths = [f"{self.path}/data/{r['folder']}/{whole if compacted and not i else part}" for i, r in enumerate(log)]
        # a part of no rows has no files
        paths = [p for p in paths if self._fs.exists(self._path(p))]
        out = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], schema)

    def _ledger(self, log: list[dict], buckets: list[int] | None = None) -> DataFrame:
        rows = self._parts(log, "base", "ledger", _ENTRY)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        last = rows.groupBy(*_KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens", "alive", "bucket"), "seq").alias("s"))
        return last.where("s.alive").select(*_KEY, "s.source", "s.lang", "s.n_tokens", "s.bucket")

    def ledger(self) -> DataFrame:
        """(doc_id, version, source, lang, n_tokens): what each live document counts now."""
        return self._ledger(self._log()[0]).drop("bucket")

    def _totals(self, log: list[dict]) -> DataFrame:
        rows = self._parts(log, "totals", "delta", _DELTA)
        return rows.groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).where("d_docs <> 0 or d_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches; groups that have come to nothing are left out."""
        return self._totals(self._log()[0]).withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"})

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, version, source, lang, n_tokens) once; False if the batch is there already.

        op is ``insert`` or ``revise`` (either sets the count, replacing one the
        ledger holds) or ``delete`` (the other columns don't matter; of an
        unknown document nothing happens). Rows without an id, a version or a
        known op are ignored, a null count is 0. Of rows with one id and
        version in a batch a delete wins, else the largest count, then source
        and language. Columns beyond these are ignored, and an empty batch is a
        batch. If another writer commits meanwhile, the batch is worked out
        anew against what is there then.
        """
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        scratch = Scratch(self.spark)
        new = None
        while True:
            log, seq = self._log()
            if self._known(batch_id, log):
                scratch.clear()
                return False
            if new is None:
                new, touched = self._prepared(changes, log[0]["buckets"] if log else BUCKETS, scratch)
            folder = uuid.uuid4().hex
            record = {"batch": batch_id, "folder": folder, "buckets": log[0]["buckets"] if log else BUCKETS, "compacted": (seq + 1) % COMPACT_EVERY == 0}
            self._write(f"{self.path}/data/{folder}", new, touched, log, record, seq)
            if self._claim(seq, record):
                scratch.clear()
                return True
            drop_path(self.spark, f"{self.path}/data/{folder}")

    def _prepared(self, changes: DataFrame, buckets: int, scratch: Scratch) -> tuple[DataFrame, list[int] | None]:
        """One row per key of a batch, written, and the buckets it touches (None: all)."""
        rows = changes.where(F.col("op").isin("insert", "revise", "delete") & F.col("doc_id").isNotNull() & F.col("version").isNotNull())
        rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "version", F.struct((F.col("op") == "delete").alias("gone"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), "source", "lang").alias("new"))
        bucket = F.pmod(F.xxhash64(*_KEY), F.lit(buckets)).cast("int")
        new = scratch.table(rows.groupBy(*_KEY).agg(F.max("new").alias("new")).withColumn("bucket", bucket), "batch")
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        return new, touched if len(touched) < buckets else None

    def _write(self, to: str, new: DataFrame, touched: list[int] | None, log: list[dict], record: dict, seq: int) -> None:
        """The files of a batch: its entries, its deltas, and where it is due the compacted ledger and totals."""
        old = self._ledger(log, touched).select(*_KEY, F.struct("source", "lang", "n_tokens").alias("old"))
        both = new.join(old, list(_KEY), "left").where("not new.gone or old is not null")
        entry = both.select(
            *_KEY,
            F.when(F.col("new.gone"), F.col("old.source")).otherwise(F.col("new.source")).alias("source"),
            F.when(F.col("new.gone"), F.col("old.lang")).otherwise(F.col("new.lang")).alias("lang"),
            F.when(F.col("new.gone"), F.lit(0).cast("long")).otherwise(F.col("new.n_tokens")).alias("n_tokens"),
            (~F.col("new.gone")).alias("alive"),
            F.lit(seq).cast("long").alias("seq"),
            F.col("old"),
            F.col("bucket"),
        )
        # sorted by bucket, a task writes a file for each bucket that it holds; filters on the bucket skip whole files
        self._dealt(entry, new.count(), record).write.partitionBy("bucket").parquet(f"{to}/ledger")
        back = self.spark.read.schema(_ENTRY + ", old struct<source:string,lang:string,n_tokens:long>").parquet(f"{to}/ledger")
        plus = F.struct("source", "lang", "version", F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        minus = F.struct(F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), "version", F.lit(-1).cast("long").alias("d_docs"), (-F.col("old.n_tokens")).alias("d_tokens"))
        signed = back.select(F.inline(F.filter(F.array(F.when(F.col("alive"), plus), F.when(F.col("old").isNotNull(), minus)), lambda x: x.isNotNull())))
        signed.groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).coalesce(1).write.parquet(f"{to}/delta")
        if record["compacted"]:
            after = [*log, record | {"compacted": False}]
            whole = self._ledger(after).select(*_KEY, "source", "lang", "n_tokens", F.lit(True).alias("alive"), F.lit(seq).cast("long").alias("seq"), "bucket")
            totals = self._totals(after)
            totals.coalesce(1).write.parquet(f"{to}/totals")
            size = self.spark.read.schema(totals.schema).parquet(f"{to}/totals").agg(F.sum("d_docs")).first()[0] or 0
            self._dealt(whole, size, record).write.partitionBy("bucket").parquet(f"{to}/base")
            # whoever reads the log from this record on no longer sees the ones before it
            self._mark(log)

    def _dealt(self, rows: DataFrame, size: int, record: dict) -> DataFrame:
        """Rows by bucket, each bucket to as many tasks and files as the number of rows asks for."""
        shares = -(-size // (record["buckets"] * FILE_ROWS)) or 1
        return rows.repartition("bucket", F.pmod(F.hash(*_KEY), F.lit(shares)))
