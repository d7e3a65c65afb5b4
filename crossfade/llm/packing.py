"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents longer than a bin are cut into pieces. Rows are dealt by a hash into
shards of bounded size, which are packed side by side, longest piece first:
open bins are kept in the order of what is left in them, each with a bitmap of
the sources and one of the duplicate clusters it holds, and the search goes on
from the tightest bin that fits to the next until a compatible one is found.
No bin holds two documents of one source, or two of one duplicate cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, materialize
from .textcols import BLANK_SPLIT, buffers, chunks, mix, scan_words

SHARD_PIECES = 4096  # about as many pieces are packed in one task


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_words, cluster): words split at blanks, and a digest of the lower-cased word sequence.

    Texts that differ only in blanks or in the case of A-Z fall into one
    duplicate cluster. Null and empty texts have no words and no cluster;
    repeated rows are measured one by one; other columns are ignored.
    """

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            counts, digests = [], []
            for i, j in chunks(offsets):
                words, bounds = scan_words(data, offsets[i : j + 1], BLANK_SPLIT)
                n = np.diff(bounds)
                place = np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], n).astype(np.uint64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ mix(place + np.uint64(1))))])
                counts.append(n)
                digests.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            digests = np.concatenate(digests) if digests else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.int64(), mask=counts == 0)], ["doc_id", "source", "n_words", "cluster"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, source string, n_words long, cluster long")


class _Bitmaps:
    """One row of bits per bin; a member's bit is set in the bins that hold it."""

    def __init__(self, members: int) -> None:
        self.bits = np.zeros((64, members // 64 + 1), np.uint64)

    def grow(self, bins: int) -> None:
        if bins > len(self.bits):
            self.bits = np.vstack([self.bits, np.zeros_like(self.bits)])

    def has(self, bins: np.ndarray, member: int) -> np.ndarray:
        return (self.bits[bins, member >> 6] >> np.uint64(member & 63)) & np.uint64(1) == 1

    def set(self, b: int, member: int) -> None:
        self.bits[b, member >> 6] |= np.uint64(1) << np.uint64(member & 63)


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the given order; a code of -1 conflicts with nothing."""
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by_source, by_cluster = _Bitmaps(int(sources.max(initial=0)) + 1), _Bitmaps(int(clusters.max(initial=0)) + 1)
    left = np.zeros(n, np.int64)  # residuals of the open bins, ascending
    held = np.zeros(n, np.int64)  # the bins that have them
    count = used = 0
    for i in range(n):
        size, source, cluster = int(sizes[i]), int(sources[i]), int(clusters[i])
        at = int(np.searchsorted(left[:count], size))
        found = -1
        while at < count and found < 0:  # successors, a block at a time
            some = held[at : min(at + 256, count)]
            ok = np.ones(len(some), bool)
            if source >= 0:
                ok &= ~by_source.has(some, source)
            if cluster >= 0:
                ok &= ~by_cluster.has(some, cluster)
            first = int(ok.argmax())
            if ok[first]:
                found = at + first
            at += len(some)
        if found >= 0:
            b, room = int(held[found]), int(left[found])
            left[found : count - 1] = left[found + 1 : count]
            held[found : count - 1] = held[found + 1 : count]
            count -= 1
        else:
            b, room = used, capacity
            used += 1
            by_source.grow(used)
            by_cluster.grow(used)
        bins[i], offsets[i] = b, capacity - room
        if source >= 0:
            by_source.set(b, source)
        if cluster >= 0:
            by_cluster.set(b, cluster)
        room -= size
        if room:
            at = int(np.searchsorted(left[:count], room, "right"))
            left[at + 1 : count + 1] = left[at:count]
            held[at + 1 : count + 1] = held[at:count]
            left[at], held[at] = room, b
            count += 1
    return bins, offsets


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, -1 for null."""
    return pc.fill_null(pc.index_in(values, pc.unique(pc.drop_null(values))), -1).to_numpy().astype(np.int64)


def pack(measured: DataFrame, capacity: int = 1024, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Place every piece of every document of ``measured`` (doc_id, source, n_words, cluster).

    Returns doc_id, source, cluster, piece (from 0), start (first word of the
    piece), n_words, shard, bin (in its shard, from 0) and offset (in its bin).
    Pieces of a document conflict with one another. Rows of no words are
    returned once, with a null bin; a null count is none. A null source and a
    null cluster conflict with nothing; repeated rows conflict as copies do.
    Bins of different shards never mix, so a document's place depends on its
    own shard only. Rows are dealt by their place in the input, so that no
    group of equal rows, however large, meets in one shard; the same table read
    in other splits is dealt, and so packed, otherwise. Other columns are ignored.
    """
    kind = dict(measured.dtypes)["doc_id"]
    words = F.coalesce(F.col("n_words"), F.lit(0)).cast("long")
    n = F.greatest(F.ceil(words / F.lit(capacity)), F.lit(1)).cast("int")
    pieces = measured.select("doc_id", "source", "cluster", words.alias("total"), F.monotonically_increasing_id().alias("row"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("doc_id", "source", "cluster", "row", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(capacity).cast("long")).alias("n_words"))
    count = measured.agg(F.sum(n.cast("long"))).first()[0] or 0
    shards = max(1, -(-count // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def place(rows: pa.Table) -> pa.Table:
        # Arrow all the way: a digest of 64 bits doesn't survive as a float, which pandas makes of longs beside a null
        rows = rows.sort_by([("n_words", "descending"), ("row", "ascending"), ("piece", "ascending")])
        some = rows.filter(pc.greater(rows["n_words"], 0))
        cluster = _codes(some["cluster"])
        # a document without a cluster still conflicts with its own pieces: by its row
        alone = cluster < 0
        cluster[alone] = cluster.max(initial=-1) + 1 + np.unique(some["row"].to_numpy()[alone], return_inverse=True)[1]
        bins, offsets = best_fit(some["n_words"].to_numpy(), _codes(some["source"]), cluster, capacity)
        # pieces with words come first, as they are the longest
        pad = pa.nulls(rows.num_rows - some.num_rows, pa.int64())
        rows = rows.append_column("bin", pa.chunked_array([pa.array(bins, pa.int64()), pad])).append_column("offset", pa.chunked_array([pa.array(offsets, pa.int64()), pad]))
        return rows.select(["doc_id", "source", "cluster", "piece", "start", "n_words", "shard", "bin", "offset"])

    return dealt.groupBy("shard").applyInArrow(place, f"doc_id {kind}, source string, cluster long, piece int, start long, n_words long, shard long, bin long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``pack`` of the measured documents; see there and ``measure``."""
    return pack(materialize(measure(docs, id_col, text_col, source_col), "measured"), capacity)
