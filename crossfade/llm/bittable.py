"""A broadcast bit table of keys, of bounded size, that keeps most rows out of a shuffle.

A row whose bit is not set surely has none of the keys; the others go through
an exact join. Beyond the bound the table fills up and lets more rows pass to
the join; results never depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns_of, free_name, give_back

MAX_BITS = 1 << 26  # 8 MB


def build(ids: DataFrame, column: str):
    """A broadcast of the table of hashes of ``column``; at least 16 bits an id up to the bound."""
    bits, n = 1 << 16, ids.count()
    while bits < 16 * n and bits < MAX_BITS:
        bits <<= 1
    word = F.shiftrightunsigned(F.xxhash64(column), 6).bitwiseAND(F.lit(bits // 64 - 1))
    one = F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))")
    rows = ids.groupBy(word.alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(table)


def sift(df: DataFrame, key: Column, sent, found: bool, always: Column | None = None) -> DataFrame:
    """Rows of ``df`` whose key's bit is set (``found``), or isn't; rows where ``always`` holds count as not set."""
    h = F.xxhash64(key)
    hashed = h if always is None else F.when(~always, h)

    names = df.columns

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            h = column.fill_null(0).to_numpy().view(np.uint64)
            hit = (table[(h >> np.uint64(6)) & np.uint64(len(table) - 1)] >> (h & np.uint64(63))) & np.uint64(1)
            hit = (hit == 1) & column.is_valid().to_numpy(zero_copy_only=False)
            yield batch.select(list(range(batch.num_columns - 1))).rename_columns(names).filter(pa.array(hit == found))

    # under plain names, for Spark would read a dot or a backtick in a name as syntax
    plain = df.select("*", hashed.alias(free_name(df, "bit_hash"))).toDF(*[f"c{i}" for i in range(len(names) + 1)])
    return plain.mapInArrow(scan, df.schema)


def settle(df: DataFrame, key: Column, marks: DataFrame, always: Column | None = None) -> DataFrame:
    """``df`` after ``marks`` (mark, keep; one row per mark): of rows whose key is a mark none stay, or one with ``keep``.

    Rows of other keys, or of none, stay as they are, as do those where
    ``always`` holds. Only rows that may have a mark are shuffled, with the
    marks, for the exact answer.
    """
    sent = build(marks, "mark")
    mark = free_name(df, "mark")
    keep = free_name(df, "keep")
    marks = marks.select(F.col("mark").alias(mark), F.col("keep").alias(keep))
    maybe = sift(df, key, sent, True, always).withColumn(mark, key)
    out = sift(df, key, sent, False, always).unionByName(maybe.join(marks, mark, "left_anti").select(*columns_of(df)))
    kept = marks.where(keep)
    if kept.isEmpty():
        return out
    # copies meet in part before the shuffle, however many there are
    return out.unionByName(maybe.join(kept, mark).dropDuplicates([mark]).select(*columns_of(df)))


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``column`` is in ``gone`` (one column of distinct values, the same type); a null stays."""
    return settle(df, F.col(column), gone.select(F.col(gone.columns[0]).alias("mark"), F.lit(False).alias("keep")))
