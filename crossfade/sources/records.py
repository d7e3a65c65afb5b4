"""Records of CSV files read in splits, whatever line breaks their quotes hold.

A line alone doesn't tell whether it begins inside quotes. But what it does to
a reader is a function of two states, outside and inside, and such functions
compose: a first pass gives each split's, their composition along a file the
state that each split begins in. A second pass cuts records from sure starts.
A record that goes on beyond its split is put together from its parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SPAN = 44  # bits of a place that count the bytes of a file: 16 TB


def _closes(line: str, at: int) -> int:
    """The place behind the delimiter that ends a quoted field whose text goes on at ``at``; -1 if it goes on beyond the line, -2 if it ends the line."""
    while True:
        quote = line.find('"', at)
        if quote < 0:
            return -1
        if line[quote + 1 : quote + 2] == '"':  # a doubled quote is text
            at = quote + 2
            continue
        comma = line.find(",", quote + 1)
        return comma + 1 if comma >= 0 else -2


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open at a line's end, from whether they are at its start. Only at a field's start does a quote open one."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        at = _closes(line, 0)
        if at < 0:
            return at == -1
    while True:
        if line[at : at + 1] == '"':
            at = _closes(line, at + 1)
            if at < 0:
                return at == -1
        else:
            comma = line.find(",", at)
            if comma < 0:
                return False
            at = comma + 1


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with file, block (where the split begins in it); each split's are together and in order."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.coalesce("value", F.lit("")).alias("line"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[tuple[int, str]]]]:
    """Splits of a partition: file, block, and an iterator of (place in the file about, line)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    row = next(rows, None)
    while row is not None:
        file, block, _ = row
        after = []

        def own(first=row, file=file, block=block, after=after):
            # bytes up to a line, from where the split begins: in order, and below those of the next split, which
            # leaves the line out that it begins in, of one byte at least
            now, place = first, block + (block > 0)
            while now is not None and now[:2] == (file, block):
                yield place, now[2]
                place += len(now[2].encode("utf-8", "surrogatepass")) + 1
                now = next(rows, None)
            after.append(now)

        lines = own()
        yield file, block, lines
        for _ in lines:
            pass
        row = after[0]


_STATES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("out_end", pa.bool_()), ("in_end", pa.bool_()), ("out_last", pa.int64()), ("in_last", pa.int64())])
_STATES_DDL = "file string, block long, out_end boolean, in_end boolean, out_last long, in_last long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, for a start outside and inside of quotes: whether its end is inside, and where its last record begins (null: before it)."""
    for file, block, lines in _splits(batches):
        ends, lasts = [False, True], [None, None]
        for place, line in lines:
            for k in (0, 1):
                if not ends[k]:
                    lasts[k] = place
                ends[k] = ends_inside(line, ends[k])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, block, *ends, *lasts), _STATES.types)], schema=_STATES)


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits of files in order to those that begin inside quotes: file, block, and where the record that goes on began."""
    now, inside, last = None, False, None
    for batch in batches:
        out = []
        for file, block, out_end, in_end, out_last, in_last in zip(*(c.to_pylist() for c in batch.columns)):
            if file != now:
                now, inside, last = file, False, None
            if inside:
                out.append((file, block, last))
            began = in_last if inside else out_last
            inside, last = (in_end if inside else out_end), (last if began is None else began)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "block", "began"])


def records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, place, record) of CSV files: whole records as text, headers among them, and the place in its file that each begins at, about.

    Places are in order and differ within a file, however it is split. Splits
    that begin inside quotes, one in very many, are named to all tasks: at
    most one row for each split, of which the driver keeps track anyway.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    states = _lines(spark, paths).mapInArrow(_survey, _STATES_DDL)
    states = states.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_compose, "file string, block long, began long")
    begun = {(r.file, r.block): r.began for r in states.collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, lines in _splits(batches):
            began = begun.get((file, block))
            inside, parts, out, size = began is not None, [], [], 0
            whole = not inside
            for place, line in lines:
                if not inside:
                    began, whole = place, True
                parts.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    out.append((file, began, block, whole, "\n".join(parts)))
                    size += len(out[-1][-1])
                    parts = []
                if size > 1 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if parts:  # goes on in the next split
                out.append((file, began, block, False, "\n".join(parts)))
            if out:
                yield _batch(out)

    found = _lines(spark, paths).mapInArrow(cut, "file string, place long, block long, whole boolean, record string")
    parts = found.where("not whole").groupBy("file", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n").alias("record"))
    return found.where("whole").select("file", "place", "record").unionByName(parts) if begun else found.select("file", "place", "record")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "place", "block", "whole", "record"])


def csv_table(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], order: str | None = None) -> DataFrame:
    """The files' rows with all columns as strings; ``order`` names a column for their place as read: by file, then by place in it.

    Each file's first record is its header. Empty lines are no rows. Fields
    that a record lacks are null, more than there are columns are left out.
    """
    rows = records(spark, paths)
    text = F.regexp_replace(F.regexp_replace("record", "\r\n", "\n"), "\r\\z", "")
    rows = rows.where("place > 0").withColumn("record", text).where("record <> ''")
    kind = ", ".join(f"c{i} string" for i in range(len(columns)))
    parsed = F.from_csv("record", kind, {"quote": '"', "escape": '"'})
    rows = rows.select("file", "place", parsed.alias("r"))
    fields = [F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)]
    if order is None:
        return rows.select(*fields)
    # the files as the reader lists them, by name; the driver has that list anyway
    files = {f: n for n, f in enumerate(sorted(r.file for r in _lines(spark, [paths] if isinstance(paths, str) else paths).select("file").distinct().collect()))}
    nth = F.element_at(F.create_map(*[F.lit(x) for pair in files.items() for x in pair]), F.col("file")) if len(files) > 1 else F.lit(0)
    place = F.when(F.col("place") < 1 << FILE_SPAN, F.shiftleft(nth.cast("long"), FILE_SPAN) + F.col("place")).otherwise(F.raise_error(F.lit("a file is too long to number its rows")).cast("long"))
    return rows.select(*fields, place.alias(order))
