"""Benchmark decontamination by n-gram windows.

The benchmark's items are cut into windows where they lie, and distinct windows
become a table. They go to the executors as a sorted table of 64-bit hashes
with the normalised windows behind them. Training texts are hashed in Arrow
batches; a bit table passes few windows on, and each hit is confirmed on its
words. Windows beyond the broadcast bound go in slices, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bittable import without
from .shared import Scratch, columns_of, free_name, give_back, materialize
from .textcols import ALNUM_SPLIT, ALNUM_TRANSLATE, buffers, chunks, mix, scan_words

BROADCAST_BYTES = 12 << 20  # windows in one broadcast, some 60 MB in a worker; more go in slices
_BATCH_WINDOWS = 20_000
_STEP = np.uint64(0xA0761D6478BD642F)
_BITS = 22


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ALNUM_TRANSLATE).split()


class Windows:
    """Distinct windows of benchmark items, each with the items that hold it."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]) -> None:
        self.ids = sorted({i for _, items in windows for i in items})
        number = {x: i for i, x in enumerate(self.ids)}
        self.holders = {bytes(w): tuple(sorted(number[i] for i in items)) for w, items in windows}
        self.hashes: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}
        by_size: dict[int, list[bytes]] = {}
        for w in self.holders:
            by_size.setdefault(w.count(b" ") + 1, []).append(w)
        for size, windows in by_size.items():
            column = pa.array([w.decode() for w in windows], pa.large_string())
            data, offsets = buffers(column)
            words, _ = scan_words(data, offsets, ALNUM_SPLIT)
            self.hashes[size] = np.unique(self.roll(words, size)[::size])
            self.bits[size] = np.zeros(1 << _BITS, bool)
            self.bits[size][self.hashes[size] >> np.uint64(64 - _BITS)] = True

    @staticmethod
    def roll(words: np.ndarray, size: int) -> np.ndarray:
        """A hash of each ``size`` consecutive words."""
        n = max(len(words) - size + 1, 0)
        out = np.zeros(n, np.uint64)
        for k in range(size if n else 0):
            out = out * _STEP + words[k : k + n]
        return mix(out)

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Window size and starts (indexes into ``words``) that match by hash and stay in a document."""
        ends = np.repeat(bounds[1:], np.diff(bounds))
        for size, known in self.hashes.items():
            rolled = self.roll(words, size)
            maybe = np.flatnonzero(self.bits[size][rolled >> np.uint64(64 - _BITS)])
            at = np.minimum(np.searchsorted(known, rolled[maybe]), len(known) - 1)
            maybe = maybe[known[at] == rolled[maybe]]
            maybe = maybe[maybe + size <= ends[maybe]]
            if len(maybe):
                yield size, maybe


def _scan(column: pa.Array, windows: Windows) -> Iterator[tuple[int, list[tuple[int, int]], set[int], list[tuple[int, int]]]]:
    """For each text: its number of words, its hit runs as word ranges, the items found, and the runs as byte ranges."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        words, bounds, first, last = scan_words(data, offsets[i : j + 1], ALNUM_SPLIT, spans=True)
        found: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for size, starts in windows.hits(words, bounds):
            owners = np.searchsorted(bounds, starts, "right") - 1
            for s, d in zip(starts.tolist(), owners.tolist(), strict=True):
                text = bytes(data[first[s] : last[s + size - 1]]).translate(ALNUM_TRANSLATE)
                holders = windows.holders.get(b" ".join(text.split()))
                if holders:
                    found.setdefault(d, []).append((s, s + size))
                    items.setdefault(d, set()).update(holders)
        for d in range(j - i):
            lo = int(bounds[d])
            runs: list[list[int]] = []
            for a, b in sorted(found.get(d, ())):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            cut = [(int(first[a] - offsets[i + d]), int(last[b - 1] - offsets[i + d])) for a, b in runs]
            yield int(bounds[d + 1]) - lo, [(a - lo, b - lo) for a, b in runs], items.get(d, set()), cut


def _windows(benchmark: DataFrame, id_col: str, text_col: str, n: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """A table of the distinct windows (w) and the ids of the items that hold each (items), and into how many slices it goes."""

    @give_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(text.as_py())
                size = min(n, len(words))
                count = len(words) - size + 1 if size else 0
                for lo in range(0, count, _BATCH_WINDOWS):
                    some = list({b" ".join(words[k : k + size]) for k in range(lo, min(lo + _BATCH_WINDOWS, count))})
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([i] * len(some))], ["w", "i"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    table = scratch.table(rows.mapInArrow(cut, "w binary, i string").groupBy("w").agg(F.array_sort(F.collect_set("i")).alias("items")), "windows")
    size = F.octet_length("w") + F.aggregate("items", F.lit(0), lambda a, i: a + F.octet_length(i) - F.octet_length(F.col("items")[0]))
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return table, max(1, -(-total // BROADCAST_BYTES))


def _slice(table: DataFrame, k: int, parts: int):
    """The broadcast of one slice."""
    rows = table if parts == 1 else table.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == k)
    return table.sparkSession.sparkContext.broadcast(Windows([(r.w, r["items"]) for r in rows.collect()]))


_ENDS = ("a", "b", "first", "last")  # of a run: words, then bytes
_RUNS = f"array<struct<{','.join(f'{c}:long' for c in _ENDS)}>>"
_RUNS_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in _ENDS]))


def _merged(runs: Column) -> Column:
    """Sorted runs, those whose words touch as one."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    joined = lambda acc, r: F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], r["b"]).alias("b"), last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], r["last"]).alias("last"))
    return F.aggregate(
        runs,
        F.array().cast(_RUNS),
        lambda acc, r: F.when(
            F.coalesce(last(acc)["b"], F.lit(-1)) >= r["a"],
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined(acc, r))),
        ).otherwise(F.concat(acc, F.array(r))),
    )


def _found_with(windows, at_id: int, at_text: int, every: bool):
    """A scan for (id, n_words, runs, items) of each text, or of those with a hit."""

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for batch in batches:
            got = [(i, g) for i, g in enumerate(_scan(batch.column(at_text), w)) if every or g[1]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(at_id).take(pa.array([i for i, _ in got], pa.int64())),
                    pa.array([g[0] for _, g in got], pa.int64()),
                    pa.array([[dict(zip(_ENDS, (*words, *place), strict=True)) for words, place in zip(g[1], g[3], strict=True)] for _, g in got], _RUNS_ARROW),
                    pa.array([[w.ids[x] for x in sorted(g[2])] for _, g in got], pa.list_(pa.string())),
                ],
                ["id", "n_words", "runs", "items"],
            )

    return scan


def _hits(numbered: DataFrame, row: str, text_col: str, table: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """(id, runs, items) of the rows with a hit, from all slices, each sent out once the one before has gone."""
    text = F.col(text_col).cast("string")
    out = []
    for k in range(parts):
        sent = _slice(table, k, parts)
        out.append(scratch.table(numbered.select(row, text).mapInArrow(_found_with(sent, 0, 1, False), f"id long, n_words long, runs {_RUNS}, items array<string>"), "hits"))
        sent.destroy()
    whole = reduce(DataFrame.union, out).groupBy("id").agg(*[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("runs", "items")])
    return whole.select("id", _merged(F.col("runs")).alias("runs"), F.array_distinct("items").alias("items"))


def _numbered(df: DataFrame, row: str) -> DataFrame:
    """``df`` with a number for each row, written, so that every scan sees the same numbers."""
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered")


def overlaps(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, runs (hit word ranges, end exclusive), items (found item ids as sorted strings).

    A window is ``n`` consecutive words of an item; an item of fewer words, but
    not none, is one window. Null and empty texts have no words and no hits;
    a null item id is the empty string; repeated items count once, repeated
    documents are rows of their own. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    places = lambda runs: F.transform(runs, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"))).alias("runs")
    scratch = Scratch(docs.sparkSession)
    table, parts = _windows(benchmark, item_id, item_text, n, scratch)
    if parts == 1:
        sent = _slice(table, 0, 1)
        scratch.clear()
        found = rows.mapInArrow(_found_with(sent, 0, 1, True), f"id {kind}, n_words long, runs {_RUNS}, items array<string>")
        return found.select(F.col("id").alias("doc_id"), "n_words", places(F.col("runs")), "items")
    rows = _numbered(rows, "row")
    hits = materialize(_hits(rows, "row", "text", table, parts, scratch), "hits-of-all")
    scratch.clear()
    none = docs.sparkSession.sparkContext.broadcast(Windows([]))
    counted = rows.select(F.struct("doc_id", "row").alias("id"), "text").mapInArrow(_found_with(none, 0, 1, True), f"id struct<doc_id:{kind},row:long>, n_words long, runs {_RUNS}, items array<string>")
    out = counted.select("id.doc_id", "id.row", "n_words").join(hits.withColumnRenamed("id", "row"), "row", "left")
    return out.select("doc_id", "n_words", places(F.coalesce("runs", F.array().cast(_RUNS))), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without byte ranges, each of which leaves a blank."""
    raw, kept, p = text.encode(), [], 0
    for a, b in spans:
        kept.append(raw[p:a])
        p = b
    return b" ".join([*kept, raw[p:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "drop", n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, with all its columns, without contaminated documents (``drop``) or without hit spans (``spans``).

    A span is cut from its first to its last word and leaves one blank. Rows
    without a hit come back unchanged, null and empty texts included; repeated
    rows are judged one by one; other columns may have any name. An empty
    benchmark leaves all rows.
    """
    if mode not in ("drop", "spans"):
        raise ValueError(f"unknown mode: {mode}")
    scratch = Scratch(docs.sparkSession)
    table, parts = _windows(benchmark, item_id, item_text, n, scratch)
    at = docs.columns.index(text_col)
    if parts > 1:
        row, cut = free_name(docs, "row"), free_name(docs, "cut")
        numbered = _numbered(docs, row)
        hits = materialize(_hits(numbered, row, text_col, table, parts, scratch), "hits-of-all")
        scratch.clear()
        clean = without(numbered, row, hits.select("id")).select(*columns_of(docs))
        if mode == "drop":
            return clean
        hit = numbered.join(hits.select(F.col("id").alias(row), F.col("runs").alias(cut)), row).select(*columns_of(docs), cut)

        names = docs.columns

        @give_back
        def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = batch.columns[:-1]
                texts = [_without_spans(t, [(r["first"], r["last"]) for r in runs]) for t, runs in zip(columns[at].to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return clean.unionByName(hit.mapInArrow(shorten, docs.schema))
    windows = _slice(table, 0, 1)
    scratch.clear()

    @give_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for batch in batches:
            column = batch.column(at)
            found = [(i, g[3]) for i, g in enumerate(_scan(column, w)) if g[3]]
            if mode == "drop":
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in found]] = False
                yield batch.filter(pa.array(keep))
                continue
            texts = column.to_pylist()
            for i, spans in found:
                texts[i] = _without_spans(texts[i], spans)
            columns = batch.columns
            columns[at] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(cut, docs.schema)
