"""A fold in order, by segments that are composed as functions.

A track's duration is its first one, raised by each later one within the
tolerance of what it is by then. What a run of values does to any value before
it is a function: it lifts whole intervals to one value each and leaves the
rest alone. Runs are cut from the rows sorted by key and order, wherever they
lie, and only these functions are brought together, one for each run. A key's
rows are never gathered; a run's function has at most an interval for each
distinct duration in it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DURATION_TOLERANCE_MS


class Lift:
    """What values one after the other do to a value before them: intervals in order, and where each is lifted to."""

    def __init__(self, tolerance: int = DURATION_TOLERANCE_MS) -> None:
        self.tolerance = tolerance
        self.low: list[int] = []
        self.high: list[int] = []
        self.to: list[int] = []

    def then(self, d: int) -> None:
        """Also the value ``d``: all that is within the tolerance below it by now is lifted to it."""
        # the lift never falls and never lowers, so what it takes into [d - tolerance, d] is one interval
        i, j = bisect_left(self.to, d - self.tolerance), bisect_right(self.to, d)
        low, high = d - self.tolerance, d
        if i < j:
            low = min(low, self.low[i])
        if j < len(self.low):
            high = min(high, self.low[j] - 1)
        if low <= high:
            self.low[i:j], self.high[i:j], self.to[i:j] = [low], [high], [d]

    def of(self, a: int) -> int:
        i = bisect_right(self.low, a) - 1
        return self.to[i] if i >= 0 and a <= self.high[i] else a


_TYPES = {"at": pa.int64(), "start": pa.int32(), "low": pa.list_(pa.int32()), "high": pa.list_(pa.int32()), "to": pa.list_(pa.int32())}
_DDL = "at long, start int, low array<int>, high array<int>, to array<int>"


def _runs(batches: Iterator[pa.RecordBatch], keys: int, tolerance: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (keys, order, value) to a row for each key's run: where it starts, what it makes of its own first value, and its lift."""
    key, at, start, lift, done = None, 0, 0, Lift(tolerance), []

    def flush(schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(schema)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    schema = None
    for batch in batches:
        schema = schema or pa.schema([*[batch.schema.field(i) for i in range(keys)], *_TYPES.items()])
        for *own, order, d in zip(*(c.to_pylist() for c in batch.columns)):
            if own == key:
                # the first value too is part of the lift, for a run before it
                start = d if start < d <= start + tolerance else start
            else:
                if key is not None:
                    done.append((*key, at, start, lift.low, lift.high, lift.to))
                key, at, start, lift = own, order, d, Lift(tolerance)
            lift.then(d)
        yield flush(schema)
    if key is not None:
        done.append((*key, at, start, lift.low, lift.high, lift.to))
        yield flush(schema)


def lifted(a: Column, run: Column) -> Column:
    """A value after a run."""
    places = F.filter(F.sequence(F.lit(0), F.size(run["low"]) - 1), lambda i: (F.get(run["low"], i) <= a) & (a <= F.get(run["high"], i)))
    return F.coalesce(F.get(run["to"], F.get(places, F.lit(0))), a)


def fold_in_order(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str, tolerance: int = DURATION_TOLERANCE_MS) -> DataFrame:
    """(keys, name): each key's values folded in order; rows without a value take no part.

    Rows are dealt by ranges of key and order, so that a key of very many rows
    is many tasks' work, each of which holds one run's lift at a time.
    """
    sorted_ = rows.where(F.col(value).isNotNull()).select(*keys, F.col(order).cast("long").alias("at"), F.col(value).cast("int").alias("d"))
    sorted_ = sorted_.repartitionByRange(*keys, "at").sortWithinPartitions(*keys, "at")
    types = dict(sorted_.dtypes)
    runs = sorted_.mapInArrow(lambda b: _runs(b, len(keys), tolerance), ", ".join([*[f"`{k}` {types[k]}" for k in keys], _DDL]))
    runs = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "start", "low", "high", "to"))).alias("runs"))
    start = F.get("runs", F.lit(0))["start"]
    return runs.select(*keys, F.aggregate(F.slice("runs", 2, F.greatest(F.lit(1), F.size("runs"))), start, lambda a, run: lifted(a, run)).alias(name))
