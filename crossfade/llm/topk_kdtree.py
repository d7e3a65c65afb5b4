"""Exact top-k search by inner product with KD-trees per shard.

Every partition of the candidates is cut into shards of bounded size. A shard
is split at medians into a tree whose nodes carry tight bounding boxes; for a
query the nodes are taken best first by the largest product that their box
admits, until that falls below the k-th score found so far. Queries start with
the k-th score of a pilot set of candidates, which the executors work out, so
that every shard begins with a bound. They go out in blocks of bounded size,
one after the other; a block's result is written before the next is sent.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, new_path

LEAF = 128
SHARD_ROWS = 16384
QUERY_BLOCK = 8192  # queries sent to the executors at once
PILOT_ROWS = 2048


class Tree:
    """Integer vectors of one shard, median-split; nodes in heap order, each a range of rows with its bounding box."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        lows, highs, self.ranges, self.children = [], [], [], []
        todo = [(0, len(ids))]
        while len(self.ranges) < len(todo):
            lo, hi = todo[len(self.ranges)]
            rows = vectors[order[lo:hi]]
            low, high = rows.min(0), rows.max(0)
            lows.append(low)
            highs.append(high)
            self.ranges.append((lo, hi))
            axis = int(np.argmax(high - low)) if rows.shape[1] else 0
            if hi - lo <= leaf or not rows.shape[1] or high[axis] == low[axis]:
                self.children.append(None)
                continue
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(rows[:, axis], mid, kind="introselect")]
            self.children.append((len(todo), len(todo) + 1))
            todo += [(lo, lo + mid), (lo + mid, hi)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        zero = queries.dtype.type(0) if queries.dtype != object else 0
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, least) -> list[tuple]:
        """The k best (score, -id) other than ``own``, scores of ``least`` or more only; ties go to smaller ids."""
        best: list[tuple] = []  # a heap, the worst first
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -bound < floor:
                break
            if self.children[node]:
                for c in self.children[node]:
                    if floor is None or bounds[c] >= floor:
                        heapq.heappush(todo, (-bounds[c], c))
                continue
            lo, hi = self.ranges[node]
            scores = self.vectors[lo:hi] @ query
            at = np.flatnonzero((scores >= floor) if floor is not None else np.ones(hi - lo, bool))
            if len(at) > 4 * k:  # only the leaf's own best and their ties can matter
                kth = np.partition(scores[at], len(at) - k - 1)[len(at) - k - 1]
                at = at[scores[at] >= kth]
            for i in at.tolist():
                if self.ids[lo + i] == own:
                    continue
                item = (scores[i], -int(self.ids[lo + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def _matrix(column: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and integer vectors by dimension; vectors null or with null or non-finite components are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum()))
    values = np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = {}
    for d in np.unique(sizes[valid]):
        rows = np.flatnonzero(valid & (sizes == d))
        m = values[starts[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))
        fine = np.isfinite(m).all(axis=1)
        out[int(d)] = rows[fine], m[fine]
    return out


def _exact(m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which products are exact: floats up to 2**53, Python integers beyond."""
    most = float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(m.shape[1], 1)
    if most < 2**53:
        return m, q
    whole = np.frompyfunc(int, 1, 1)
    return whole(m).astype(object), whole(q).astype(object)


def _local(rows: list, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of collected rows, by dimension."""
    if not rows:
        return {}
    ids = np.array([r.vec_id for r in rows], np.int64)
    return {d: (ids[at], m) for d, (at, m) in _matrix(pa.array([r.v for r in rows], pa.list_(pa.float64())), scale).items()}


def _with_floors(asked: DataFrame, pilot, k: int, scale: int) -> DataFrame:
    """Queries (vec_id, v, floor): the k-th score of each among the pilot set, null if it has fewer or is beyond a long."""

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            floors: list = [None] * len(ids)
            for d, (at, m) in _matrix(batch.column(1), scale).items():
                if d not in pilot.value or len(pilot.value[d][0]) <= k:
                    continue
                others, rows = pilot.value[d]
                rows, m = _exact(rows, m)
                for i, q in zip(at.tolist(), m, strict=True):
                    scores = (rows @ q)[others != ids[i]]
                    if len(scores) >= k:
                        least = int(np.sort(scores)[-k])
                        floors[i] = least if abs(least) < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], ["vec_id", "v", "floor"])

    return asked.mapInArrow(scan, "vec_id long, v array<double>, floor long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Per query its k best candidates: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x) and the score is their integer inner
    product; ties go to the smaller id. A query's own row, known by its id, is
    no candidate of it. Vectors that are null or hold a null or non-finite
    component, rows without an id, and pairs of unequal dimension take no
    part; repeated queries count once, and rows that repeat an id are
    candidates of their own. Other columns are ignored. With fewer than k
    candidates all are returned; empty tables give an empty result. A score
    beyond a long is an error.
    """
    spark = vectors.sparkSession

    def shape(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    cand, asked = shape(vectors), shape(queries).dropDuplicates(["vec_id"])
    pilot = spark.sparkContext.broadcast(_local(cand.limit(PILOT_ROWS).collect(), scale))
    count = asked.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    path = new_path(spark, "queries")
    _with_floors(asked, pilot, k, scale).withColumn("block", number).repartition("block").write.partitionBy("block").parquet(path)
    pilot.destroy()
    ready = spark.read.schema("vec_id long, v array<double>, floor long, block int").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = []
    for b in range(blocks):
        rows = ready.where(F.col("block") == b).collect()
        floors = {r.vec_id: r.floor for r in rows}
        block = {d: (ids, m, [floors[i] for i in ids.tolist()]) for d, (ids, m) in _local(rows, scale).items()}
        del rows
        sent = spark.sparkContext.broadcast(block)
        # the shards' best of each query come to k at most before the shuffle
        found = _search_block(cand, sent, k, scale).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out.append(new_path(spark, "top-k"))
        found.write.parquet(out[-1])
        sent.destroy()
    found = spark.read.schema("query_id long, vec_id long, score long, rank int").parquet(*out)
    return found.select("query_id", "rank", "vec_id", "score")


def _search_block(cand: DataFrame, sent, k: int, scale: int) -> DataFrame:
    """The best of each query among the candidates of each task."""

    @give_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # floors rise as shards of this partition are searched
        floors = {d: list(f) for d, (_, _, f) in sent.value.items()}
        best: dict[int, list] = {}

        def search(ids: np.ndarray, m: np.ndarray, d: int) -> None:
            if d not in sent.value or not len(ids):
                return
            qids, qm, _ = sent.value[d]
            vectors, asked = _exact(m, qm)
            tree = Tree(ids, vectors)
            for lo in range(0, len(qids), 1024):
                bounds = tree.bounds(asked[lo : lo + 1024])
                for i in range(lo, min(lo + 1024, len(qids))):
                    got = tree.search(int(qids[i]), asked[i], bounds[i - lo], k, floors[d][i])
                    if got:
                        kept = heapq.nlargest(k, best.get(int(qids[i]), []) + got)
                        best[int(qids[i])] = kept
                        if len(kept) == k and (floors[d][i] is None or kept[-1][0] > floors[d][i]):
                            floors[d][i] = kept[-1][0]

        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for d, (at, m) in _matrix(batch.column(1), scale).items():
                own = held.setdefault(d, ([], []))
                own[0].append(ids[at])
                own[1].append(m)
                if sum(map(len, own[0])) >= SHARD_ROWS:
                    search(np.concatenate(own[0]), np.concatenate(own[1]), d)
                    held[d] = ([], [])
        for d, (i, m) in held.items():
            if i:
                search(np.concatenate(i), np.concatenate(m), d)
        rows = [(q, -neg, int(score)) for q, items in best.items() for score, neg in items]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return cand.mapInArrow(scan, "query_id long, vec_id long, score long")
