"""Connected components by alternating large-star and small-star.

Edges are kept as (u, v) with u > v. A large-star step links every larger
neighbour of a node to the smallest of its neighbourhood; a small-star step
does the same for the node itself and its smaller neighbours. At the fixed
point every node points at the smallest node of its component. The minima of a
step are a table of their own, so that the join on a hub can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, drop_path, new_path, write_table


def _large_star(edges: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    least = scratch.table(least, "least", 2 * count)
    # only larger neighbours are moved: exactly the stored edges, seen from their smaller end
    return edges.join(least, edges.v == least.c).select("u", F.col("m").alias("v")).where("u > v")


def _small_star(edges: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    least = scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"), "least", count)
    moved = edges.join(least, edges.u == least.c).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is the least node.

    ``edges`` has two columns of one orderable type; rows with a null and self
    links are dropped, direction and repeats don't matter; ``most`` is a bound
    on their number, if one is known. Each round is
    written to the shared folder, so that the lineage stays short and a lost
    executor costs a task, not the rounds before it. Only a row count and a
    hash sum reach the driver. Rounds go on until the edges no longer change,
    which they do after a number in the order of the logarithm of the nodes.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    cur = cur.where("x and y and u > v").select("u", "v").distinct()

    def write(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "components")
        back = write_table(df, path, rows)
        # a shuffle-free fingerprint of the edge set
        h = F.xxhash64("u", "v")
        sums = back.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        return back, path, tuple(sums)

    cur, path, mark = write(cur, most)
    before = None
    while mark[0] and mark != before:
        scratch, count = Scratch(spark), mark[0]
        # written before its minima and its joins read it; a step makes no more edges than it gets, and one for each node
        moved = scratch.table(_large_star(cur, count, scratch).distinct(), "large-star", count)
        nxt, new, now = write(_small_star(moved, count, scratch).distinct(), 2 * count)
        drop_path(spark, path)
        scratch.clear()
        cur, path, before, mark = nxt, new, mark, now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
