"""Connected components of an edge list by alternating stars, a table in the shared folder per round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import few_files, forget, shared_path


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node reachable from each node of a small edge list."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        fresh = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(fresh, x, low)
        while (fresh != fresh[fresh]).any():
            fresh = fresh[fresh]
        if (fresh == root).all():
            return nodes, nodes[root]
        root = fresh


def split_evenly(least: DataFrame, key: str) -> DataFrame:
    """An aggregate by `key`, dealt by another hash, so that a join on `key` shuffles both of its sides.

    Spark splits a hot key's rows in a join only where both sides come from shuffles of the join's own; an aggregate
    would bring its own dealing along, and all rows of the key would meet in one task. Only the aggregate is moved.
    """
    return least.repartition(F.xxhash64(key, F.lit(5)))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u, v) with v < u: neighbours move to the smallest node next to them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(split_evenly(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(split_evenly(least, "u"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.withColumnRenamed("m", "v"))
    return moved.where("u != v").distinct()


def components(edges: DataFrame, rows: int = 1_000_000, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node reachable; nodes are longs.

    `rows` is about how many edges there are, for the number of files.

    The number of edges never grows. A hot node meets its neighbours in a join that Spark can split, not in a list. Each
    round is a table in the shared folder; the one before it is deleted.
    """
    spark, kind = edges.sparkSession, "u long, v long"

    def settle(frame):
        path = shared_path(spark, "edges")
        few_files(frame, rows).write.parquet(path)
        return path, spark.read.schema(kind).parquet(path)

    def print_of(frame):
        return frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    path, now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = print_of(now)
    rows = before[0]
    for _ in range(most_rounds if before[0] else 0):
        half, moved = settle(_stars(now, True))
        old, (path, now) = path, settle(_stars(moved, False))
        forget(spark, half, old)
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
