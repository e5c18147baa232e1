"""Reachability over dependency edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_path


def transitive_users(edges: DataFrame, src: str = "src", dst: str = "dst", *, most_rounds: int = 64) -> DataFrame:
    """(dst, src) for every src that reaches dst over edges, directly or through others; no node reaches itself.

    Path doubling: each round joins the pairs with themselves, so a chain of length n takes log2(n) rounds; pairs are
    written to the checkpoint folder each round. Cycles end when no pair is new.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct()

    def settle(df):
        path = shared_path(spark, "closure")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pairs = settle(pairs)
    n = pairs.count()
    for _ in range(most_rounds):
        longer = pairs.alias("x").join(pairs.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        pairs = settle(pairs.unionByName(longer).distinct())
        m = pairs.count()
        if m == n:
            break
        n = m
    return pairs.where("a != b").select(F.col("b").alias(dst), F.col("a").alias(src))
