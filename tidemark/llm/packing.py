"""Packing: length buckets by dynamic programming, and batches of a token budget inside each bucket."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import shared_path

#: Tokens of the longest piece, buckets, tokens of a batch with its padding, pieces of a shard about.
MAX_LENGTH, BUCKETS, BUDGET, SHARD = 2048, 8, 16_384, 100_000


def boundaries(counts: np.ndarray, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """The bucket lengths that pad least, and that padding, for counts of pieces by length (from 0).

    A piece is padded to its bucket's length. cost(k, j) is the least padding of the lengths up to j in k buckets, the
    last of them of length j; with prefix sums each step is one vectorised minimum, so all splits are weighed.
    """
    used = np.flatnonzero(counts)
    if not len(used):
        return [], 0
    n = np.concatenate([[0], np.cumsum(counts[used], dtype=np.float64)])
    total = np.concatenate([[0], np.cumsum(counts[used] * used.astype(np.float64))])
    size = len(used)
    padding = used[None, :] * (n[1:][None, :] - n[:-1][:, None]) - (total[1:][None, :] - total[:-1][:, None])
    padding[np.tril_indices(size, -1)] = np.inf  # padding[i, j]: lengths i to j in one bucket
    cost, back = padding[0].copy(), []
    for _ in range(min(buckets, size) - 1):
        ways = np.full((size, size), np.inf)
        ways[1:] = cost[:-1, None] + padding[1:]
        ways[0] = padding[0]
        back.append(ways.argmin(0))
        cost = ways.min(0)
    out, j = [], size - 1
    for steps in reversed(back):
        out.append(int(used[j]))
        i = int(steps[j])
        if i == 0:
            return out[::-1], int(cost[-1])
        j = i - 1
    out.append(int(used[j]))
    return out[::-1], int(cost[-1])


def pieces(docs: DataFrame, id: str, length, max_length: int) -> DataFrame:
    """(`id`, piece, n_tokens): a text longer than `max_length` is cut into pieces of that length and a rest."""
    rows = docs.select(F.col(id), F.coalesce(length, F.lit(0)).cast("long").alias("_n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / max_length) - 1)
    rows = rows.select(id, "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return rows.select(id, "piece", F.least(F.lit(max_length), F.col("_n") - F.col("piece") * max_length).alias("n_tokens"))


def words_in(text: str):
    """A native length: words between ASCII white space."""
    return F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+"))


def pack(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length=None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> DataFrame:
    """`id`, piece, n_tokens, bucket (its length), batch (numbered in each bucket) and slot of every piece.

    `length` is a column of token numbers; by default words are counted. Every document is packed: null, empty and
    negative lengths as one piece of no tokens, long ones as several pieces. The histogram has at most `max_length` + 1
    rows whatever the table, so only it goes to the driver. A batch has `budget` // bucket pieces (one at least), and
    only the last batch of a bucket may have fewer. Places in a bucket follow a hash of (id, piece): counts by shard
    give each shard its first place, and ranks are taken inside shards of about `shard` pieces, so a length that most
    texts share is no single task. Repeated rows and null ids are packed as rows of their own.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "pieces")
    length = words_in(text) if length is None else length
    pieces(docs, id, F.greatest(F.lit(0), length), max_length).write.parquet(path)
    found = spark.read.schema(docs.select(id, F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("n_tokens")).schema).parquet(path)
    counts = np.zeros(max_length + 1, np.int64)
    for r in found.groupBy("n_tokens").count().collect():
        counts[r["n_tokens"]] = r["count"]
    ends = boundaries(counts, buckets)[0]
    shards = max(1, math.ceil(int(counts.sum()) / shard))
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(bucket)
    key = F.xxhash64(F.col(id), F.col("piece"))
    found = found.withColumn("bucket", bucket).withColumn("_key", key).withColumn("_shard", F.pmod(F.shiftright("_key", 8), F.lit(shards)))
    sizes = found.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("bucket", "_shard", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("_key", id, "piece"))
    placed = found.withColumn("_rank", rank).join(firsts, ["bucket", "_shard"])
    place, each = F.col("_first") + F.col("_rank") - 1, F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket"))))
    return placed.select(id, "piece", "n_tokens", "bucket", F.floor(place / each).alias("batch"), (place % each).alias("slot"))
