"""Stream reports that grow by micro-batches: mergeable parts by batch, so that a batch that comes again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def part_of(units: DataFrame, keys: list[str], *, size: str, samples: str, rate: str, seq: str, first: list[str] = ()) -> DataFrame:
    """What a report needs to know of some units, by stream; parts of parts merge to the part of all."""
    known = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(c).alias("value"))))
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), F.sum(size).alias("bytes"), F.sum(samples).alias("samples"), F.min(size).alias("least"), F.max(size).alias("most"),
        known(rate).alias("rate"), *(known(c).alias(f"first_{c}") for c in first),
    )


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    firsts = [c for c in parts.columns if c == "rate" or c.startswith("first_")]
    sums = [F.sum(c).alias(c) for c in ("units", "bytes", "samples")]
    return parts.groupBy(*keys).agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"), *(F.min(c).alias(c) for c in firsts))


def report(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The report of merged parts, as of all units together: units, bytes, seconds, kbit/s, whether sizes vary, the first
    known rate and fields by their place."""
    got = merged(parts, keys)
    firsts = [c for c in got.columns if c.startswith("first_")]
    rate = F.col("rate.value")
    seconds = F.when(rate > 0, F.col("samples") / rate).otherwise(F.lit(0.0))
    got = got.select(*keys, "units", "bytes", rate.alias("rate"), (F.col("least") != F.col("most")).alias("variable"), *(F.col(f"{c}.value").alias(c) for c in firsts), seconds.alias("seconds"))
    return got.withColumn("kbps", F.when(F.col("seconds") > 0, F.col("bytes") * 8 / F.col("seconds") / 1000))


def keep_parts(path: str, keys: list[str], **columns) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each batch's part is a folder of its number, written over if the batch comes again."""

    def run(batch: DataFrame, number: int) -> None:
        part_of(batch, keys, **columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def read_report(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return report(spark.read.parquet(path).drop("batch"), keys)
