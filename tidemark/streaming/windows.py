"""Event-time windows of sample blocks and keyed last-write-wins, for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling_peaks(df: DataFrame, keys: list[str], position: str, value: str, n: int) -> DataFrame:
    """Largest magnitude of each key in each run of `n` positions."""
    return df.groupBy(*keys, F.floor(F.col(position) / n).alias("window")).agg(F.max(F.abs(value)).alias("peak"))


def sliding_power(df: DataFrame, keys: list[str], at: str, power: str, *, length: str = "400 milliseconds", hop: str = "100 milliseconds", late: str = "1 second") -> DataFrame:
    """Mean power by sliding window, for streams with a watermark; windows that begin before the first sample are kept
    by the engine and are to be dropped by who knows where the key starts."""
    if df.isStreaming:
        df = df.withWatermark(at, late)
    got = df.groupBy(*keys, F.window(at, length, hop).alias("w")).agg(F.avg(power).alias("power"), F.count(F.lit(1)).alias("samples"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "power", "samples")


def last_write(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key by arrival."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")


def override(df: DataFrame, keys: list[str], order: list[str], authored: str, pushed: str, released: str) -> DataFrame:
    """`value`: the last pushed value until it is released, otherwise the authored one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col(released), F.struct(F.lit(False).alias("on"), F.col(pushed).alias("v"))).when(F.col(pushed).isNotNull(), F.struct(F.lit(True).alias("on"), F.col(pushed).alias("v")))
    last = F.last(event, ignorenulls=True).over(w)
    return df.withColumn("_last", last).withColumn("value", F.when(F.coalesce(F.col("_last.on"), F.lit(False)), F.col("_last.v")).otherwise(F.col(authored))).drop("_last")
