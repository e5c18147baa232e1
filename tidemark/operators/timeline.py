"""Timelines: as-of lookups, brackets with interpolation, intervals, grids and lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(queries: DataFrame, anchors: DataFrame, keys: list[str], at: str, values: list[str], *, exact: bool = True) -> DataFrame:
    """The latest anchor of the same keys at or before (exact=False: before) each query; nulls where there is none.

    Both sides go through one sort by (keys, time): a shuffle, no range join. Of anchors at one time the largest counts.
    """
    packed = F.struct(F.col(at).alias("_at"), *values)
    a = anchors.select(*keys, F.col(at).alias("_t"), F.lit(0 if exact else 1).alias("_side"), packed.alias("_anchor"), F.lit(None).cast(queries.select(F.struct("*")).schema[0].dataType).alias("_query"))
    q = queries.select(*keys, F.col(at).alias("_t"), F.lit(1 if exact else 0).alias("_side"), F.lit(None).cast(a.schema["_anchor"].dataType).alias("_anchor"), F.struct("*").alias("_query"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_anchor").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(q).withColumn("_last", F.last("_anchor", ignorenulls=True).over(w)).where("_query is not null")
    return got.select("_query.*", F.col("_last._at").alias(f"anchor_{at}"), *(F.col(f"_last.{v}").alias(f"anchor_{v}") for v in values))


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a + (b - a) * f


def keyframes(frames: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The frames of each key in the order of time, numbered (`place`); two at one time are an error when they are read."""
    w = Window.partitionBy(*keys).orderBy(at)
    message = F.concat_ws(" ", F.lit("two keyframes at"), F.col(at).cast("string"))
    place = F.when(F.lag(at).over(w) == F.col(at), F.raise_error(message).cast("int")).otherwise(F.row_number().over(w) - 1)
    return frames.withColumn("place", place)


def heard_positions(frames: DataFrame, blocks: DataFrame, anchors: DataFrame, keys: list[str], *, delay: int = 0, offset: int = 0, hop: int = 10) -> DataFrame:
    """Where each analysis frame (center: a sample number) is in the item that was playing, in grid places.

    A frame's block (first, time: the sample it begins with and when it was captured; both known as-of the frame's
    centre) gives its capture time, with `rate` samples a second; less the input's `delay` it finds the latest anchor
    (time, position, speed); a frame before any anchor, or while nothing moves (speed 0), has no place.
    """
    placed = as_of(frames, blocks.withColumnRenamed("first", "center"), keys, "center", ["time", "rate"])
    ms = F.col("anchor_time") + (F.col("center") - F.col("anchor_center")) * 1000 / F.col("anchor_rate") - delay
    placed = placed.withColumn("time", F.floor(ms).cast("long")).select(*frames.columns, "time")
    known = as_of(placed, anchors, keys, "time", ["position", "speed"])
    moving = F.col("anchor_speed") != 0
    at = F.col("anchor_position") + (F.col("time") - F.col("anchor_time")) * F.col("anchor_speed") + offset
    return known.select(*frames.columns, "time", F.when(moving, F.floor((at + hop // 2) / hop).cast("long")).alias("place"))


def at_times(queries: DataFrame, frames: DataFrame, keys: list[str], at: str, value: str, *, hold: list[str] = ()) -> DataFrame:
    """Keyframes at query times: before the first and after the last its value, between two their interpolation.

    `hold` columns keep the earlier keyframe's value (the first one's before it).
    """
    w = Window.partitionBy(*keys).orderBy(at)
    stretches = frames.select(*keys, at, value, *hold, F.lead(at).over(w).alias("_t1"), F.lead(value).over(w).alias("_v1"))
    got = as_of(queries, stretches, keys, at, [value, "_t1", "_v1", *hold])
    first = frames.groupBy(*keys).agg(F.min_by(F.struct(value, *hold), at).alias("_first"))
    got = got.join(first, keys, "left")
    t0, v0 = F.col(f"anchor_{at}"), F.col(f"anchor_{value}")
    part = (F.col(at).cast("double") - t0.cast("double")) / (F.col("anchor__t1").cast("double") - t0.cast("double"))
    value_at = F.when(t0.isNull(), F.col(f"_first.{value}")).when(F.col("anchor__t1").isNull(), v0).otherwise(lerp(v0, F.col("anchor__v1"), part))
    held = [F.when(t0.isNull(), F.col(f"_first.{h}")).otherwise(F.col(f"anchor_{h}")).alias(h) for h in hold]
    return got.select(*queries.columns, value_at.alias(value), *held)


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """The interval [start, end) of the same keys that a point is in, where intervals of a key don't overlap."""
    got = as_of(points, intervals.withColumnRenamed(start, at), keys, at, [end, *values])
    inside = F.col(at) < F.col(f"anchor_{end}")
    state = F.when(F.col(f"anchor_{at}").isNull(), "not yet").when(inside, "in").otherwise("past")
    return got.select(*points.columns, *(F.when(inside, F.col(f"anchor_{v}")).alias(v) for v in values), state.alias("state"))


def grid_index(ms: Column, hop: int) -> Column:
    """Nearest grid place by whole numbers: (ms + hop / 2) / hop, truncated."""
    return F.floor((ms + hop // 2) / hop).cast("long")


def best_lag(a: DataFrame, b: DataFrame, index: str, matches: Column, *, most: int = 10, least_hits: int = 1, least_counted: int = 1) -> DataFrame:
    """The shift of `b` against `a` with most matches; ties go to the smaller shift, then to the negative one.

    Each row of `a` meets 2 * most + 1 rows by equality on the shifted index. `matches` compares a.* and b.*.
    """
    shifted = a.select("*", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("step")).withColumn("_to", F.col(index) + F.col("step"))
    both = shifted.alias("a").join(b.withColumnRenamed(index, "_to").alias("b"), "_to")
    by = both.groupBy("step").agg(F.count_if(matches).alias("hits"), F.count(F.lit(1)).alias("counted"))
    good = by.where((F.col("hits") >= least_hits) & (F.col("counted") >= least_counted))
    return good.agg(F.max_by(F.struct("step", "hits", "counted"), F.struct("hits", -F.abs("step"), -F.col("step"))).alias("r")).select("r.*").where("step is not null")


def islands(df: DataFrame, keys: list[str], order: list[str], good: Column) -> DataFrame:
    """By key: rows, good rows and the longest run of rows that are not good."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_group", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_good").orderBy(*order)))
    runs = marked.groupBy(*keys, "_good", "_group").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(F.col("_good"), F.col("_n"))), F.lit(0)).alias("good"), F.coalesce(F.max(F.when(~F.col("_good"), F.col("_n"))), F.lit(0)).alias("longest_bad"))


def arrivals(df: DataFrame, keys: list[str], order: list[str], slot: str, size: str, *, limit: int) -> DataFrame:
    """A leaky bucket: a unit starts at its slot or when the one before has ended; end, and headroom = limit - (end - slot).

    ends = C + running max(slot - C before), C the running sum of sizes: two windows instead of a fold.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_c", F.sum(size).over(w))
    df = df.withColumn("end", F.col("_c") + F.max(F.col(slot) - (F.col("_c") - F.col(size))).over(w))
    return df.withColumn("headroom", F.lit(limit) - (F.col("end") - F.col(slot))).withColumn("late", F.col("headroom") < 0).drop("_c")


def by_interval(df: DataFrame, keys: list[str], order: list[str], restart: Column, size: str) -> DataFrame:
    """By stretch between restarts: units, size, largest size, least headroom and late units."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("interval", F.sum(F.when(restart, 1).otherwise(0)).over(w))
    return df.groupBy(*keys, "interval").agg(F.count(F.lit(1)).alias("units"), F.sum(size).alias("size"), F.max(size).alias("largest"), F.min("headroom").alias("least_headroom"), F.count_if("late").alias("late_units"))
