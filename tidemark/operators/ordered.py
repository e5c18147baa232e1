"""Rules over ordered rows that need no loop: the forms for tables of what the folds do to streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _past(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def bursts(df: DataFrame, keys: list[str], order: list[str], offset: str, error: str, *, size: int = 8, settle: int = 8, slack: int = 1000) -> DataFrame:
    """(keys, bursts, offset_us, error_us, settled): of every `size` samples the one with the least error, the first of
    equal ones; settled from the burst on that follows `settle` others and lies within the slack of the one before.
    Samples of a last, short burst give no row."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    dealt = df.select(*keys, F.col(offset).alias("offset_us"), F.col(error).alias("error_us"), place.alias("_place"))
    best = dealt.groupBy(*keys, (F.floor(F.col("_place") / size) + 1).alias("bursts")).agg(F.min_by("offset_us", F.struct("error_us", "_place")).alias("offset_us"), F.min("error_us").alias("error_us"), F.count(F.lit(1)).alias("_n"))
    near = F.abs(F.col("offset_us") - F.lag("offset_us").over(Window.partitionBy(*keys).orderBy("bursts"))) <= slack
    found = best.where(F.col("_n") == size).withColumn("_near", F.coalesce((F.col("bursts") > settle) & near, F.lit(False)))
    return found.withColumn("settled", F.max("_near").over(_past(keys, ["bursts"]))).drop("_n", "_near")


def places(df: DataFrame, keys: list[str], order: list[str], at_us: str, position_ms: str, speed: str, is_query: str) -> DataFrame:
    """The queries of a play with `position_ms` by the latest anchor before or beside them, not under 0; null before any."""
    anchor = F.when(~F.col(is_query), F.struct(F.col(at_us).alias("at"), F.col(position_ms).alias("position"), F.col(speed).alias("speed")))
    found = df.withColumn("_anchor", F.last(anchor, ignorenulls=True).over(_past(keys, order))).where(is_query)
    place = F.col("_anchor.position") + (F.col(at_us) - F.col("_anchor.at")) / 1000 * F.col("_anchor.speed")
    return found.withColumn("position_ms", F.when(F.col("_anchor").isNotNull(), F.greatest(F.lit(0.0), place))).drop("_anchor")


def due_actions(df: DataFrame, keys: list[str], order: list[str], due: str, slot: str, period: str, *, fraction: float = 0.75) -> DataFrame:
    """The rows with `action` (play, wait or drop against the clock's slot) and how many were late and dropped so far."""
    known, late = F.col(slot).isNotNull(), F.col(due) < F.col(slot)
    dropped = F.col(due) < F.col(slot) - F.floor(F.col(period) * fraction)
    action = F.when(~known, "wait").when(dropped, "drop").when(F.col(due) <= F.col(slot) + F.floor(F.col(period) / 2), "play").otherwise("wait")
    w = _past(keys, order)
    return df.withColumns({"action": action, "late": F.count_if(known & late).over(w), "dropped": F.count_if(known & dropped).over(w)})


def quiet_before(df: DataFrame, keys: list[str], order: list[str], at_ms: str, timeout_ms: float) -> DataFrame:
    """The rows with `quiet_ms`, how long their key was silent before them (0 at first), and whether that was too long."""
    quiet = F.coalesce(F.col(at_ms) - F.lag(at_ms).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0))
    return df.withColumn("quiet_ms", quiet).withColumn("timed_out", F.col("quiet_ms") > timeout_ms)


def held_until_next(df: DataFrame, keys: list[str], order: list[str], at_ms: str) -> DataFrame:
    """Every unit but the last of its key with `released_ms`, the time of the next."""
    return df.withColumn("released_ms", F.lead(at_ms).over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("released_ms").isNotNull())

