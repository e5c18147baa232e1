"""Comparisons of two runs, sets and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(least: Column, most: Column) -> Column:
    """(max - min) / min; 0 where min is not positive."""
    return F.when(least > 0, (most - least) / least).otherwise(F.lit(0.0))


def best_of_runs(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least value, spread and number of runs of each workload."""
    got = runs.groupBy(*keys).agg(F.min(value).alias("best"), F.max(value).alias("_most"), F.count(value).alias("runs"))
    return got.withColumn("spread", spread(F.col("best"), F.col("_most"))).drop("_most")


def tier(delta: Column, base_spread: Column, *, noise: float = 0.03, soft: float = 0.20, hard: float = 1.00) -> Column:
    """The first rule that holds: hard, regression, unchanged within the noise, faster, slower."""
    return (
        F.when(delta.isNull(), None).when(delta >= hard, "hard").when(delta >= soft, "regression")
        .when(F.abs(delta) <= F.greatest(F.lit(noise), F.coalesce(base_spread, F.lit(0.0))), "unchanged")
        .when(delta < 0, "faster").otherwise("slower")
    )


def compare_runs(base: DataFrame, head: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Base against head by workload, one-sided ones too: delta of the best values (0 with a base of 0) and its tier."""
    b = best_of_runs(base, keys, value).select(*keys, F.col("best").alias("base"), F.col("spread").alias("base_spread"))
    h = best_of_runs(head, keys, value).select(*keys, F.col("best").alias("head"))
    both = b.join(h, keys, "full_outer")
    delta = F.when(F.col("base").isNull() | F.col("head").isNull(), None).when(F.col("base") == 0, 0.0).otherwise((F.col("head") - F.col("base")) / F.col("base"))
    side = F.when(F.col("base").isNull(), "new").when(F.col("head").isNull(), "gone").otherwise("both")
    return both.withColumn("side", side).withColumn("delta", delta).withColumn("tier", tier(F.col("delta"), F.col("base_spread")))


def churn_tier(base: Column, head: Column, *, floor: float, soft: float = 0.20, hard: float = 1.00) -> Column:
    """Allocation churn: a base under the floor is judged by the floor before any ratio is taken."""
    ratio = (head - base) / base
    return F.when(base <= floor, F.when(head <= floor, "unchanged").otherwise("hard")).when(ratio >= hard, "hard").when(ratio >= soft, "regression").when(ratio <= -soft, "better").otherwise("unchanged")


def leak_tier(base: Column, head: Column, *, soft: int = 4096, hard: int = 1 << 20) -> Column:
    """A leak counts when it crosses a limit or, being above it, grows by as much."""
    over = lambda limit: ((base < limit) & (head >= limit)) | (head - base >= limit)
    return F.when(over(hard), "hard").when(over(soft), "soft").otherwise("ok")


def require_lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left lookup in which a row without a partner is an error, raised when the row is read."""
    got = rows.join(table.withColumn("_found", F.lit(True)), keys, "left")
    checked = F.coalesce(F.col("_found"), F.raise_error(F.concat_ws(" ", F.lit("no entry for"), *(F.col(k).cast("string") for k in keys))).cast("boolean"))
    return got.where(checked).drop("_found")


def unrecorded(rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the history hasn't: what an idempotent append adds."""
    return rows.join(history.select(*keys).distinct(), keys, "left_anti")


def first_differences(a: DataFrame, b: DataFrame, block: list[str], index: list[str], value: str, *, cap: int = 8) -> DataFrame:
    """Positional differences of two traces within the first block that differs, up to `cap` of each array."""
    left = a.select(*block, *index, F.col(value).alias("a"))
    both = left.join(b.select(*block, *index, F.col(value).alias("b")), [*block, *index], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    first = both.agg(F.min(F.struct(*block)).alias("_first"))
    here = both.join(F.broadcast(first), F.struct(*block) == F.col("_first")).drop("_first")  # one row
    rank = F.row_number().over(Window.partitionBy(*block, *index[:-1]).orderBy(index[-1]))
    return here.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, missing_in) of the keys that one side lacks, both ways."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("missing_in", F.lit("second")).unionByName(right.join(left, key, "left_anti").withColumn("missing_in", F.lit("first")))


def against_ceilings(measured: DataFrame, ceilings: DataFrame, key: str, value: str, limit: str) -> DataFrame:
    """Full outer lookup: ok, over, unpinned (no ceiling) or unmeasured."""
    state = F.when(F.col(limit).isNull(), "unpinned").when(F.col(value).isNull(), "unmeasured").when(F.col(value) > F.col(limit), "over").otherwise("ok")
    return measured.join(ceilings, key, "full_outer").withColumn("state", state)


def three_way_union(base: DataFrame, ours: DataFrame, theirs: DataFrame, row: str, seq: str) -> DataFrame:
    """Ours in order, then those of theirs that ours hasn't and that ours didn't drop from the base; each row once.

    A null row is no row. `added` marks what theirs gave.
    """
    w = Window.partitionBy(row).orderBy(seq)
    once = lambda df: df.where(F.col(row).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(row, seq)
    mine, their = once(ours), once(theirs)
    dropped = base.select(row).join(mine.select(row), row, "left_anti")
    fresh = their.join(mine.select(row), row, "left_anti").join(dropped, row, "left_anti")
    out = mine.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))
    return out.withColumnRenamed(seq, "position")


def missing(required: DataFrame, seen: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Required keys that were neither seen nor allowed to be missing."""
    return required.select(key).subtract(seen.select(key)).subtract(allowed.select(key))


def concat_streams(*streams: DataFrame, order: str | None = None) -> DataFrame:
    """Streams one after the other with their `part` number and, with `order`, that column as the `position` in the
    part, so that (part, position) is the order of the whole; different schemas are refused."""
    first = streams[0].schema
    if any(s.schema != first for s in streams[1:]):
        raise ValueError("the streams differ in structure")
    out = None
    for k, s in enumerate(streams):
        s = s.withColumn("part", F.lit(k)) if order is None else s.withColumns({"part": F.lit(k), "position": F.col(order)})
        out = s if out is None else out.unionByName(s)
    return out


def longest_prefix(rows: DataFrame, path: str, prefixes: DataFrame, prefix: str, name: str) -> DataFrame:
    """The name of the longest prefix that a path starts with; null where there is none.

    Every prefix of a path that some rule is as long as is looked up by equality, so there is no cross product: the
    lengths of the rules are few.
    """
    lengths = sorted({r[0] for r in prefixes.select(F.char_length(prefix)).distinct().collect()})
    tries = F.array(*(F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths)) if lengths else F.array(F.lit(None).cast("string"))
    keyed = rows.select(path).distinct().withColumn("_try", F.explode(F.array_compact(tries)))
    hit = keyed.join(prefixes.select(F.col(prefix).alias("_try"), F.col(name).alias("_name")), "_try")
    best = hit.groupBy(path).agg(F.max_by("_name", F.char_length("_try")).alias(name))
    return rows.join(best, path, "left")
