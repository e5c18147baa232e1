"""Trailing windows of measurement series: baselines from earlier records, verdicts, running minima and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Records of a baseline; relative changes of the soft and hard tier; commits of a recent window.
BASELINE, SOFT, HARD, RECENT = 10, 0.20, 1.00, 80


def with_others(df: DataFrame, keys: list[str], order: list[str], values: list[str], commit: str, n: int, out: str = "_past") -> DataFrame:
    """The rows with `out`: the last `n` earlier records of the series that are of another commit than the row's, oldest
    first, as structs of the commit (`_commit`) and `values`; null where a key is null.

    A run is judged against what came before its commit, not against copies of its own numbers. A null commit is no
    commit: such records are never left out. Of the last 2 `n` records more than `n` can be of the row's own commit only
    if at least two of these and the row follow a record of their own commit. Series without such a place take their past
    from those 2 `n`, in one sort; the others from stretches, see _with_stretches. Ties in `order` are in that of commits,
    so that both sides tell the same series apart.
    """
    w = Window.partitionBy(*keys).orderBy(*order, *({commit} - set(order)))
    again = F.coalesce(F.lag(commit).over(w) == F.col(commit), F.lit(False))
    df = df.withColumn("_again", again.cast("int"))
    crowded = (F.sum("_again").over(w.rowsBetween(1 - 2 * n, 0)) >= 2) & (F.row_number().over(w) > 2 * n + 1)
    df = df.withColumn("_crowded", crowded).withColumn("_crowded", F.max("_crowded").over(Window.partitionBy(*keys)))
    before = F.collect_list(F.struct(F.col(commit).alias("_commit"), *values)).over(w.rowsBetween(-2 * n, -1))
    others = F.filter("_before", lambda x: ~F.coalesce(x["_commit"] == F.col(commit), F.lit(False)))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    plain = df.where("not _crowded").withColumn("_before", before).withColumn("_others", others)
    plain = plain.withColumn(out, F.when(known, F.slice("_others", F.greatest(F.lit(1), F.size("_others") - n + 1), n)))
    crowd = _with_stretches(df.where("_crowded").drop("_again", "_crowded"), keys, order, values, commit, n, out)
    return plain.drop("_again", "_crowded", "_before", "_others").unionByName(crowd)


def _with_stretches(df: DataFrame, keys: list[str], order: list[str], values: list[str], commit: str, n: int, out: str) -> DataFrame:
    """with_others at a cost that doesn't depend on how many records a commit has.

    Records in a row of one commit see the same past, so it is found once for each such stretch, from the last `n`
    records of the stretches before it. Of two stretches side by side one is of another commit, so twice `n` of them do.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = ~F.coalesce(F.lag(commit).over(w) == F.col(commit), F.lit(False))
    df = df.withColumn("_run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*(F.desc(o) for o in order)))
    ends = df.withColumn("_back", back).where(F.col("_back") <= n)
    runs = ends.groupBy(*keys, "_run").agg(F.first(commit).alias("_commit"), F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("_at"), F.struct(F.col(commit).alias("_commit"), *values).alias("_values")))).alias("_last"))
    before = F.collect_list(F.struct("_commit", "_last")).over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(-2 * n, -1))
    others = F.flatten(F.transform(F.filter(before, lambda x: ~F.coalesce(x["_commit"] == F.col("_commit"), F.lit(False))), lambda x: F.transform(x["_last"], lambda y: y["_values"])))
    past = runs.withColumn("_others", others).select(*keys, "_run", F.slice("_others", F.greatest(F.lit(1), F.size("_others") - n + 1), n).alias(out))
    return df.join(past, [*keys, "_run"], "left").drop("_run")


def trailing_mean(df: DataFrame, keys: list[str], order: list[str], value: str, *, n: int = BASELINE, out: str = "baseline", count: str | None = None, commit: str | None = None) -> DataFrame:
    """Mean of the last `n` earlier records of the same series; null for the first. A null key matches no series.

    With `commit` the records of the row's own commit are left out, see with_others.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    if commit:
        kept = df.columns
        df = with_others(df, keys, order, [value], commit, n).select(*kept, F.filter(F.transform("_past", lambda x: x[value].cast("double")), lambda v: v.isNotNull()).alias("_past"))
        mean, many = F.aggregate("_past", F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("_past"), F.lit(0)), F.size("_past").cast("long")
    else:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
        mean, many = F.avg(value).over(w), F.count(value).over(w)
    df = df.withColumn(out, F.when(known, mean))
    df = df.withColumn(count, F.when(known, many).otherwise(0)) if count else df
    return df.drop("_past") if commit else df


def trailing_channels(df: DataFrame, keys: list[str], order: list[str], channels: str, *, n: int = BASELINE, out: str = "baseline", commit: str | None = None) -> DataFrame:
    """Mean by channel of the last `n` earlier records, of which those with another channel count than the newest go.

    With `commit` the records of the row's own commit are left out, see with_others.
    """
    if commit:
        kept = df.columns
        df = with_others(df, keys, order, [channels], commit, n).select(*kept, F.transform("_past", lambda x: x[channels]).alias("_past"))
    else:
        df = df.withColumn("_past", F.collect_list(channels).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)))
    df = df.withColumn("_many", F.size(F.try_element_at("_past", F.lit(-1)))).withColumn("_same", F.filter("_past", lambda x: F.size(x) == F.col("_many")))
    mean = F.transform(F.sequence(F.lit(0), F.col("_many") - 1), lambda k: F.aggregate("_same", F.lit(0.0), lambda s, x: s + F.get(x, k)) / F.size("_same"))
    return df.withColumn(out, F.when(F.size("_past") > 0, mean)).drop("_past", "_many", "_same")


def like_for_like(df: DataFrame, keys: list[str], machine: str, order: list[str], value: str, *, n: int = BASELINE, commit: str | None = None) -> DataFrame:
    """The baseline of the same machine where it has a record (and is named), else that of all; `basis` says which."""
    df = trailing_mean(df, [*keys, machine], order, value, n=n, out="_same", commit=commit)
    df = trailing_mean(df, keys, order, value, n=n, out="_all", commit=commit)
    same = F.col("_same").isNotNull() & ~F.coalesce(F.col(machine).cast("string"), F.lit("")).isin("", "unknown")
    basis = F.when(same, "same machine").when(F.col("_all").isNotNull(), "all machines").otherwise("none")
    return df.withColumn("baseline", F.when(same, F.col("_same")).otherwise(F.col("_all"))).withColumn("basis", basis).drop("_same", "_all")


def widening_baseline(own: DataFrame, siblings: DataFrame, keys: list[str], order: list[str], value: str, *, n: int = BASELINE, enough: int = 3) -> DataFrame:
    """By series: the mean of the last `n` of the own branch if it has `enough`, else of all branches together."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))

    def last(frame, out):
        got = frame.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
        return got.groupBy(*keys).agg(F.avg(value).alias(out), F.count(F.lit(1)).alias(f"{out}_n"))

    both = last(own, "_own").join(last(own.unionByName(siblings), "_wide"), keys, "full_outer")
    alone = F.coalesce("_own_n", F.lit(0)) >= enough
    return both.select(*keys, F.when(alone, F.col("_own")).otherwise(F.col("_wide")).alias("baseline"), F.when(alone, F.lit("own")).otherwise(F.lit("widened")).alias("basis"))


def recent_commits(df: DataFrame, commit: str, seq: str, *, n: int = RECENT) -> DataFrame:
    """All rows of the last `n` distinct commits by first appearance: commits are ranked, not rows."""
    first = df.groupBy(commit).agg(F.min(seq).alias("_first"))
    kept = first.orderBy(F.desc("_first")).limit(n).select(commit)
    return df.join(kept, commit, "left_semi")


def newest_commit(df: DataFrame, commit: str, seq: str) -> DataFrame:
    """All rows of the commit of the last row."""
    last = df.agg(F.max_by(commit, seq).alias(commit))
    return df.join(F.broadcast(last), commit, "left_semi")  # one row


def growth(value: Column, base: Column, floor: float = 0.0) -> Column:
    """(value - base) / base; with a base at or under `floor` 0 up to the floor and above it infinite growth is null."""
    return F.when(base > floor, (value - base) / base).when(value <= floor, F.lit(0.0))


def verdict(change: Column, *, soft: float = SOFT, hard: float = HARD, rising_is_worse: bool = True) -> Column:
    worse = change if rising_is_worse else -change
    return F.when(change.isNull(), "no baseline").when(worse >= hard, "hard").when(worse >= soft, "soft").otherwise("ok")


def trailing_line(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, *, n: int = 64, least: int = 8, nominal: float | None = None, off: float = 0.05) -> DataFrame:
    """Slope and intercept of the latest `n` points, this one included; under `least` points, or with a slope more than
    `off` away from a nominal one, the nominal slope (null without one) and no intercept."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    slope, cut = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
    good = F.count(y).over(w) >= least
    if nominal is not None:
        good = good & (F.abs(slope / nominal - 1) <= off)
    return df.withColumn("slope", F.when(good, slope).otherwise(F.lit(nominal).cast("double"))).withColumn("intercept", F.when(good, cut))


def running_minimum(df: DataFrame, keys: list[str], order: list[str], value: str, *, n: int = 2048, out: str = "origin") -> DataFrame:
    return df.withColumn(out, F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)))


def reject_above_floor(df: DataFrame, keys: list[str], order: list[str], error: str, *, n: int = 31, slack: float = 1000.0) -> DataFrame:
    """floor is the least of this error and the n - 1 before; rejected if error > floor + max(floor / 2, slack)."""
    df = running_minimum(df, keys, order, error, n=n, out="floor")
    return df.withColumn("rejected", F.col(error) > F.col("floor") + F.greatest(F.col("floor") / 2, F.lit(slack)))


def gaps(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, *, least) -> DataFrame:
    """The next row's start, the gap up to it, and whether that is at least `least` long."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("next_start", nxt).withColumn("gap", F.col("next_start") - F.col(end)).withColumn("long_gap", F.coalesce(F.col("gap") >= least, F.lit(False)))


def word_times(df: DataFrame, line: str, order: str, word: str, start: str, end: str) -> DataFrame:
    """Words share their line's time by their letters (one at least): starts are rounded half up to whole hundredths."""
    letters = F.greatest(F.lit(1), F.char_length(F.regexp_replace(word, r"[^\p{L}\p{N}]", "")))
    w = Window.partitionBy(line)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_n", letters)
    share = F.coalesce(F.sum("_n").over(run), F.lit(0)) / F.sum("_n").over(w)
    at = F.floor((F.col(start) + share * (F.col(end) - F.col(start))) / 10 + 0.5) * 10
    df = df.withColumn("word_start", at.cast("long"))
    return df.withColumn("word_end", F.coalesce(F.lead("word_start").over(w.orderBy(order)), F.col(end))).drop("_n")
