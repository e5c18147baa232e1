"""Record-preserving extremes, small-sample statistics, listening-test scores and sample-block metering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom (fixed values); 1.96 beyond.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
#: Samples at or over this count as clipped; level of silence.
CLIP, SILENCE = 32767 / 32768, -120.0


def record_of_least(df: DataFrame, keys: list[str], value: str, seq: list[str]) -> DataFrame:
    """The whole record with the least value of each key; of equal ones the first."""
    rest = [c for c in df.columns if c not in keys]
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(value, *seq)).alias("_r")).select(*keys, "_r.*")


def record_of_most(df: DataFrame, keys: list[str], value: str, seq: list[str]) -> DataFrame:
    """The whole record with the largest value of each key; of equal ones the first (seq are numbers)."""
    rest = [c for c in df.columns if c not in keys]
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(value, *(-F.col(s) for s in seq))).alias("_r")).select(*keys, "_r.*")


def keep_first(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The first record of each key, by aggregation: no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("_r")).select(*keys, "_r.*")


def extremes(df: DataFrame, keys: list[str], value: str, owner: str) -> DataFrame:
    """Least and most with their owners (the smaller owner of equal ones), and whether they are one value."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(value).alias("least"), F.min_by(owner, F.struct(value, owner)).alias("least_owner"), F.max(value).alias("most"),
        F.min_by(owner, F.struct(-F.col(value), F.col(owner))).alias("most_owner"), (F.min(value) == F.max(value)).alias("constant"),
    )


def channel_floors(df: DataFrame, keys: list[str], channels: str, seq: str, *, margin: float = 1.0) -> DataFrame:
    """By channel floor(least - margin) over the records with as many channels as the newest one."""
    newest = df.groupBy(*keys).agg(F.max_by(F.size(channels), seq).alias("_n"))
    same = df.join(newest, keys).where(F.size(channels) == F.col("_n"))
    by = same.select(*keys, F.posexplode(channels).alias("channel", "_v"))
    return by.groupBy(*keys, "channel").agg(F.floor(F.min("_v") - margin).alias("floor"))


def supported_median(df: DataFrame, keys: list[str], value: str, *, least: int = 20) -> DataFrame:
    """Median of each key, of an even number the mean of the middle two; null under `least` values."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("_m")).select(*keys, "n", F.when(F.col("n") >= least, F.col("_m")).alias("median"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """The value of rank ceil(share * n)."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({share}) within group (order by {value})").alias("p"))


def mean_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and half-width of its 95 % interval; no half-width under two values."""
    got = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    t = F.coalesce(F.try_element_at(F.array(*map(F.lit, T95)), F.greatest(F.lit(1), F.col("n") - 1).cast("int")), F.lit(1.96))
    return got.withColumn("half_width", F.when(F.col("n") >= 2, t * F.col("deviation") / F.sqrt("n")))


def wilson(right: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a share, within 0 and 1; nulls for n = 0."""
    p = right / n
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (middle - width) / scale), F.least(F.lit(1.0), (middle + width) / scale)
    return F.when(n > 0, low), F.when(n > 0, high)


#: ln(k!) - (k ln k - k + ln(2 pi k) / 2) for k from 1 to 15; a series beyond.
STIRLING = tuple(math.lgamma(k + 1) - (k * math.log(k) - k + 0.5 * math.log(2 * math.pi * k)) for k in range(1, 16))


def _stirling(k: Column) -> Column:
    """What Stirling's formula lacks of ln(k!), k at least 1."""
    x = k.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, STIRLING)), F.least(k, F.lit(16)).cast("int")), series)


def fair_term(k: Column, n: Column) -> Column:
    """Probability of exactly k hits in n fair trials, by logarithms of what differs from the middle: no factorials,
    no powers that vanish, and as exact for a billion trials as for ten."""
    d = (2 * k - n) / n
    off = n / 2.0 * ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d))
    inner = F.exp(_stirling(n) - _stirling(k) - _stirling(n - k) + 0.5 * F.log(n / (2 * math.pi * k * (n - k))) - off)
    return F.when((k == 0) | (k == n), F.exp(-n * math.log(2))).otherwise(inner)


def binomial_tail(right: Column, n: Column) -> Column:
    """Probability of at least `right` hits in n fair trials; 1 for no hits, without trials too.

    The terms of the shorter side are added from its edge nearest the middle outward; beyond some standard deviations
    they no longer count, so a group costs the root of its trials.
    """
    right, n = right.cast("long"), n.cast("long")
    upper = 2 * right > n  # else the side below is the shorter one
    edge = F.when(upper, right).otherwise(right - 1)
    far = F.when(upper, n - edge).otherwise(edge)
    steps = F.least(far, (F.ceil(20 * F.sqrt(n)) + 40).cast("long"))

    def step(s, k):
        left = F.when(upper, n - edge - k + 1).otherwise(edge - k + 1)  # the term further out is the last one times left / (n - left + 1)
        term = s["term"] * left / (n - left + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    first = fair_term(edge, n)
    start = F.struct(first.alias("term"), first.alias("total"))
    side = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), steps)), start, step, lambda s: s["total"])).otherwise(first)
    tail = F.when(upper, side).otherwise(1 - side)
    return F.when(right <= 0, 1.0).when(right > n, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def mushra(scores: DataFrame, *, listener: str = "listener", trial: str = "trial", condition: str = "condition", score: str = "score", keys: list[str] = ("leg",), hidden: str = "hidden_reference", fails: float = 0.15, low: float = 90.0) -> DataFrame:
    """Mean and interval by leg and condition, after listeners are left out whole who scored over 15 % of the hidden
    references under 90."""
    ref = scores.where(F.col(condition) == hidden).groupBy(listener).agg((F.count_if(F.col(score) < low) / F.count(score)).alias("_f"))
    kept = scores.join(ref.where(F.col("_f") > fails).select(listener), listener, "left_anti")
    return mean_interval(kept, [*keys, condition], score)


def abx(answers: DataFrame, keys: list[str], *, answer: str = "answer", x: str = "x") -> DataFrame:
    """Right answers, trials, their share with Wilson's interval and the chance of as many by guessing.

    Trials are answers that aren't null; a group without any has no share, and its chance is not a number.
    """
    got = answers.groupBy(*keys).agg(F.count_if(F.col(answer) == F.col(x)).alias("right"), F.count(answer).alias("n"))
    low, high = wilson(F.col("right"), F.col("n"))
    return got.withColumns({"share": F.when(F.col("n") > 0, F.col("right") / F.col("n")), "low": low, "high": high, "chance": F.when(F.col("n") > 0, binomial_tail(F.col("right"), F.col("n"))).otherwise(F.lit(math.nan))})


def to_dbfs(x: Column) -> Column:
    """20 log10 |x|, not under -120; 0 and null amplitudes are silent."""
    return F.when(F.abs(x) > 0, F.greatest(F.lit(SILENCE), 20 * F.log10(F.abs(x)))).otherwise(F.lit(SILENCE))


def channel_summary(blocks: DataFrame, keys: list[str], samples: str) -> DataFrame:
    """Peak, RMS, samples and clipped ones over blocks of samples (arrays), with levels in dBFS.

    Each array is folded where it is, in doubles; only sums are shuffled.
    """
    x = F.transform(samples, lambda s: F.abs(s.cast("double")))
    part = blocks.select(*keys, F.array_max(x).alias("_p"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v).alias("_q"), F.size(samples).alias("_n"), F.size(F.filter(x, lambda v: v >= CLIP)).alias("_c"))
    got = part.groupBy(*keys).agg(F.max("_p").alias("peak"), F.sum("_q").alias("_q"), F.sum("_n").alias("samples"), F.sum("_c").alias("clipped"))
    got = got.withColumn("rms", F.sqrt(F.col("_q") / F.col("samples"))).drop("_q")
    return got.withColumn("peak_dbfs", to_dbfs(F.col("peak"))).withColumn("rms_dbfs", to_dbfs(F.col("rms")))


def energy_vector(levels: DataFrame, keys: list[str], level: str, azimuth: str) -> DataFrame:
    """Direction (degrees) and length (0 to 1) of the energy-weighted unit vectors of channels above silence."""
    e = F.pow(F.lit(10.0), F.col(level) / 10)
    used = levels.where(F.col(azimuth).isNotNull() & (F.col(level) > SILENCE)).withColumn("_e", e).withColumn("_a", F.radians(azimuth))
    got = used.groupBy(*keys).agg(F.sum("_e").alias("_e"), F.sum(F.col("_e") * F.cos("_a")).alias("_x"), F.sum(F.col("_e") * F.sin("_a")).alias("_y"))
    return got.select(*keys, F.degrees(F.atan2("_y", "_x")).alias("direction"), F.least(F.lit(1.0), F.hypot("_x", "_y") / F.col("_e")).alias("length"))


def snr(df: DataFrame, keys: list[str], reference: str, actual: str) -> DataFrame:
    """Signal over difference in dB, and the difference's RMS level; the noise is tested before the signal."""
    r, d = F.col(reference).cast("double"), F.col(reference).cast("double") - F.col(actual).cast("double")
    got = df.groupBy(*keys).agg(F.sum(r * r).alias("_s"), F.sum(d * d).alias("_d"), F.count(F.lit(1)).alias("n"))
    db = F.when(F.col("_d") <= 1e-20, F.lit(math.inf)).when(F.col("_s") <= 1e-20, F.lit(-math.inf)).otherwise(10 * F.log10(F.col("_s") / F.col("_d")))
    level = F.when(F.col("_d") / F.col("n") <= 1e-30, F.lit(-math.inf)).otherwise(10 * F.log10(F.col("_d") / F.col("n")))
    return got.select(*keys, db.alias("snr_db"), level.alias("difference_dbfs"))


def score_tally(grid: DataFrame, notes: DataFrame, keys: list[str], *, at: str, reference: str, sung: str, tolerance: float = 50.0) -> DataFrame:
    """By keys and note [start_ms, end_ms): grid points with a reference, sung ones, hits within `tolerance` cents, mean
    deviation.

    Points find the note of their keys (a song, a voice, a stretch of time) by time through one sort, see
    timeline.in_intervals; notes of one key don't overlap. A note without points has no row.
    """
    from tidemark.functions.audio import cents_between, fold_octaves
    from tidemark.operators.timeline import in_intervals

    placed = in_intervals(grid, notes, keys, at, "start_ms", "end_ms", ["note"]).where("note is not null")
    dev = fold_octaves(cents_between(F.col(sung), F.col(reference)))
    counted, heard = F.col(reference) > 0, (F.col(reference) > 0) & (F.col(sung) > 0)
    placed = placed.withColumn("_d", F.when(heard, dev))
    return placed.groupBy(*keys, "note").agg(F.count_if(counted).alias("counted"), F.count_if(heard).alias("sung"), F.count_if(F.abs("_d") <= tolerance).alias("hit"), F.avg("_d").alias("mean_cents"))


def tightest(df: DataFrame, keys: list[str], *, headroom: str, worst: str, threshold: str, seq: list[str]) -> DataFrame:
    """The whole record with the least headroom of each key, of equal ones the first: the recorded headroom, or where
    there is none the worst value less its threshold. Records without a worst value or a threshold are left out."""
    df = df.where(F.col(worst).isNotNull() & F.col(threshold).isNotNull())
    room = F.coalesce(F.col(headroom), F.col(worst) - F.col(threshold))
    return record_of_least(df.withColumn("room", room), keys, "room", seq)


def distinct_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """How many different values of each column a key has; nulls are none."""
    return df.groupBy(*keys).agg(*(F.count_distinct(c).alias(c) for c in columns))


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def gated_loudness(blocks: DataFrame, keys: list[str], power: str, *, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """Integrated loudness of block powers: the mean over blocks above -70 LUFS, then above 10 LU under that mean.

    Two aggregates, the first joined back; null if no block passes.
    """
    lufs = lambda p: -0.691 + 10 * F.log10(p)
    loud = blocks.where((F.col(power) > 0) & (lufs(F.col(power)) > absolute))
    first = loud.groupBy(*keys).agg(F.avg(power).alias("_m"))
    kept = loud.join(first, keys).where(lufs(F.col(power)) > lufs(F.col("_m")) + relative)
    every = blocks.select(*keys).distinct()
    return every.join(kept.groupBy(*keys).agg(lufs(F.avg(power)).alias("integrated"), F.count(F.lit(1)).alias("blocks")), keys, "left")


def loudness_range(short_terms: DataFrame, keys: list[str], lufs: str, *, absolute: float = -70.0, relative: float = -20.0) -> DataFrame:
    """95th less 10th percentile of short-term loudness above the absolute and the relative gate."""
    loud = short_terms.where(F.col(lufs) > absolute)
    first = loud.groupBy(*keys).agg((10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col(lufs) / 10)))).alias("_m"))
    kept = loud.join(first, keys).where(F.col(lufs) > F.col("_m") + relative)
    return kept.groupBy(*keys).agg((F.percentile(lufs, 0.95) - F.percentile(lufs, 0.10)).alias("range_lu"))
