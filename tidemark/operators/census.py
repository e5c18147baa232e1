"""Censuses and reports over streams of units, and documents of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_census(blocks: DataFrame, keys: list[str], values: str, *, entered: str | None = None) -> DataFrame:
    """Bins and zero bins of arrays by key; the fraction is 0 without bins. Blocks never entered count nothing."""
    used = blocks.where(F.col(entered)) if entered else blocks
    part = used.select(*keys, F.size(values).alias("_n"), F.size(F.filter(values, lambda x: x == 0)).alias("_z"))
    got = part.groupBy(*keys).agg(F.sum("_n").alias("bins"), F.sum("_z").alias("zero_bins"))
    return got.withColumn("zero_fraction", F.when(F.col("bins") > 0, F.col("zero_bins") / F.col("bins")).otherwise(F.lit(0.0)))


def tool_census(blocks: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """How many blocks have each flag."""
    return blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def stream_report(units: DataFrame, keys: list[str], *, size: str, samples: str, rate: str, seq: str, first: list[str] = ()) -> DataFrame:
    """By stream: units, bytes, seconds, kbit/s, whether unit sizes vary, and the first known value of some fields."""
    got = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), F.sum(size).alias("bytes"), F.sum(samples).alias("_s"), F.min_by(rate, F.when(F.col(rate).isNotNull(), F.col(seq))).alias("rate"),
        (F.min(size) != F.max(size)).alias("variable"), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"first_{c}") for c in first),
    )
    seconds = F.when(F.col("rate") > 0, F.col("_s") / F.col("rate")).otherwise(F.lit(0.0))
    return got.withColumn("seconds", seconds).withColumn("kbps", F.when(F.col("seconds") > 0, F.col("bytes") * 8 / F.col("seconds") / 1000)).drop("_s")


def band_snr(bins: DataFrame, keys: list[str], band: str, signal: str, noise: str) -> DataFrame:
    """Signal over noise of each band in dB, within 200 dB; noise is tested before the signal."""
    got = bins.groupBy(*keys, band).agg(F.sum(F.col(signal) * F.col(signal)).alias("_s"), F.sum(F.col(noise) * F.col(noise)).alias("_n"))
    db = F.when(F.col("_n") <= 1e-20, F.lit(200.0)).when(F.col("_s") <= 1e-20, F.lit(-200.0)).otherwise(F.least(F.lit(200.0), F.greatest(F.lit(-200.0), 10 * F.log10(F.col("_s") / F.col("_n")))))
    return got.select(*keys, band, db.alias("snr_db"))


def noise_to_mask(bands: DataFrame, keys: list[str], band: str, ratio_db: str) -> DataFrame:
    """Mean (of the powers) and worst noise-to-mask ratio with the worst band, the lower one of equal ones."""
    power = F.pow(F.lit(10.0), F.col(ratio_db) / 10)
    return bands.groupBy(*keys).agg((10 * F.log10(F.avg(power))).alias("mean_db"), F.max(ratio_db).alias("worst_db"), F.min_by(band, F.struct(-F.col(ratio_db), F.col(band))).alias("worst_band"))


def exact_totals(rows: DataFrame, exact: Column, ours: str, theirs: str) -> DataFrame:
    """Rows that count, both totals and their ratio; rows that are not exact don't count."""
    got = rows.where(exact).agg(F.count(F.lit(1)).alias("rows"), F.sum(ours).alias("ours"), F.sum(theirs).alias("theirs"))
    return got.withColumn("ratio", F.when(F.col("theirs") > 0, F.col("ours") / F.col("theirs")))


def coverage(seen: DataFrame, required: DataFrame, gaps: DataFrame, feature: str) -> DataFrame:
    """(feature, state) of the required ones: seen, allowed gap or missing."""
    s, g = seen.select(feature).distinct().withColumn("_s", F.lit(True)), gaps.select(feature).distinct().withColumn("_g", F.lit(True))
    state = F.when(F.col("_s"), "seen").when(F.col("_g"), "allowed gap").otherwise("missing")
    return required.select(feature).distinct().join(s, feature, "left").join(g, feature, "left").select(feature, state.alias("state"))


def ranked_choice(options: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The first option of each key by a tuple of ranks."""
    w = Window.partitionBy(*keys).orderBy(*rank)
    return options.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def classify(rows: DataFrame, path: str, rules: list[tuple[str, str]], otherwise: str = "other") -> DataFrame:
    """`lane` of each path by the first rule (lane, regular expression) that fits."""
    lane = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        lane = F.when(F.col(path).rlike(pattern), name).otherwise(lane)
    return rows.withColumn("lane", F.coalesce(lane, F.lit(otherwise)))


def findings_document(findings: DataFrame, *, tool: str, drop: list[str] = ()) -> DataFrame:
    """One JSON document (column value) per file of findings (rule, level, message, path, line), without those under
    the folders `drop`; its rules are listed once."""
    kept = findings
    for folder in drop:
        kept = kept.where(~F.col("path").startswith(folder.rstrip("/") + "/"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    by = kept.groupBy("path").agg(F.array_sort(F.collect_list(result)).alias("results"), F.array_sort(F.collect_set(F.struct(F.col("rule").alias("id")))).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules").alias("rules")).alias("driver")).alias("tool"), F.col("results").alias("results"))
    return by.select("path", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def footprint(parts: DataFrame, section: str, origin: str, size: str) -> DataFrame:
    """Bytes of each origin in each section and their share of the section's; no share of nothing."""
    got = parts.groupBy(section, origin).agg(F.sum(size).alias("bytes"))
    return got.withColumn("share", F.try_divide("bytes", F.sum("bytes").over(Window.partitionBy(section))))


def edit_summary(units: DataFrame, keys: list[str], *, old: str, new: str, stripped: Column, size: str) -> DataFrame:
    """Units, those whose value an edit changed, those it took out, and the bytes of these."""
    return units.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("changed"), F.count_if(stripped).alias("stripped"), F.sum(F.when(stripped, F.col(size)).otherwise(0)).cast("long").alias("bytes"))
