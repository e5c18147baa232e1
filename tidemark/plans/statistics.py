"""Queries of the aggregation, listening-test, metering and scalar families on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import audio
from tidemark.operators import stats, timeline
from tidemark.plans.series import query, t

PARTS = "p_partkey, p_brand, p_size, p_retailprice"


@query("a1_record_of_least", "SELECT l_returnflag, arg_min(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS l_orderkey, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")
def a1(spark, d):
    x = t(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.record_of_least(x, ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"]).select("l_returnflag", "l_orderkey", "l_extendedprice")


@query("a2_spread", """
SELECT event_type, min(value) AS best, count(value) AS runs, round(CASE WHEN min(value) > 0 THEN (max(value) - min(value)) / min(value) ELSE 0 END, 6) AS spread FROM events GROUP BY 1""")
def a2(spark, d):
    from tidemark.operators.compare import best_of_runs

    return best_of_runs(t(spark, d, "events"), ["event_type"], "value").withColumn("spread", F.round("spread", 6))


@query("a3_count_by_category", """
SELECT event_type, count(*) FILTER (WHERE value < 10) AS low, count(*) FILTER (WHERE value >= 10 AND value < 100) AS middle, count(*) FILTER (WHERE value >= 100) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def a3(spark, d):
    v = F.col("value")
    return t(spark, d, "events").groupBy("event_type").agg(F.count_if(v < 10).alias("low"), F.count_if((v >= 10) & (v < 100)).alias("middle"), F.count_if(v >= 100).alias("high"), F.count_distinct("user_id").alias("users"))


@query("a4_slowest_multiple", """
WITH x AS (SELECT event_type, event_id, CASE WHEN value > 0 THEN coalesce(nullif(user_id % 40, 0), 32) / value END AS m FROM events)
SELECT event_type, arg_min(event_id, (m, event_id)) AS event_id, round(min(m), 6) AS multiple FROM x WHERE m IS NOT NULL GROUP BY 1""")
def a4(spark, d):
    m = audio.real_time_multiple(F.col("value"), (F.col("user_id") % 40).cast("double"))
    x = t(spark, d, "events").select("event_type", "event_id", m.alias("multiple"))
    return stats.record_of_least(x, ["event_type"], "multiple", ["event_id"]).withColumn("multiple", F.round("multiple", 6))


@query("a6_record_of_most", "SELECT p_brand, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS p_partkey, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1")
def a6(spark, d):
    return stats.record_of_most(t(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", ["p_partkey"])


@query("a7_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def a7(spark, d):
    return stats.keep_first(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("a8_extremes_with_owners", """
SELECT event_type, min(value) AS least, arg_min(event_id, (value, event_id)) AS least_owner, max(value) AS most, arg_min(event_id, (-value, event_id)) AS most_owner, min(value) = max(value) AS constant FROM events GROUP BY 1""")
def a8(spark, d):
    return stats.extremes(t(spark, d, "events"), ["event_type"], "value", "event_id")


@query("a9_channel_floors", """
WITH x AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN [l_quantity, l_extendedprice] ELSE [l_quantity, l_extendedprice, l_discount] END AS c FROM lineitem),
n AS (SELECT l_suppkey, arg_max(len(c), (seq, len(c))) AS n FROM x GROUP BY 1),
y AS (SELECT l_suppkey, unnest(range(len(c))) AS channel, unnest(c) AS v FROM x JOIN n USING (l_suppkey) WHERE len(c) = n)
SELECT l_suppkey, channel::INT AS channel, floor(min(v) - 1)::BIGINT AS floor FROM y GROUP BY 1, 2""")
def a9(spark, d):
    pair = F.array("l_quantity", "l_extendedprice")
    x = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("s"), F.when(F.col("l_linenumber") % 2 == 0, pair).otherwise(F.concat(pair, F.array("l_discount"))).alias("c"))
    return stats.channel_floors(x.withColumn("seq", F.struct("s", F.size("c"))), ["l_suppkey"], "c", "seq")


@query("a15_sorted_sets", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1")
def a15(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("a16_channel_summary", """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT label, max(abs(v)) AS peak, sum(v * v) AS q, count(*) AS n, count(*) FILTER (WHERE abs(v) >= 32767 / 32768) AS c FROM x GROUP BY 1)
SELECT label, n AS samples, c AS clipped, round(peak, 6) AS peak, round(sqrt(q / n), 6) AS rms, round(greatest(-120, 20 * log10(peak)), 4) AS peak_dbfs, round(greatest(-120, 20 * log10(sqrt(q / n))), 4) AS rms_dbfs FROM g""")
def a16(spark, d):
    got = stats.channel_summary(t(spark, d, "embeddings"), ["label"], "embedding")
    return got.select("label", "samples", "clipped", *(F.round(c, n).alias(c) for c, n in (("peak", 6), ("rms", 6), ("peak_dbfs", 4), ("rms_dbfs", 4))))


@query("a17_energy_vector", """
WITH x AS (SELECT l_suppkey, 10 ^ ((l_quantity - 100) / 10) AS e, radians(l_extendedprice % 360 - 180) AS a FROM lineitem),
g AS (SELECT l_suppkey, sum(e) AS e, sum(e * cos(a)) AS x, sum(e * sin(a)) AS y FROM x GROUP BY 1)
SELECT l_suppkey, round(degrees(atan2(y, x)), 4) AS direction, round(least(1, sqrt(x * x + y * y) / e), 6) AS length FROM g""")
def a17(spark, d):
    x = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") - 100).alias("db"), (F.col("l_extendedprice") % 360 - 180).alias("az"))
    return stats.energy_vector(x, ["l_suppkey"], "db", "az").select("l_suppkey", F.round("direction", 4).alias("direction"), F.round("length", 6).alias("length"))


@query("a18_integrated_loudness", """
WITH b AS (SELECT user_id, value / 100000 AS p FROM events), l AS (SELECT * FROM b WHERE p > 0 AND -0.691 + 10 * log10(p) > -70),
m AS (SELECT user_id, avg(p) AS m FROM l GROUP BY 1), k AS (SELECT user_id, p FROM l JOIN m USING (user_id) WHERE -0.691 + 10 * log10(p) > -0.691 + 10 * log10(m) - 10)
SELECT user_id, round(-0.691 + 10 * log10(avg(p)), 5) AS integrated, count(*) AS blocks FROM k GROUP BY 1""")
def a18(spark, d):
    b = t(spark, d, "events").select("user_id", (F.col("value") / 100_000).alias("p"))
    return stats.gated_loudness(b, ["user_id"], "p").withColumn("integrated", F.round("integrated", 5)).where("blocks is not null")


@query("a19_loudness_range", """
WITH b AS (SELECT user_id, -0.691 + 10 * log10(value / 100000) AS l FROM events), x AS (SELECT * FROM b WHERE l > -70), m AS (SELECT user_id, 10 * log10(avg(10 ^ (l / 10))) AS m FROM x GROUP BY 1)
SELECT user_id, round(quantile_cont(l, 0.95) - quantile_cont(l, 0.10), 5) AS range_lu FROM x JOIN m USING (user_id) WHERE l > m - 20 GROUP BY 1""")
def a19(spark, d):
    b = t(spark, d, "events").select("user_id", (-0.691 + 10 * F.log10(F.col("value") / 100_000)).alias("l"))
    return stats.loudness_range(b, ["user_id"], "l").withColumn("range_lu", F.round("range_lu", 5))


@query("a21_snr", """
WITH g AS (SELECT l_shipdate, sum(l_extendedprice * l_extendedprice) AS s, sum((l_extendedprice * l_discount) ^ 2) AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_shipdate, CASE WHEN d <= 1e-20 THEN 'infinity' ELSE round(10 * log10(s / d), 4)::VARCHAR END = 'infinity' AS clean, CASE WHEN d > 1e-20 THEN round(10 * log10(s / d), 4) END AS snr_db FROM g""")
def a21(spark, d):
    x = t(spark, d, "lineitem").select("l_shipdate", "l_extendedprice", (F.col("l_extendedprice") - F.col("l_extendedprice") * F.col("l_discount")).alias("a"))
    got = stats.snr(x.withColumn("a", F.when(F.abs(F.col("a") - F.col("l_extendedprice")) < 1e-11, F.col("l_extendedprice")).otherwise(F.col("a"))), ["l_shipdate"], "l_extendedprice", "a")
    clean = F.col("snr_db") == float("inf")
    return got.select("l_shipdate", clean.alias("clean"), F.when(~clean, F.round("snr_db", 4)).alias("snr_db"))


@query("a24_score_tally", """
WITH g AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, 220 + user_id AS ref, CASE WHEN event_type = 'error' THEN 0 ELSE 220 + value END AS sung FROM events),
x AS (SELECT user_id, ms // 3600000 AS note, ref, sung, CASE WHEN sung > 0 THEN 1200 * log2(sung / ref) END AS c FROM g WHERE ms % 3600000 < 3000000),
y AS (SELECT *, c - 1200 * trunc(c / 1200) AS f FROM x), z AS (SELECT *, CASE WHEN f > 600 THEN f - 1200 WHEN f <= -600 THEN f + 1200 ELSE f END AS dev FROM y)
SELECT user_id, note, count(*) FILTER (WHERE ref > 0) AS counted, count(*) FILTER (WHERE sung > 0) AS sung, count(*) FILTER (WHERE abs(dev) <= 50) AS hit, round(avg(dev), 5) AS mean_cents FROM z GROUP BY 1, 2""")
def a24(spark, d):
    """Every user sings against a score of their own: a note an hour, of 50 minutes, over all of their events."""
    hour = 3_600_000
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    g = t(spark, d, "events").select("user_id", ms.alias("ms"), (220 + F.col("user_id")).cast("double").alias("ref"), F.when(F.col("event_type") == "error", 0.0).otherwise(220 + F.col("value")).alias("sung"))
    notes = g.select("user_id", F.floor(F.col("ms") / hour).alias("note")).distinct().select("user_id", "note", (F.col("note") * hour).alias("start_ms"), (F.col("note") * hour + 3_000_000).alias("end_ms"))
    return stats.score_tally(g, notes, ["user_id"], at="ms", reference="ref", sung="sung").withColumn("mean_cents", F.round("mean_cents", 5))


@query("a25_supported_median", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(median(o_totalprice), 4) END AS median FROM orders GROUP BY 1")
def a25(spark, d):
    return stats.supported_median(t(spark, d, "orders"), ["o_custkey"], "o_totalprice").withColumn("median", F.round("median", 4))


@query("a26_nearest_rank", "SELECT l_shipmode AS k, p FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, quantile_disc(l_extendedprice, 0.95) AS p FROM lineitem GROUP BY 1)")
def a26(spark, d):
    x = t(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), "l_extendedprice")
    return stats.nearest_rank(x, ["k"], "l_extendedprice")


T_TABLE = "[" + ", ".join(map(str, stats.T95)) + "]"


@query("a27_mean_interval", f"""
WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS deviation FROM orders GROUP BY 1)
SELECT o_custkey, n, round(mean, 3) AS mean, round(deviation, 3) AS deviation,
  round(CASE WHEN n >= 2 THEN coalesce({T_TABLE}[greatest(1, n - 1)], 1.96) * deviation / sqrt(n) END, 3) AS half_width FROM g""")
def a27(spark, d):
    got = stats.mean_interval(t(spark, d, "orders"), ["o_custkey"], "o_totalprice")
    return got.select("o_custkey", "n", *(F.round(c, 3).alias(c) for c in ("mean", "deviation", "half_width")))


@query("a28_wilson", """
WITH g AS (SELECT user_id, count(*) FILTER (WHERE value > 50) AS r, count(*) AS n, 1.959963984540054 AS z FROM events GROUP BY 1), x AS (SELECT *, r / n AS p FROM g)
SELECT user_id, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low,
  round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM x""")
def a28(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("r"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("r"), F.col("n"))
    return g.select("user_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("a30_mushra", """
WITH s AS (SELECT user_id AS listener, event_type AS condition, user_id % 3 AS leg, least(100, 100 - value / 10) AS score FROM events),
f AS (SELECT listener FROM s WHERE condition = 'signup' GROUP BY 1 HAVING count(*) FILTER (WHERE score < 90) / count(*) > 0.15),
k AS (SELECT * FROM s WHERE listener NOT IN (SELECT listener FROM f))
SELECT leg, condition, count(*) AS n, round(avg(score), 5) AS mean FROM k GROUP BY 1, 2""")
def a30(spark, d):
    s = t(spark, d, "events").select(F.col("user_id").alias("listener"), F.col("event_type").alias("condition"), (F.col("user_id") % 3).alias("leg"), F.least(F.lit(100.0), 100 - F.col("value") / 10).alias("score"))
    return stats.mushra(s, hidden="signup").select("leg", "condition", "n", F.round("mean", 5).alias("mean"))


@query("a31_abx", """
WITH a AS (SELECT event_type AS system, user_id % 4 AS leg, event_id % 2 = user_id % 2 AS hit FROM events), g AS (SELECT leg, system, count(*) FILTER (WHERE hit) AS "right", count(*) AS n FROM a GROUP BY 1, 2)
SELECT leg, system, "right", n, round("right" / n, 6) AS share, round((SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM (SELECT unnest(range("right", n + 1)) AS k)), 6) AS chance FROM g""")
def a31(spark, d):
    e = t(spark, d, "events")
    got = stats.abx(e.select(F.col("event_type").alias("system"), (F.col("user_id") % 4).alias("leg"), (F.col("event_id") % 2).alias("answer"), (F.col("user_id") % 2).alias("x")), ["leg", "system"])
    return got.select("leg", "system", "right", "n", F.round("share", 6).alias("share"), F.round("chance", 6).alias("chance"))


@query("o5_last_n", """
WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id FROM x WHERE rn <= 5""")
def o5(spark, d):
    return stats.last_n(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("p8_gates", """
SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN abs(p_retailprice - 1000) <= 150 ELSE p_retailprice <= 1000 END, false) AS ok FROM part""")
def p8(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", audio.gate(F.col("p_retailprice"), F.lit(1000.0), F.when(F.col("p_size") % 3 == 0, F.lit(150.0))).alias("ok"))


@query("p13_unpivot", """
SELECT l_orderkey, l_linenumber, l_partkey, kind, v FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (v FOR kind IN (quantity, discount, tax))""")
def p13(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return x.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["quantity", "discount", "tax"], "kind", "v")


@query("fn_levels_and_pitch", """
WITH x AS (SELECT event_id, value AS v, CASE WHEN value > 0 THEN value END AS p, (value - 100) / 10 AS c FROM events)
SELECT event_id, round(CASE WHEN abs(c) > 0 THEN greatest(-120, 20 * log10(abs(c))) ELSE -120 END, 5) AS dbfs, round(CASE WHEN v > 1e-10 THEN 20 * log10(v) ELSE -200 END, 5) AS db,
  round(least(1, greatest(0, (c + 60) / 60)), 6) AS fraction, round(69 + 12 * log2(p / 440), 5) AS midi, round(440 * 2 ^ ((c - 69) / 12), 6) AS hz,
  round(1200 * log2(p / 440), 4) AS cents, floor(v + 0.5) AS up, round(13 * atan(0.76 * v / 1000) + 3.5 * atan((v / 1000) ^ 2 / 56.25), 6) AS bark,
  least(31, greatest(1, (sign(v / 10) * floor(abs(v / 10) + 0.5))::INT)) AS dialnorm, round((c / 50) * (c / 50) * (3 - 2 * (c / 50)), 6) AS smooth FROM x""")
def fn_levels(spark, d):
    v, c = F.col("value"), (F.col("value") - 100) / 10
    return t(spark, d, "events").select(
        "event_id", F.round(stats.to_dbfs(c), 5).alias("dbfs"), F.round(audio.to_db(v), 5).alias("db"), F.round(audio.meter_fraction(c, -60.0), 6).alias("fraction"),
        F.round(audio.midi_from_hz(v), 5).alias("midi"), F.round(audio.hz_from_midi(c), 6).alias("hz"), F.round(audio.cents_between(v, F.lit(440.0)), 4).alias("cents"),
        audio.half_up(v).cast("double").alias("up"), F.round(audio.bark(v), 6).alias("bark"), audio.dialnorm(-v / 10).alias("dialnorm"), F.round(audio.smoothstep(c / 50), 6).alias("smooth"),
    )


@query("fn_text_and_time", """
SELECT page_id, translate(url, '/', '_') AS slug, printf('[%02d:%02d.%02d]', (page_id * 12345 // 10) // 6000, ((page_id * 12345 // 10) // 100) % 60, (page_id * 12345 // 10) % 100) AS lrc,
  try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS DOUBLE) AS number FROM pages""")
def fn_text(spark, d):
    return t(spark, d, "pages").select("page_id", audio.branch_slug(F.col("url")).alias("slug"), audio.lrc_time(F.col("page_id") * 12345).alias("lrc"), audio.strict_number(F.regexp_extract("url", "/([0-9]+)", 1)).alias("number"))


@query("fn_gain_words", """
WITH w AS (SELECT DISTINCT l_partkey % 256 AS word FROM lineitem)
SELECT word, 2.0 ^ (CASE WHEN word // 32 >= 4 THEN word // 32 - 8 ELSE word // 32 END) * (32 + word % 32) / 32 AS dynrng,
  2.0 ^ (CASE WHEN word // 16 >= 8 THEN word // 16 - 16 ELSE word // 16 END + 1) * (16 + word % 16) / 32 AS compr FROM w""")
def fn_gain(spark, d):
    w = t(spark, d, "lineitem").select((F.col("l_partkey") % 256).alias("word")).distinct()
    return w.select("word", audio.dynrng_gain(F.col("word")).alias("dynrng"), audio.compr_gain(F.col("word")).alias("compr"))
