"""Queries of the stateful rules; those with two clamps or smoothing are folds, which SQL has no form for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.series import query, t
from tidemark.operators import dynamics, ordered
from tidemark.streaming import folds, timers, windows


def events(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t(spark, d, "events").withColumn("at_ms", ms.cast("double")).withColumn("key", F.col("user_id"))


#: The stand-in's rows in the order of each series, by place.
STEPS = "x AS (SELECT user_id AS key, value, (epoch_us(ts) // 1000)::DOUBLE AS at_ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events)"


@query("t1_level_meter", f"""
WITH RECURSIVE {STEPS},
b AS (SELECT key, r, at_ms, value / 100 AS s, value / 500 AS p, greatest(-120.0, 20 * log10(value / 500)) AS db, (value / 500) ^ 2 AS power FROM x),
m(key, r, at_ms, peak, held, quiet, power, clipped) AS (
  SELECT key, r, at_ms, greatest(db, -120.0), greatest(db, -120.0), 0.0::DOUBLE, (1 - exp(-s / 0.3)) * power, p >= 32767 / 32768 FROM b WHERE r = 1
  UNION ALL SELECT b.key, b.r, b.at_ms, greatest(b.db, m.peak - 20 * s, -120.0),
    CASE WHEN db >= held THEN db WHEN quiet + s > 1.2 THEN greatest(b.db, m.peak - 20 * s, -120.0, held - 20 * s) ELSE held END,
    CASE WHEN db >= held THEN 0.0 ELSE quiet + s END, m.power + (1 - exp(-s / 0.3)) * (b.power - m.power), clipped OR p >= 32767 / 32768
  FROM m JOIN b ON b.key = m.key AND b.r = m.r + 1)
SELECT key, at_ms, round(peak, 6) AS peak_db, round(held, 6) AS hold_db, round(CASE WHEN power > 0 THEN greatest(-120.0, 10 * log10(power)) ELSE -120.0 END, 6) AS rms_db, clipped FROM m""")
def t1(spark, d):
    """Each event is a block of value / 100 seconds."""
    e = events(spark, d).select("key", "event_id", "at_ms", (F.col("value") / 100).alias("seconds"), (F.col("value") / 500).alias("peak"), F.pow(F.col("value") / 500, F.lit(2.0)).alias("power"))
    got = folds.over_table(e, "key", ["at_ms", "event_id"], folds.level_meter(), f"key long, at_ms {folds.METER}")
    return got.withColumns({c: F.round(c, 6) for c in ("peak_db", "hold_db", "rms_db")})


SPEECH = dynamics.PROFILES["speech"]
#: A 48 kHz block of 256 samples and a frame of six.
BLOCK_MS = 256 / 48
#: The words of five fraction bits and of four, with their gains.
RANGE_WORDS = "words AS (SELECT w, 2.0 ^ (CASE WHEN w >= 128 THEN w // 32 - 8 ELSE w // 32 END) * (1 + (w % 32) / 32) AS g FROM range(256) t(w))"
HEAVY_WORDS = "words AS (SELECT w, 2.0 ^ (CASE WHEN w >= 128 THEN w // 16 - 16 ELSE w // 16 END) * (1 + (w % 16) / 16) AS g FROM range(256) t(w))"


@query("t3_compressor", f"""
WITH RECURSIVE {STEPS}, {RANGE_WORDS},
l AS (SELECT key, r, at_ms, -value / 8 + (event_id % 31 + 1) - 31 AS level FROM x),
c AS (SELECT *, CASE WHEN level < -31 THEN least(15.0, (-31 - level) / 5) WHEN level <= -26 THEN 0.0 WHEN level <= -16 THEN -(level + 26) / 2 ELSE -5.0 - (level + 16) / 20 END AS target FROM l),
m(key, r, at_ms, gain) AS (SELECT key, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM c WHERE r = 1
  UNION ALL SELECT c.key, c.r, c.at_ms, gain + (target - gain) * (1 - exp(-(256.0 / 48) / CASE WHEN target < gain THEN 10.0 ELSE 1000.0 END)) FROM m JOIN c ON c.key = m.key AND c.r = m.r + 1)
SELECT key, at_ms, round(gain, 6) AS gain_db, arg_min(w, (abs(g - 10 ^ (gain / 20)), -g))::INT AS word FROM m, words WHERE r > 0 GROUP BY key, r, at_ms, gain""")
def t3(spark, d):
    """The speech curve over levels of value / 8 dB under full scale, a block each; the gain as its nearest word."""
    level = dynamics.referred(-F.col("value") / 8, F.col("event_id") % 31 + 1)
    e = events(spark, d).select("key", "event_id", "at_ms", dynamics.static_gain(SPEECH, level).alias("target_db"))
    got = folds.over_table(e, "key", ["at_ms", "event_id"], folds.range_control(SPEECH, BLOCK_MS), "key long, at_ms double, gain_db double")
    return got.select("key", "at_ms", F.round("gain_db", 6).alias("gain_db"), dynamics.encode(F.col("gain_db"), dynamics.RANGE).alias("word"))


@query("t3_heavy_compressor", f"""
WITH RECURSIVE {STEPS}, {HEAVY_WORDS},
l AS (SELECT key, r, at_ms, -value / 8 AS peak, CASE WHEN event_id % 40 BETWEEN 1 AND 31 THEN event_id % 40 ELSE 31 END AS d FROM x),
c AS (SELECT *, least(-20.0 + d - (d - 31 + 11), -0.5 - peak - (d - 31 + 11)) AS target FROM l),
m(key, r, at_ms, gain) AS (SELECT key, r, at_ms, target FROM c WHERE r = 1
  UNION ALL SELECT c.key, c.r, c.at_ms, CASE WHEN target <= gain THEN target ELSE least(target, gain + 20 * 0.032) END FROM m JOIN c ON c.key = m.key AND c.r = m.r + 1)
SELECT key, at_ms, round(gain, 6) AS gain_db, coalesce(arg_max(w, g) FILTER (WHERE g <= 10 ^ (gain / 20) * (1 + 1e-10)), 128)::INT AS word FROM m, words GROUP BY key, r, at_ms, gain""")
def t3_heavy(spark, d):
    """Peaks of value / 8 dB under full scale, a frame each: instant attack, 20 dB a second of release, words that never pass the gain."""
    e = events(spark, d).select("key", "event_id", "at_ms", dynamics.heavy_target(-F.col("value") / 8, F.col("event_id") % 40).alias("target_db"))
    got = dynamics.heavy_gain(e, ["key"], ["at_ms", "event_id"], "target_db", 20 * 6 * BLOCK_MS / 1000)
    return got.select("key", "at_ms", F.round("gain_db", 6).alias("gain_db"), dynamics.encode(F.col("gain_db"), dynamics.HEAVY, at_most=True).alias("word"))


@query("t4_clock_sync", """
WITH x AS (SELECT user_id AS key, event_id, trunc(value * 10)::BIGINT AS o, trunc(value * 100)::BIGINT AS e, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
b AS (SELECT key, (r - 1) // 8 + 1 AS bursts, arg_min(o, (e, r)) AS offset_us, min(e) AS error_us FROM x GROUP BY 1, 2 HAVING count(*) = 8),
n AS (SELECT *, bursts > 8 AND abs(offset_us - lag(offset_us) OVER (PARTITION BY key ORDER BY bursts)) <= 1000 AS near FROM b)
SELECT key, bursts, offset_us, error_us, bool_or(coalesce(near, false)) OVER (PARTITION BY key ORDER BY bursts ROWS UNBOUNDED PRECEDING) AS settled FROM n""")
def t4(spark, d):
    e = events(spark, d).select("key", "event_id", "at_ms", (F.col("value") * 10).cast("long").alias("offset_us"), (F.col("value") * 100).cast("long").alias("error_us"))
    return ordered.bursts(e, ["key"], ["at_ms", "event_id"], "offset_us", "error_us")


@query("t7_late_bursts", """
WITH x AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS ms, trunc((epoch_us(ts) // 1000)::DOUBLE * 1000 - value * 100)::BIGINT AS due, (epoch_us(ts) // 1000) * 1000 AS slot FROM events),
y AS (SELECT *, due < slot AS l, due < slot - 15999 AS d FROM x)
SELECT key, due AS due_us, CASE WHEN d THEN 'drop' WHEN due <= slot + 10666 THEN 'play' ELSE 'wait' END AS action, count(*) FILTER (WHERE l) OVER w AS late, count(*) FILTER (WHERE d) OVER w AS dropped
FROM y WINDOW w AS (PARTITION BY key ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)""")
def t7(spark, d):
    e = events(spark, d).select("key", "event_id", "at_ms", (F.col("at_ms") * 1000 - F.col("value") * 100).cast("long").alias("due_us"), (F.col("at_ms") * 1000).cast("long").alias("slot_us"), F.lit(21_333).alias("period_us"))
    return ordered.due_actions(e, ["key"], ["at_ms", "event_id"], "due_us", "slot_us", "period_us").select("key", "due_us", "action", "late", "dropped")


@query("t22_queue_model")
def t22(spark, d):
    e = events(spark, d).select("key", "event_id", "at_ms", (F.col("value") * 100_000).alias("amount"))
    return folds.over_table(e, "key", ["at_ms", "event_id"], folds.queue_model(capacity=20_000_000, rate_per_ms=0.5), "key long, at_ms double, queued double, underruns long, dry_ms double, least double")


@query("t27_governor", """
WITH RECURSIVE x AS (SELECT event_type AS key, epoch_us(ts) AS at_us, value * 600 AS cost, (event_id % 97 * 200)::BIGINT AS late, event_id % 211 = 0 AS missed,
    row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS r FROM events),
m(key, r, at_us, started, since, rose, slow, dwell, costs, bad, falls, rises) AS (
  SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false, 7200000000::BIGINT, []::DOUBLE[], []::INT[], 0::BIGINT, 0::BIGINT FROM x
  UNION ALL SELECT key, r, at_us, started, CASE WHEN fall OR rise THEN at_us ELSE since END, CASE WHEN rise THEN at_us ELSE rose END, CASE WHEN fall THEN true WHEN rise THEN false ELSE slow END,
    CASE WHEN fall AND rose IS NOT NULL AND at_us - rose < 43200000000 THEN least(115200000000, 2 * dwell) ELSE dwell END, CASE WHEN fall OR rise THEN []::DOUBLE[] ELSE costs END,
    CASE WHEN fall OR rise THEN []::INT[] ELSE bad END, falls + fall::BIGINT, rises + rise::BIGINT FROM (
    SELECT *, judged AND NOT slow AND len(costs) = 20 AND (list_avg(costs) / 50000 > 0.7 OR list_sum(bad) >= 4) AS fall,
      judged AND slow AND len(costs) = 20 AND list_sum(bad) = 0 AND list_avg(costs) / 50000 < 0.6 AND at_us - since >= dwell AS rise FROM (
      SELECT key, r, at_us, started, judged, CASE WHEN judged THEN coalesce(since, at_us) ELSE since END AS since, rose, slow,
        CASE WHEN judged AND NOT slow AND at_us - coalesce(since, at_us) >= 43200000000 THEN 7200000000 ELSE dwell END AS dwell,
        CASE WHEN judged THEN list_append(costs, cost)[-20:] ELSE costs END AS costs, CASE WHEN judged THEN list_append(bad, (late > 15000 OR missed)::INT)[-20:] ELSE bad END AS bad, falls, rises FROM (
        SELECT x.key, x.r, x.at_us, coalesce(started, x.at_us) AS started, x.at_us - coalesce(started, x.at_us) >= 60000000 AS judged, since, rose, slow, dwell, costs, bad, falls, rises, cost, late, missed
        FROM m JOIN x ON x.key = m.key AND x.r = m.r + 1))))
SELECT key, at_us, r AS updates, slow, dwell AS dwell_us, falls, rises FROM m WHERE r > 0""")
def t27(spark, d):
    """A view an event type: costs of 600 times the value, times a thousandth of a day's scale instead of seconds."""
    e = t(spark, d, "events").select(F.col("event_type").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), (F.col("value") * 600).alias("cost_us"), (F.col("event_id") % 97 * 200).alias("late_us"), F.when(F.col("event_id") % 211 == 0, 1).otherwise(0).alias("missed"))
    fold = folds.governor(dwell_us=7_200_000_000, most_us=115_200_000_000, flap_us=43_200_000_000, grace_us=60_000_000)
    return folds.over_table(e, "key", ["at_us", "event_id"], fold, f"key string, {folds.GOVERNOR}")


@query("t5_playhead", """
WITH x AS (SELECT user_id AS key, event_id, (epoch_us(ts) // 1000) * 1000 AS at_us, value, event_type <> 'signup' AS asks FROM events),
y AS (SELECT *, last_value(CASE WHEN NOT asks THEN at_us END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN NOT asks THEN value END IGNORE NULLS) OVER w AS p FROM x WINDOW w AS (PARTITION BY key ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING))
SELECT key, at_us, CASE WHEN a IS NOT NULL THEN greatest(0.0, p + (at_us - a) / 1000) END AS position_ms FROM y WHERE asks""")
def t5(spark, d):
    e = events(spark, d).select("key", "event_id", "at_ms", (F.col("at_ms") * 1000).cast("long").alias("at_us"), F.col("value").alias("position_ms"), F.lit(1.0).alias("speed"), (F.col("event_type") != "signup").alias("is_query"))
    return ordered.places(e, ["key"], ["at_us", "event_id"], "at_us", "position_ms", "speed", "is_query").select("key", "at_us", "position_ms")


@query("t11_drift_servo", """
WITH x AS (SELECT user_id AS key, (epoch_us(ts) // 1000)::DOUBLE AS at_ms, least(0.05, greatest(-0.05, 0.01 * (value - 50))) AS want, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
s AS (SELECT a.key, a.at_ms, a.r, sum(0.1 * 0.9 ^ (a.r - b.r) * b.want) AS trim FROM x a JOIN x b ON a.key = b.key AND b.r <= a.r GROUP BY 1, 2, 3)
SELECT key, at_ms, round(least(2.0, greatest(0.5, 1 + trim)), 9) AS ratio FROM s""")
def t11(spark, d):
    e = events(spark, d).select("key", "event_id", "at_ms", (F.col("value") - 50).alias("error"))
    got = folds.over_table(e, "key", ["at_ms", "event_id"], folds.drift_servo(), "key long, at_ms double, ratio double")
    return got.withColumn("ratio", F.round("ratio", 9))


@query("t12_silence_watch", """
WITH x AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events), y AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS q FROM x)
SELECT user_id AS key, ms::DOUBLE AS at_ms, coalesce(q, 0)::DOUBLE AS quiet_ms, coalesce(q > 7200000, false) AS timed_out FROM y""")
def t12(spark, d):
    e = events(spark, d).select("key", "event_id", "at_ms")
    return ordered.quiet_before(e, ["key"], ["at_ms", "event_id"], "at_ms", 7_200_000.0).drop("event_id")


@query("t12_silences", """
WITH x AS (SELECT DISTINCT user_id AS key, epoch_us(ts) // 1000 AS ms FROM events), y AS (SELECT key, ms, lead(ms) OVER (PARTITION BY key ORDER BY ms) AS n FROM x)
SELECT key, ms AS last_ms, ms + 7200000 AS known_ms, true AS silent FROM y WHERE n IS NULL OR n > ms + 7200000 UNION ALL SELECT key, ms, n, false FROM y WHERE n > ms + 7200000""")
def t12_silences(spark, d):
    e = events(spark, d).select("key", F.col("at_ms").cast("long").alias("at_ms"))
    return timers.silences_of_table(e, ["key"], "at_ms", timeout_ms=7_200_000)


@query("t23_in_order_bytes")
def t23(spark, d):
    e = events(spark, d).select("key", "event_id", "at_ms", (F.col("event_id") * 10 - F.col("event_id") % 3 * 900).alias("first"), (F.col("event_id") * 10 + 900).alias("last"))
    return folds.over_table(e, "key", ["at_ms", "event_id"], folds.in_order(), "key long, at_ms double, end long, taken boolean")


@query("t30_hold_first", """
WITH x AS (SELECT user_id, event_id, (epoch_us(ts) // 1000)::DOUBLE AS ms FROM events), y AS (SELECT user_id AS key, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS at_ms, ms AS released_ms FROM x)
SELECT * FROM y WHERE at_ms IS NOT NULL""")
def t30(spark, d):
    e = events(spark, d).select("key", "event_id", "at_ms")
    return ordered.held_until_next(e, ["key"], ["at_ms", "event_id"], "at_ms").drop("event_id")


@query("w14_notes")
def w14(spark, d):
    """A voice a user: each of their events is a point of the grid; a row at the end closes the last note."""
    e = t(spark, d, "events").select(F.col("user_id").alias("key"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("grid_idx"), F.when(F.col("event_type") == "error", 0.0).otherwise(440 + F.col("value") / 10).alias("hz"))
    e = e.unionByName(e.groupBy("key").agg((F.max("grid_idx") + 1).alias("grid_idx"), F.lit(-1.0).alias("hz")))
    return folds.over_table(e, "key", ["grid_idx"], folds.notes(), "key long, start_idx long, end_idx long, hz double")


@query("t14_last_write_wins", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def t14(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("seq"))
    return windows.last_write(e, ["user_id", "event_type"], "seq").drop("seq")


@query("t15_override", """
WITH x AS (SELECT event_id, user_id, ts, value, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 END AS flag, CASE WHEN event_type = 'purchase' THEN value END AS pushed FROM events),
y AS (SELECT *, last_value(flag IGNORE NULLS) OVER w AS on_, last_value(pushed IGNORE NULLS) OVER w AS p FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN on_ = 1 THEN p ELSE value END AS value FROM y""")
def t15(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", F.col("value").alias("authored"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("pushed"), (F.col("event_type") == "signup").alias("released"))
    return windows.override(e, ["user_id"], ["ts", "event_id"], "authored", "pushed", "released").select("event_id", "value")


@query("t26_tumbling_peaks", 'SELECT user_id, (event_id // 64)::BIGINT AS "window", max(abs(value - 100)) AS peak FROM events GROUP BY 1, 2')
def t26(spark, d):
    return windows.tumbling_peaks(t(spark, d, "events").withColumn("x", F.col("value") - 100), ["user_id"], "event_id", "x", 64)
