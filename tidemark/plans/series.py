"""Queries of the trailing-window and comparison families on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import compare, graph, stats, timeline, trailing


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def r6(*names):
    return {n: F.round(n, 6) for n in names}


@query("w1_trailing_mean", """
SELECT event_id, event_type, value,
  round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS baseline
FROM events""")
def w1(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return trailing.trailing_mean(e, ["event_type"], ["ts", "event_id"], "value").withColumns(r6("baseline")).drop("ts")


@query("w2_trailing_channels", """
WITH o AS (SELECT l_orderkey, l_suppkey, l_shipdate, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
w AS (SELECT l_suppkey, l_orderkey, l_linenumber,
  avg(l_quantity) OVER w AS q, avg(l_extendedprice) OVER w AS p, count(*) OVER w AS n
  FROM o WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT l_suppkey, l_orderkey, l_linenumber, round(q, 6) AS baseline_quantity, round(p, 4) AS baseline_price FROM w""")
def w2(spark, d):
    x = t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", F.array("l_quantity", "l_extendedprice").alias("channels"))
    got = trailing.trailing_channels(x, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"], "channels")
    return got.select("l_suppkey", "l_orderkey", "l_linenumber", F.round(F.get("baseline", 0), 6).alias("baseline_quantity"), F.round(F.get("baseline", 1), 4).alias("baseline_price"))


@query("w3_like_for_like", """
WITH w AS (SELECT event_id, user_id,
  avg(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS same,
  avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS everyone FROM events)
SELECT event_id, round(coalesce(same, everyone), 6) AS baseline,
  CASE WHEN same IS NOT NULL THEN 'same machine' WHEN everyone IS NOT NULL THEN 'all machines' ELSE 'none' END AS basis FROM w""")
def w3(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type", "user_id", "ts", "value")
    return trailing.like_for_like(e, ["event_type"], "user_id", ["ts", "event_id"], "value").select("event_id", F.round("baseline", 6).alias("baseline"), "basis")


@query("w4_widening_baseline", """
WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, o_orderstatus = 'F' AS own FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM o WHERE own),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM o),
x AS (SELECT o_custkey, avg(o_totalprice) AS v, count(*) AS n FROM a WHERE rn <= 10 GROUP BY 1),
y AS (SELECT o_custkey, avg(o_totalprice) AS v FROM b WHERE rn <= 10 GROUP BY 1)
SELECT y.o_custkey, round(CASE WHEN coalesce(x.n, 0) >= 3 THEN x.v ELSE y.v END, 4) AS baseline,
  CASE WHEN coalesce(x.n, 0) >= 3 THEN 'own' ELSE 'widened' END AS basis FROM y LEFT JOIN x USING (o_custkey)""")
def w4(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    own = F.col("o_orderstatus") == "F"
    return trailing.widening_baseline(o.where(own), o.where(~own), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").withColumns({"baseline": F.round("baseline", 4)})


@query("w5_recent_commits", """
WITH f AS (SELECT o_orderdate, min(o_orderkey) AS s FROM orders GROUP BY 1 ORDER BY s DESC LIMIT 80)
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IN (SELECT o_orderdate FROM f)""")
def w5(spark, d):
    return trailing.recent_commits(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("w6_newest_commit", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT arg_max(o_orderdate, o_orderkey) FROM orders)")
def w6(spark, d):
    return trailing.newest_commit(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("w7_regression_verdict", """
WITH w AS (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b FROM events),
g AS (SELECT event_id, CASE WHEN b > 1 THEN (value - b) / b WHEN value <= 1 THEN 0.0 END AS growth FROM w)
SELECT event_id, round(growth, 6) AS growth,
  CASE WHEN growth IS NULL THEN 'no baseline' WHEN growth >= 1 THEN 'hard' WHEN growth >= 0.2 THEN 'soft' ELSE 'ok' END AS verdict FROM g""")
def w7(spark, d):
    e = trailing.trailing_mean(t(spark, d, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value")
    e = e.withColumn("growth", trailing.growth(F.col("value"), F.col("baseline"), 1.0))
    return e.select("event_id", F.round("growth", 6).alias("growth"), trailing.verdict(F.col("growth")).alias("verdict"))


@query("w9_trailing_line", """
WITH x AS (SELECT event_id, user_id, ts, epoch_us(ts) / 3.6e9 - 473352 AS h, value FROM events),
w AS (SELECT event_id, regr_slope(value, h) OVER w AS s, count(*) OVER w AS n FROM x
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n >= 8 THEN s END, 3) AS slope FROM w""")
def w9(spark, d):
    x = t(spark, d, "events").select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352).alias("h"), "value")
    return trailing.trailing_line(x, ["user_id"], ["ts", "event_id"], "h", "value").select("event_id", F.round("slope", 3).alias("slope"))


@query("w10_running_minimum", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2047 PRECEDING AND CURRENT ROW) AS origin FROM events")
def w10(spark, d):
    return trailing.running_minimum(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "origin")


@query("w11_floor_rejection", """
WITH w AS (SELECT event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS floor FROM events)
SELECT event_id, floor, value > floor + greatest(floor / 2, 100) AS rejected FROM w""")
def w11(spark, d):
    return trailing.reject_above_floor(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", slack=100.0).select("event_id", "floor", "rejected")


@query("w15_gaps", """
WITH x AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_start FROM events)
SELECT event_id, next_start, next_start - ms AS gap, coalesce(next_start - ms >= 3600000, false) AS long_gap FROM x""")
def w15(spark, d):
    x = t(spark, d, "events").select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return trailing.gaps(x, ["user_id"], ["ts", "event_id"], "ms", "ms", least=3_600_000).select("event_id", "next_start", "gap", "long_gap")


RUNS = "SELECT o_custkey, min(o_totalprice) AS best, CASE WHEN min(o_totalprice) > 0 THEN (max(o_totalprice) - min(o_totalprice)) / min(o_totalprice) ELSE 0 END AS spread FROM orders WHERE year(o_orderdate) = {} GROUP BY 1"


@query("j1_full_outer_comparison", f"""
WITH b AS ({RUNS.format(1996)}), h AS ({RUNS.format(1997)}),
x AS (SELECT o_custkey, b.best AS base, b.spread AS base_spread, h.best AS head,
  CASE WHEN b.best IS NULL OR h.best IS NULL THEN NULL WHEN b.best = 0 THEN 0 ELSE (h.best - b.best) / b.best END AS delta FROM b FULL JOIN h USING (o_custkey))
SELECT o_custkey, round(base, 2) AS base, round(head, 2) AS head, round(delta, 6) AS delta,
  CASE WHEN base IS NULL THEN 'new' WHEN head IS NULL THEN 'gone' ELSE 'both' END AS side,
  CASE WHEN delta IS NULL THEN NULL WHEN delta >= 1 THEN 'hard' WHEN delta >= 0.2 THEN 'regression'
    WHEN abs(delta) <= greatest(0.03, coalesce(base_spread, 0)) THEN 'unchanged' WHEN delta < 0 THEN 'faster' ELSE 'slower' END AS tier FROM x""")
def j1(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    got = compare.compare_runs(o.where("y = 1996"), o.where("y = 1997"), ["o_custkey"], "o_totalprice")
    return got.select("o_custkey", F.round("base", 2).alias("base"), F.round("head", 2).alias("head"), F.round("delta", 6).alias("delta"), "side", "tier")


@query("j3_leak_table", """
WITH a AS (SELECT user_id, sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, CASE WHEN (a.v < 1000 AND b.v >= 1000) OR b.v - a.v >= 1000 THEN 'hard' WHEN (a.v < 200 AND b.v >= 200) OR b.v - a.v >= 200 THEN 'soft' ELSE 'ok' END AS tier,
  CASE WHEN a.v <= 100 THEN CASE WHEN b.v <= 100 THEN 'unchanged' ELSE 'hard' END WHEN (b.v - a.v) / a.v >= 1 THEN 'hard' WHEN (b.v - a.v) / a.v >= 0.2 THEN 'regression' WHEN (b.v - a.v) / a.v <= -0.2 THEN 'better' ELSE 'unchanged' END AS churn
FROM a JOIN b USING (user_id)""")
def j3(spark, d):
    e = t(spark, d, "events")
    side = lambda kind, out: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.sum("value").alias(out))
    both = side("click", "a").join(side("view", "b"), "user_id")
    return both.select("user_id", compare.leak_tier(F.col("a"), F.col("b"), soft=200, hard=1000).alias("tier"), compare.churn_tier(F.col("a"), F.col("b"), floor=100).alias("churn"))


@query("j4_required_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j4(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return compare.require_lookup(t(spark, d, "customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"]).select("c_custkey", "n_name")


@query("j5_unrecorded_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)")
def j5(spark, d):
    o = t(spark, d, "orders").where(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("c_custkey"))
    return compare.unrecorded(t(spark, d, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("j6_as_of", """
SELECT q.event_id, a.ts AS anchor_ts, a.value AS anchor_value FROM (SELECT * FROM events WHERE event_type = 'purchase') q
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) a ON q.user_id = a.user_id AND q.ts >= a.ts""")
def j6(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return timeline.as_of(e.where("event_type = 'purchase'").drop("value"), e.where("event_type = 'click'"), ["user_id"], "ts", ["value"]).select("event_id", "anchor_ts", "anchor_value")


@query("j6_strictly_before", """
SELECT q.event_id, a.ts AS anchor_ts FROM events q ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events) a ON q.user_id = a.user_id AND q.ts > a.ts""")
def j6_before(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    return timeline.as_of(e, e, ["user_id"], "ts", ["event_id"], exact=False).select("event_id", "anchor_ts")


@query("j7_interpolated", """
WITH k AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
s AS (SELECT user_id, ms, v, lead(ms) OVER w AS ms1, lead(v) OVER w AS v1, first_value(v) OVER w AS v0 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
f AS (SELECT user_id, any_value(v0) AS v0 FROM s GROUP BY 1),
q AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type = 'click')
SELECT q.event_id, round(CASE WHEN s.ms IS NULL THEN f.v0 WHEN s.ms1 IS NULL THEN s.v ELSE s.v + (s.v1 - s.v) * ((q.ms - s.ms)::DOUBLE / (s.ms1 - s.ms)) END, 6) AS v
FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ms >= s.ms LEFT JOIN f ON f.user_id = q.user_id""")
def j7(spark, d):
    e = t(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    frames = e.where("event_type = 'view'").groupBy("user_id", "ms").agg(F.max("value").alias("v"))
    return timeline.at_times(e.where("event_type = 'click'").select("event_id", "user_id", "ms"), frames, ["user_id"], "ms", "v").select("event_id", F.round("v", 6).alias("v"))


@query("j8_in_interval", """
WITH i AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) + 3600000 AS stop, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, event_id FROM events WHERE event_type = 'signup'),
n AS (SELECT user_id, ms, least(stop, coalesce(nxt, stop)) AS stop, event_id AS owner FROM i),
q AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type = 'error')
SELECT q.event_id, CASE WHEN q.ms < n.stop THEN n.owner END AS owner, CASE WHEN n.ms IS NULL THEN 'not yet' WHEN q.ms < n.stop THEN 'in' ELSE 'past' END AS state
FROM q ASOF LEFT JOIN n ON q.user_id = n.user_id AND q.ms >= n.ms""")
def j8(spark, d):
    from pyspark.sql import Window

    e = t(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    nxt = F.lead("ms").over(Window.partitionBy("user_id").orderBy("ts"))
    stops = e.where("event_type = 'signup'").select("user_id", "ms", F.least(F.col("ms") + 3_600_000, F.coalesce(nxt, F.col("ms") + 3_600_000)).alias("stop"), F.col("event_id").alias("owner"))
    points = e.where("event_type = 'error'").select("event_id", "user_id", "ms")
    return timeline.in_intervals(points, stops.withColumnRenamed("ms", "start"), ["user_id"], "ms", "start", "stop", ["owner"]).select("event_id", "owner", "state")


@query("j9_grid_snap", """
WITH g AS (SELECT ((epoch_us(ts) // 1000) + 300000) // 600000 AS grid_idx, event_type FROM events)
SELECT grid_idx, count(*) AS points FROM g GROUP BY 1 HAVING count(*) > 1""")
def j9(spark, d):
    g = t(spark, d, "events").select(timeline.grid_index(F.unix_millis(F.col("ts").cast("timestamp")), 600_000).alias("grid_idx"))
    return g.groupBy("grid_idx").agg(F.count(F.lit(1)).alias("points")).where("points > 1")


@query("j10_best_lag", """
WITH e AS (SELECT event_id AS i, event_type, value FROM events), s AS (SELECT unnest(range(-10, 11)) AS step),
x AS (SELECT step, count(*) FILTER (WHERE abs(a.value - b.value) <= 5) AS hits, count(*) AS counted FROM e a, s JOIN e b ON b.i = a.i + step WHERE step != 0 GROUP BY 1)
SELECT step, hits, counted FROM x ORDER BY hits DESC, abs(step), step LIMIT 1""")
def j10(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("i"), "value")
    return timeline.best_lag(e, e, "i", (F.abs(F.col("a.value") - F.col("b.value")) <= 5) & (F.col("step") != 0)).select(F.col("step").cast("long").alias("step"), "hits", "counted")


@query("j12_longest_prefix", """
WITH r(prefix, lane) AS (VALUES ('http://', 'plain'), ('https://', 'safe'), ('https://m.', 'mobile'), ('https://th', 'th'), ('http://th', 'plain th')),
x AS (SELECT url, lane, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS rn, page_id FROM pages LEFT JOIN r ON starts_with(url, prefix))
SELECT page_id, lane FROM x WHERE rn = 1""")
def j12(spark, d):
    rules = spark.createDataFrame([("http://", "plain"), ("https://", "safe"), ("https://m.", "mobile"), ("https://th", "th"), ("http://th", "plain th")], "prefix string, lane string")
    return compare.longest_prefix(t(spark, d, "pages").select("page_id", "url"), "url", rules, "prefix", "lane").select("page_id", "lane")


@query("j13_first_differences", """
WITH a AS (SELECT o_custkey % 50 AS block, o_orderstatus AS stream, o_orderkey AS i, o_totalprice AS v FROM orders),
b AS (SELECT block, stream, i, CASE WHEN block % 7 = 3 AND i % 3 = 0 THEN v + 1 ELSE v END AS v FROM a),
x AS (SELECT block, stream, i, a.v AS a, b.v AS b FROM a FULL JOIN b USING (block, stream, i) WHERE a.v IS DISTINCT FROM b.v),
y AS (SELECT *, row_number() OVER (PARTITION BY block, stream ORDER BY i) AS rn FROM x WHERE block = (SELECT min(block) FROM x))
SELECT block, stream, i, a, b FROM y WHERE rn <= 8""")
def j13(spark, d):
    a = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("block"), F.col("o_orderstatus").alias("stream"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    b = a.withColumn("v", F.when((F.col("block") % 7 == 3) & (F.col("i") % 3 == 0), F.col("v") + 1).otherwise(F.col("v")))
    return compare.first_differences(a, b, ["block"], ["stream", "i"], "v")


@query("j14_ceilings", """
WITH m AS (SELECT p_brand, max(p_retailprice) AS v FROM part WHERE p_size < 45 GROUP BY 1), c AS (SELECT p_brand, min(p_retailprice) + 900 AS ceiling FROM part WHERE p_size > 5 GROUP BY 1)
SELECT p_brand, round(v, 2) AS v, round(ceiling, 2) AS ceiling, CASE WHEN ceiling IS NULL THEN 'unpinned' WHEN v IS NULL THEN 'unmeasured' WHEN v > ceiling THEN 'over' ELSE 'ok' END AS state FROM m FULL JOIN c USING (p_brand)""")
def j14(spark, d):
    p = t(spark, d, "part")
    m = p.where("p_size < 45").groupBy("p_brand").agg(F.max("p_retailprice").alias("v"))
    c = p.where("p_size > 5").groupBy("p_brand").agg((F.min("p_retailprice") + 900).alias("ceiling"))
    return compare.against_ceilings(m, c, "p_brand", "v", "ceiling").select("p_brand", F.round("v", 2).alias("v"), F.round("ceiling", 2).alias("ceiling"), "state")


@query("j15_manifest_completeness", """
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment != 'MACHINERY'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0)
SELECT k, 'second' AS missing_in FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'first' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def j15(spark, d):
    a = t(spark, d, "customer").where("c_mktsegment != 'MACHINERY'").select(F.col("c_custkey").alias("k"))
    return compare.unmatched(a, t(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k")), "k")


@query("a39_longest_bad_run", """
WITH x AS (SELECT user_id, ts, event_id, value < 60 AS good FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, good ORDER BY ts, event_id) AS grp FROM x),
r AS (SELECT user_id, good, grp, count(*) AS n FROM g GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (WHERE good), 0)::BIGINT AS good, coalesce(max(n) FILTER (WHERE NOT good), 0) AS longest_bad FROM r GROUP BY 1""")
def a39(spark, d):
    return timeline.islands(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 60)


BUCKET = """
u AS (SELECT user_id, ts, event_id, (epoch_us(ts) // 1000) // 1000 AS slot, (value * 300)::BIGINT AS size, event_type = 'signup' AS restart FROM events),
c AS (SELECT *, sum(size) OVER w AS c FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, (c + max(slot - (c - size)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM c)"""


def bucket_units(spark, d):
    size = F.round(F.col("value") * 300).cast("long")
    u = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("slot"), size.alias("size"))
    return timeline.arrivals(u, ["user_id"], ["ts", "event_id"], "slot", "size", limit=100_000)


@query("t21_leaky_bucket", f'WITH {BUCKET} SELECT event_id, stop AS "end", 100000 - (stop - slot) AS headroom, 100000 - (stop - slot) < 0 AS late FROM e')
def t21(spark, d):
    return bucket_units(spark, d).select("event_id", "end", "headroom", "late")


@query("a37_rate_by_interval", f"""
WITH {BUCKET}, g AS (SELECT *, 100000 - (stop - slot) AS headroom, sum(restart::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM e)
SELECT user_id, i::BIGINT AS interval, count(*) AS units, sum(size)::BIGINT AS size, max(size) AS largest, min(headroom) AS least_headroom, count(*) FILTER (WHERE headroom < 0) AS late_units FROM g GROUP BY ALL""")
def a37(spark, d):
    return timeline.by_interval(bucket_units(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "size")


@query("u1_three_way_union", """
WITH base AS (SELECT l_partkey AS row, l_orderkey * 8 + l_linenumber AS s FROM lineitem WHERE l_orderkey % 5 < 2),
ours AS (SELECT l_partkey AS row, l_orderkey * 8 + l_linenumber AS s FROM lineitem WHERE l_orderkey % 5 = 1),
theirs AS (SELECT l_partkey AS row, l_orderkey * 8 + l_linenumber AS s FROM lineitem WHERE l_orderkey % 5 IN (0, 2)),
o AS (SELECT row, min(s) AS position FROM ours GROUP BY 1), th AS (SELECT row, min(s) AS position FROM theirs GROUP BY 1)
SELECT row, position, false AS added FROM o UNION ALL
SELECT row, position, true FROM th WHERE row NOT IN (SELECT row FROM o) AND row NOT IN (SELECT row FROM base WHERE row NOT IN (SELECT row FROM o))""")
def u1(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_partkey").alias("row"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("s"), (F.col("l_orderkey") % 5).alias("m"))
    return compare.three_way_union(x.where("m < 2"), x.where("m = 1"), x.where("m in (0, 2)"), "row", "s")


@query("u4_missing_with_allowances", """
SELECT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_partkey % 9 = 1 EXCEPT SELECT p_brand FROM part WHERE p_size = 7""")
def u4(spark, d):
    p = t(spark, d, "part")
    return compare.missing(p, p.where("p_partkey % 9 = 1"), p.where("p_size = 7"), "p_brand")


@query("u5_ordered_concat", """
SELECT c_custkey AS id, c_name AS name, 0 AS part, c_custkey AS position FROM customer UNION ALL SELECT s_suppkey, s_name, 1, s_suppkey FROM supplier""")
def u5(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return compare.concat_streams(c, t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), order="id")


@query("u6_transitive_users", """
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 40 AS src, (l_suppkey * 7 + 3) % 41 AS dst FROM lineitem),
c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
SELECT dst, src FROM c WHERE src != dst""")
def u6(spark, d):
    s = F.col("l_suppkey")
    return graph.transitive_users(t(spark, d, "lineitem").select((s % 40).alias("src"), ((s * 7 + 3) % 41).alias("dst")))
