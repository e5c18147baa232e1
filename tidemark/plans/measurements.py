"""Queries of baselines without the own commit, keyframes, frames, live scores, traces and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays, audio, text
from tidemark.operators import census, compare, includes, stats, timeline, trailing
from tidemark.plans.series import query, t
from tidemark.sources import histories, sinks
from tidemark.sources.shared import shared_path
from tidemark.streaming import folds, reports, windows


@query("p1_trailing_mean", """
WITH x AS (SELECT event_id, event_type, user_id, value, ts::DATE AS c, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS r FROM events),
j AS (SELECT a.event_id, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY b.r DESC) AS k FROM x a JOIN x b ON a.event_type = b.event_type AND a.user_id = b.user_id AND b.r < a.r AND b.c <> a.c),
g AS (SELECT event_id, avg(value) AS b, count(*) AS n FROM j WHERE k <= 10 GROUP BY 1)
SELECT event_id, round(b, 6) AS baseline, coalesce(n, 0) AS n FROM x LEFT JOIN g USING (event_id)""")
def p1(spark, d):
    """A series is an event type of a user, a commit a day: most series have days with several records."""
    e = t(spark, d, "events").select("event_id", "event_type", "user_id", "ts", F.col("ts").cast("date").alias("day"), "value")
    got = trailing.trailing_mean(e, ["event_type", "user_id"], ["ts", "event_id"], "value", count="n", commit="day")
    return got.select("event_id", F.round("baseline", 6).alias("baseline"), "n")


@query("p1_trailing_channels", """
WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate AS c, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 7 ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice) AS r, l_partkey % 7 AS p FROM lineitem),
j AS (SELECT a.l_suppkey, a.p, a.r, b.l_quantity AS q, b.l_extendedprice AS e, row_number() OVER (PARTITION BY a.l_suppkey, a.p, a.r ORDER BY b.r DESC) AS k FROM x a JOIN x b ON a.l_suppkey = b.l_suppkey AND a.p = b.p AND b.r < a.r AND b.c <> a.c),
g AS (SELECT l_suppkey, p, r, avg(q) AS q, avg(e) AS e FROM j WHERE k <= 10 GROUP BY 1, 2, 3)
SELECT l_suppkey, l_orderkey, l_linenumber, round(q, 6) AS baseline_quantity, round(e, 5) AS baseline_price FROM x LEFT JOIN g USING (l_suppkey, p, r)""")
def p1_channels(spark, d):
    x = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 7).alias("p"), "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", F.array("l_quantity", "l_extendedprice").alias("channels"))
    got = trailing.trailing_channels(x, ["l_suppkey", "p"], ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"], "channels", commit="l_shipdate")
    return got.select("l_suppkey", "l_orderkey", "l_linenumber", F.round(F.get("baseline", 0), 6).alias("baseline_quantity"), F.round(F.get("baseline", 1), 5).alias("baseline_price"))


@query("j2_two_keys", """
WITH x AS (SELECT l_returnflag AS leg, l_linestatus AS config, l_shipdate < TIMESTAMP '1995-01-01' AS base, l_extendedprice AS v FROM lineitem),
b AS (SELECT leg, config, min(v) AS base FROM x WHERE base GROUP BY 1, 2), h AS (SELECT leg, config, min(v) AS head FROM x WHERE NOT base GROUP BY 1, 2)
SELECT leg, config, base, head, CASE WHEN base IS NULL THEN 'new' WHEN head IS NULL THEN 'gone' ELSE 'both' END AS side FROM b FULL JOIN h USING (leg, config)""")
def j2(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("leg"), F.col("l_linestatus").alias("config"), "l_shipdate", F.col("l_extendedprice").alias("v"))
    old = F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    return compare.compare_runs(x.where(old), x.where(~old), ["leg", "config"], "v").select("leg", "config", "base", "head", "side")


@query("a5_tightest", """
WITH x AS (SELECT l_returnflag AS codec, l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_tax * 100 END AS headroom, l_quantity AS worst, CASE WHEN l_linenumber <> 7 THEN l_discount * 100 END AS threshold FROM lineitem),
y AS (SELECT *, coalesce(headroom, worst - threshold) AS room FROM x WHERE threshold IS NOT NULL)
SELECT codec, arg_min(l_orderkey, (room, l_orderkey, l_linenumber)) AS l_orderkey, round(min(room), 6) AS room FROM y GROUP BY 1""")
def a5(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("codec"), "l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, F.col("l_tax") * 100).alias("headroom"), F.col("l_quantity").alias("worst"), F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 100).alias("threshold"))
    return stats.tightest(x, ["codec"], headroom="headroom", worst="worst", threshold="threshold", seq=["l_orderkey", "l_linenumber"]).select("codec", "l_orderkey", F.round("room", 6).alias("room"))


@query("a10_distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS user_id, count(DISTINCT day) AS day FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY 1")
def a10(spark, d):
    return stats.distinct_counts(t(spark, d, "events").withColumn("day", F.col("ts").cast("date")), ["event_type"], ["user_id", "day"])


@query("a23_noise_to_mask", """
WITH x AS (SELECT l_suppkey, l_partkey % 25 AS band, l_linenumber * 3 - l_quantity / 2 AS db FROM lineitem), w AS (SELECT l_suppkey, max(db) AS m FROM x GROUP BY 1)
SELECT l_suppkey, round(10 * log10(avg(10 ^ (db / 10))), 5) AS mean_db, max(db) AS worst_db, min(band) FILTER (WHERE db = m) AS worst_band FROM x JOIN w USING (l_suppkey) GROUP BY 1""")
def a23(spark, d):
    x = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 25).alias("band"), (F.col("l_linenumber") * 3 - F.col("l_quantity") / 2).alias("db"))
    return census.noise_to_mask(x, ["l_suppkey"], "band", "db").withColumn("mean_db", F.round("mean_db", 5))


@query("w16_word_times", """
WITH w AS (SELECT item_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)),
l AS (SELECT *, greatest(1, length(regexp_replace(word, '[^\\p{L}\\p{N}]', '', 'g'))) AS n FROM w),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY item_id) AS share FROM l),
a AS (SELECT *, (floor((item_id * 5000 + share * 4000) / 10 + 0.5) * 10)::BIGINT AS word_start FROM s)
SELECT item_id, i, word_start, coalesce(lead(word_start) OVER (PARTITION BY item_id ORDER BY i), item_id * 5000 + 4000) AS word_end FROM a""")
def w16(spark, d):
    """The words of each item share the four seconds of its line."""
    w = t(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "word"), (F.col("item_id") * 5000).alias("start"), (F.col("item_id") * 5000 + 4000).alias("end"))
    return trailing.word_times(w, "item_id", "i", "word", "start", "end").select("item_id", (F.col("i") + 1).cast("long").alias("i"), "word_start", "word_end")


@query("o1_keyframes", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS place FROM events")
def o1(spark, d):
    return timeline.keyframes(t(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("p4_numbers", "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN (props ->> '$.k')::DOUBLE END AS k FROM events")
def p4(spark, d):
    return t(spark, d, "events").select("event_id", audio.json_number(F.col("props"), "k").alias("k"))


@query("t25_live_score", """
WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), f AS (SELECT event_id, user_id, event_id * 480 + 240 AS center FROM e),
b AS (SELECT user_id, event_id * 480 AS first, ms AS time FROM e WHERE event_type <> 'error'),
a AS (SELECT user_id, ms AS time, event_id * 1000 AS position, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE 1.0 END AS speed FROM e WHERE event_type IN ('signup', 'purchase')),
p AS (SELECT f.*, floor(b.time + (f.center - b.first) * 1000 / 48000.0 - 20)::BIGINT AS time FROM f ASOF LEFT JOIN b ON f.user_id = b.user_id AND f.center >= b.first)
SELECT p.event_id, p.center, p.time, CASE WHEN a.speed <> 0 THEN floor((a.position + (p.time - a.time) * a.speed + 5) / 10)::BIGINT END AS place FROM p ASOF LEFT JOIN a ON p.user_id = a.user_id AND p.time >= a.time""")
def t25(spark, d):
    """Frames, captured blocks and playhead anchors of each user: block as-of, anchor as-of, grid."""
    e = t(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    frames = e.select("user_id", "event_id", (F.col("event_id") * 480 + 240).alias("center"))
    blocks = e.where("event_type != 'error'").select("user_id", (F.col("event_id") * 480).alias("first"), F.col("ms").alias("time"), F.lit(48_000).alias("rate"))
    anchors = e.where("event_type in ('signup', 'purchase')").select("user_id", F.col("ms").alias("time"), (F.col("event_id") * 1000).alias("position"), F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(1.0).alias("speed"))
    return timeline.heard_positions(frames, blocks, anchors, ["user_id"], delay=20).select("event_id", "center", "time", "place")


@query("k1_tidy_trace", """
WITH x AS (SELECT vec_id AS frame, 0 AS substream, 0 AS block, label AS stream, embedding AS e FROM embeddings WHERE vec_id % 5 <> 0)
SELECT frame, substream, block, stream, 'bin' AS kind, (i - 1)::INT AS index, round(e[i]::DOUBLE, 6) AS value FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM x)""")
def k1(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(0).alias("substream"), F.lit(0).alias("block"), F.col("label").alias("stream"), F.transform("embedding", lambda v: F.round(v.cast("double"), 6)).alias("e"), (F.col("vec_id") % 5 != 0).alias("allocated"))
    return sinks.tidy_trace(e, {"bin": "e"})


@query("k5_badges", """SELECT event_type, '{"schemaVersion":1,"label":"' || event_type || '","message":"' || count(*) || ' runs","color":"' || CASE WHEN count(*) > 300 THEN 'green' ELSE 'red' END || '"}' AS badge FROM events GROUP BY 1""")
def k5(spark, d):
    g = t(spark, d, "events").groupBy("event_type").count()
    return g.select("event_type", sinks.badge(F.col("event_type"), F.concat(F.col("count").cast("string"), F.lit(" runs")), F.when(F.col("count") > 300, "green").otherwise("red")).alias("badge"))


@query("fn_reports", """
SELECT o_orderkey, printf('%,.1f', o_totalprice) AS price, o_orderkey * 40 / 48000.0 AS starts, translate(rtrim(base64(o_orderpriority::BLOB), '='), '+/', '-_') AS code,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'org/' || o_orderstatus ELSE '' END AS branch FROM orders""")
def fn_reports(spark, d):
    k = F.col("o_orderkey")
    subject = F.when(k % 3 == 0, F.concat(F.lit("Merge pull request #"), k.cast("string"), F.lit(" from org/"), F.col("o_orderstatus"))).otherwise(F.concat(F.lit("Fix #"), k.cast("string")))
    number, branch = audio.merge_subject(subject)
    return t(spark, d, "orders").select("o_orderkey", audio.thousands(F.col("o_totalprice")).alias("price"), audio.sample_time(k, 40, 48_000).alias("starts"), audio.base64url(F.col("o_orderpriority").cast("binary")).alias("code"), number.alias("number"), branch.alias("branch"))


@query("fn_rotate", """
WITH p AS (SELECT p_partkey, p_size / 50.0 AS x, (p_partkey % 100) / 100.0 AS y, (p_partkey % 21 - 10) / 10.0 AS z FROM part), c AS (SELECT p_partkey, 2 * x - 1 AS u, 2 * y - 1 AS v, z AS w FROM p),
a AS (SELECT p_partkey, u * cos(radians(30)) - v * sin(radians(30)) AS u, u * sin(radians(30)) + v * cos(radians(30)) AS v, w FROM c),
b AS (SELECT p_partkey, u, v * cos(radians(-20)) + w * sin(radians(-20)) AS v, w * cos(radians(-20)) - v * sin(radians(-20)) AS w FROM a),
r AS (SELECT p_partkey, u * cos(radians(10)) - w * sin(radians(10)) AS u, v, u * sin(radians(10)) + w * cos(radians(10)) AS w FROM b)
SELECT p_partkey, round(least(1, greatest(0, (u + 1) / 2)), 6) AS x, round(least(1, greatest(0, (v + 1) / 2)), 6) AS y, round(least(1, greatest(-1, w)), 6) AS z FROM r""")
def fn_rotate(spark, d):
    k = F.col("p_partkey")
    turned = audio.rotate((F.col("p_size") / 50.0, k % 100 / 100.0, (k % 21 - 10) / 10.0), 30.0, -20.0, 10.0)
    return t(spark, d, "part").select("p_partkey", *(F.round(c, 6).alias(n) for c, n in zip(turned, "xyz", strict=True)))


@query("w13_pitch", """
WITH e AS (SELECT vec_id, frame, list_transform(embedding[8 * frame + 1:8 * frame + 48], lambda v: v::DOUBLE) AS v FROM embeddings, range(3) f(frame)),
c AS (SELECT vec_id, frame, list_transform(v, lambda y: y - list_avg(v)) AS x FROM e),
l AS (SELECT *, greatest(-120, 20 * log10(sqrt(list_avg(list_transform(x, lambda y: y * y))) + 1e-9)) AS level FROM c),
lags AS (SELECT vec_id, frame, t, list_sum(list_transform(range(1, 28), lambda j: x[j] * x[j + t])) AS r, list_sum(list_transform(range(1, 28), lambda j: x[j] ^ 2 + x[j + t] ^ 2)) AS m FROM l, range(1, 22) g(t)),
n AS (SELECT vec_id, frame, t, CASE WHEN m > 1e-12 THEN 2 * r / m ELSE 0 END AS d FROM lags),
s AS (SELECT *, sum((d > 0 AND before <= 0)::INT) OVER (PARTITION BY vec_id, frame ORDER BY t) AS lobe FROM (SELECT *, lag(d, 1, 1.0) OVER (PARTITION BY vec_id, frame ORDER BY t) AS before FROM n)),
tops AS (SELECT vec_id, frame, lobe, arg_max(t, (d, -t)) AS t, max(d) AS d FROM s WHERE d > 0 AND lobe > 0 GROUP BY ALL),
ok AS (SELECT *, max(d) OVER (PARTITION BY vec_id, frame) AS top FROM tops WHERE t BETWEEN 4 AND 20),
pick AS (SELECT vec_id, frame, any_value(top) AS top, min(t) FILTER (WHERE d >= 0.9 * top) AS t FROM ok GROUP BY ALL),
near AS (SELECT p.*, x.d AS a, y.d AS b, z.d AS c FROM pick p JOIN n x ON x.vec_id = p.vec_id AND x.frame = p.frame AND x.t = p.t - 1 JOIN n y ON y.vec_id = p.vec_id AND y.frame = p.frame AND y.t = p.t JOIN n z ON z.vec_id = p.vec_id AND z.frame = p.frame AND z.t = p.t + 1),
shift AS (SELECT *, CASE WHEN a - 2 * b + c <> 0 THEN least(0.5, greatest(-0.5, 0.5 * (a - c) / (a - 2 * b + c))) ELSE 0 END AS s FROM near),
peak AS (SELECT *, b - 0.25 * (a - c) * s AS p, 8000 / (t + s) AS f FROM shift)
SELECT l.vec_id, l.frame, round(CASE WHEN level >= -55 AND top >= 0.6 AND p >= 0.6 AND f BETWEEN 400 AND 2000 THEN f ELSE 0 END, 5) AS hz,
  round(CASE WHEN level < -55 OR top IS NULL THEN 0 WHEN top < 0.6 THEN greatest(0, least(1, top)) WHEN p < 0.6 OR f NOT BETWEEN 400 AND 2000 THEN 0 ELSE least(1, p) END, 6) AS clarity, round(level, 6) AS level_db
FROM l LEFT JOIN peak USING (vec_id, frame)""")
def w13(spark, d):
    """Pitch of overlapping frames of the embeddings, read as 8 kHz samples."""
    e = t(spark, d, "embeddings").select("vec_id", F.inline(arrays.frames_of(F.col("embedding").cast("array<double>"), 48, 8)))
    got = e.withColumn("p", arrays.pitch(8000.0, lowest=400.0, highest=2000.0)(F.col("samples")))
    return got.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round("p.hz", 5).alias("hz"), F.round("p.clarity", 6).alias("clarity"), F.round("p.level_db", 6).alias("level_db"))


@query("j16_includes", """
WITH u AS (SELECT page_id, x[2] AS lib, x[3] AS l, x[4]::BIGINT AS n FROM (SELECT page_id, [regexp_extract(url, '://([^/]*)/([^/]*)/([0-9]+)', 0), regexp_extract(url, '://([^/]*)/([^/]*)/([0-9]+)', 1), regexp_extract(url, '://([^/]*)/([^/]*)/([0-9]+)', 2), regexp_extract(url, '://([^/]*)/([^/]*)/([0-9]+)', 3)] AS x FROM pages WHERE url IS NOT NULL) WHERE x[1] <> ''),
f AS (SELECT *, lib LIKE '%.org' AS public, lib || CASE WHEN lib LIKE '%.org' THEN '/include/' ELSE '/' END || l || '/' || n AS path FROM u),
i AS (SELECT page_id, path, lib, CASE page_id % 4 WHEN 0 THEN l || '/' || (n + 1) WHEN 1 THEN '../en/' || (n + 2) WHEN 2 THEN (n // 8)::VARCHAR ELSE './' || n END AS spelling,
  CASE page_id % 4 WHEN 0 THEN lib || CASE WHEN public THEN '/include/' ELSE '/' END || l || '/' || l || '/' || (n + 1) WHEN 1 THEN lib || CASE WHEN public THEN '/include/' ELSE '/' END || 'en/' || (n + 2)
    WHEN 2 THEN lib || CASE WHEN public THEN '/include/' ELSE '/' END || l || '/' || (n // 8) ELSE path END AS beside FROM f),
names AS (SELECT DISTINCT s, path, lib, public FROM (SELECT path, lib, public, unnest(CASE WHEN public THEN [l || '/' || n] ELSE [n::VARCHAR, l || '/' || n, lib || '/' || l || '/' || n] END) AS s FROM f)),
own AS (SELECT s, lib, min(path) AS path FROM names GROUP BY ALL),
best AS (SELECT s, first(path ORDER BY NOT public, path) AS path, first(lib ORDER BY NOT public, path) AS lib, array_to_string(list_sort(list_distinct(list(lib))), ' ') AS libs, count(DISTINCT lib) AS k FROM names GROUP BY s),
there AS (SELECT DISTINCT path, lib FROM f),
r AS (SELECT i.page_id, i.spelling, there.path IS NOT NULL AS near, own.path IS NOT NULL AS mine, coalesce(there.path, own.path, best.path) AS target, CASE WHEN there.path IS NOT NULL THEN there.lib WHEN own.path IS NOT NULL THEN i.lib ELSE best.lib END AS target_lib, libs, k
  FROM i LEFT JOIN there ON there.path = i.beside LEFT JOIN own ON own.s = i.spelling AND own.lib = i.lib LEFT JOIN best ON best.s = i.spelling)
SELECT page_id, spelling, target, target_lib, contains(target, '/include/') AS is_public, CASE WHEN NOT near AND NOT mine AND k > 1 THEN libs END AS libs FROM r""")
def j16(spark, d):
    """The pages' addresses as files, by host: those of .org are public. Each names another by one of four ways."""
    address = F.regexp_extract("url", r"://([^/]*)/([^/]*)/([0-9]+)", 0)
    part = lambda k: F.regexp_extract("url", r"://([^/]*)/([^/]*)/([0-9]+)", k)
    u = t(spark, d, "pages").where(address != "").select("page_id", part(1).alias("lib"), part(2).alias("l"), part(3).cast("long").alias("n"))
    f = u.withColumn("path", F.concat("lib", F.when(F.col("lib").endswith(".org"), "/include/").otherwise("/"), "l", F.lit("/"), "n"))
    ways = F.col("page_id") % 4
    spelling = F.when(ways == 0, F.concat("l", F.lit("/"), F.col("n") + 1)).when(ways == 1, F.concat(F.lit("../en/"), F.col("n") + 2)).when(ways == 2, F.expr("string(n div 8)")).otherwise(F.concat(F.lit("./"), "n"))
    got = includes.resolve(f.select("page_id", "path", "lib", spelling.alias("spelling")), f.select("path", "lib"))
    return got.select("page_id", "spelling", "target", "target_lib", "is_public", F.array_join("libs", " ").alias("libs"))


def _events(spark, d):
    return t(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("at_ms"))


@query("t6_follower", """
WITH x AS (SELECT user_id AS key, event_id, event_type, value, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
g AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY key ORDER BY r) AS plays FROM x),
i AS (SELECT *, CASE WHEN plays > 0 THEN first_value(event_id % 2) OVER (PARTITION BY key, plays ORDER BY r) END AS item FROM g),
a AS (SELECT *, last_value(CASE WHEN event_type NOT IN ('signup', 'error') AND event_id % 2 = item THEN {'at': ms, 'value': value} END IGNORE NULLS) OVER (PARTITION BY key, plays ORDER BY r ROWS UNBOUNDED PRECEDING) AS anchor FROM i)
SELECT key, ms * 1000 AS at_us, item, CASE WHEN anchor IS NOT NULL THEN greatest(0.0, anchor.value + (ms - anchor.at)) END AS position_ms FROM a WHERE event_type = 'error'""")
def t6(spark, d):
    kind = F.when(F.col("event_type") == "signup", "document").when(F.col("event_type") == "error", "query").otherwise("anchor")
    e = _events(spark, d).select("key", "event_id", (F.col("at_ms") * 1000).cast("long").alias("at_us"), kind.alias("kind"), (F.col("event_id") % 2).alias("item"), F.col("value").alias("position_ms"), F.lit(1.0).alias("speed"))
    return folds.over_table(e, "key", ["at_us", "event_id"], folds.follower(), "key long, at_us long, item long, position_ms double")


@query("t16_power_average", """
WITH RECURSIVE x AS (SELECT user_id AS key, event_id, event_type, value, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
p AS (SELECT key, r, ms::DOUBLE AS at_ms, CASE WHEN value >= 1200 THEN 0.0 ELSE 10 ^ (-value / 100) END AS p FROM x),
m(key, r, at_ms, power) AS (SELECT key, r, at_ms, p FROM p WHERE r = 1 UNION ALL SELECT p.key, p.r, p.at_ms, power + (p - power) * (1 - exp(-(p.at_ms - m.at_ms) / 7200000)) FROM m JOIN p ON p.key = m.key AND p.r = m.r + 1)
SELECT key, at_ms, round(CASE WHEN power > 0 THEN 10 * log10(power) ELSE -120 END, 6) AS db FROM m""")
def t16(spark, d):
    e = _events(spark, d).select("key", "event_id", "at_ms", (-F.col("value") / 10).alias("db"))
    return folds.over_table(e, "key", ["at_ms", "event_id"], folds.power_average(tau_s=7200.0), "key long, at_ms double, db double").withColumn("db", F.round("db", 6))


@query("t16_ballistic", """
WITH RECURSIVE x AS (SELECT user_id AS key, event_id, event_type, value, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
p AS (SELECT key, r, ms::DOUBLE AS at_ms, -value / 10 AS db FROM x),
m(key, r, at_ms, level, peak, rest) AS (SELECT key, r, at_ms, greatest(db, -120), greatest(db, -120), 7200.0::DOUBLE FROM p WHERE r = 1
  UNION ALL SELECT key, r, at_ms, now, CASE WHEN now >= peak THEN now WHEN rest > 0 THEN peak ELSE greatest(now, peak - 0.001 * dt) END, CASE WHEN now >= peak THEN 7200.0 WHEN rest > 0 THEN rest - dt ELSE rest END
  FROM (SELECT p.key, p.r, p.at_ms, (p.at_ms - m.at_ms) / 1000 AS dt, greatest(p.db, level - 0.002 * (p.at_ms - m.at_ms) / 1000) AS now, peak, rest FROM m JOIN p ON p.key = m.key AND p.r = m.r + 1))
SELECT key, at_ms, round(level, 6) AS level, round(peak, 6) AS peak FROM m""")
def t16_bar(spark, d):
    e = _events(spark, d).select("key", "event_id", "at_ms", (-F.col("value") / 10).alias("db"))
    return folds.over_table(e, "key", ["at_ms", "event_id"], folds.ballistic(fall_db=0.002, hold_s=7200.0, peak_fall_db=0.001), "key long, at_ms double, level double, peak double").withColumns({c: F.round(c, 6) for c in ("level", "peak")})


@query("t29_snapshots", """
WITH e AS (SELECT user_id AS key, event_id, event_id * 10 AS frame, value AS level, max(floor((event_id * 10 - floor(value * 10)) / 1000)) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT e.key, e.frame, CASE WHEN e.k >= 1 THEN (e.k * 1000)::BIGINT END AS snapshot, CASE WHEN e.k >= 1 THEN s.level END AS level FROM e ASOF LEFT JOIN e s ON e.key = s.key AND e.k * 1000 <= s.frame""")
def t29(spark, d):
    e = _events(spark, d).select("key", "event_id", (F.col("event_id") * 10).alias("frame"), F.col("value").alias("level"), (F.col("event_id") * 10 - F.floor(F.col("value") * 10)).cast("long").alias("heard"))
    return folds.over_table(e, "key", ["event_id"], folds.snapshots(every=1000), "key long, frame long, snapshot long, level double")


@query("s5_history", "SELECT event_id, event_type, value FROM events WHERE event_id % 7 <> 3")
def s5(spark, d):
    """The events as a history of JSON lines, every seventh line broken: what a tolerant read gives back."""
    path = shared_path(spark, "history")
    line = F.when(F.col("event_id") % 7 == 3, F.lit('{"event_id": 1, "event_type')).otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    t(spark, d, "events").select(line.alias("value")).write.text(path)
    return histories.read_history(spark, path, "event_id long, event_type string, value double").select("event_id", "event_type", "value")


@query("s9_responses", "SELECT user_id % 3 AS leg, count(*) AS n, round(avg(value), 6) AS score FROM events GROUP BY 1")
def s9(spark, d):
    """The events as sheets of answers; rows without any value are no answers."""
    path = shared_path(spark, "responses")
    e = t(spark, d, "events").select((F.col("user_id") % 3).alias("leg"), F.col("value").alias("score"))
    blank = e.select(F.lit(None).cast("long").alias("leg"), F.lit(None).cast("double").alias("score"))
    e.unionByName(blank).write.option("header", True).csv(path)
    got = histories.read_responses(spark, path)
    return got.groupBy(F.col("leg").cast("long").alias("leg")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("score").cast("double")), 6).alias("score"))


@query("k3_keyed_append", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS source FROM orders")
def k3(spark, d):
    """A third of the orders are in the history; appending all of them adds the others only."""
    path, kind = shared_path(spark, "append"), "o_orderkey long, source string"
    o = t(spark, d, "orders").select("o_orderkey")
    o.where("o_orderkey % 3 = 0").withColumn("source", F.lit("old")).write.json(path)
    sinks.append_new(o.withColumn("source", F.lit("new")), spark.read.schema(kind).json(path), ["o_orderkey"], path)
    return spark.read.schema(kind).json(path)


@query("k4_recent_window", """
WITH f AS (SELECT o_orderdate, min(o_orderkey) AS s FROM orders GROUP BY 1 ORDER BY s DESC LIMIT 80)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate IN (SELECT o_orderdate FROM f)""")
def k4(spark, d):
    path = shared_path(spark, "recent")
    o = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    if not sinks.write_recent(o, "day", "o_orderkey", path):
        return o.limit(0)
    return spark.read.schema("o_orderkey long, day string").json(path)


@query("a20_true_peak", """
WITH e AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) r(i)),
w AS (SELECT n, i, CASE WHEN n / 4 = i THEN 1.0 ELSE sin(pi() * (n / 4 - i)) / (pi() * (n / 4 - i)) END * (0.5 + 0.5 * cos(pi() * (n / 4 - i) / 25)) AS w FROM range(256) a(n), range(64) b(i) WHERE abs(n / 4 - i) <= 24)
SELECT vec_id, round(max(abs(y)), 6) AS true_peak FROM (SELECT vec_id, n, sum(x * w) AS y FROM e JOIN w USING (i) GROUP BY ALL) GROUP BY vec_id""")
def a20(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(arrays.true_peak(F.col("embedding").cast("array<double>")), 6).alias("true_peak"))


@query("w12_sliding_power", """
WITH h AS (SELECT user_id, value, epoch_us(ts) // 3600000000 AS h FROM events), w AS (SELECT user_id, value, unnest([h - 3, h - 2, h - 1, h]) AS s FROM h)
SELECT user_id, s AS start_hour, round(avg(value), 6) AS power, count(*) AS samples FROM w GROUP BY 1, 2""")
def w12(spark, d):
    """Windows of four hours that begin every hour."""
    e = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    got = windows.sliding_power(e, ["user_id"], "ts", "value", length="4 hours", hop="1 hour")
    return got.select("user_id", F.floor(F.unix_seconds(F.col("start")) / 3600).cast("long").alias("start_hour"), F.round("power", 6).alias("power"), "samples")


@query("t2_loudness", """
WITH h AS (SELECT user_id, value / 100000 AS p, epoch_us(ts) // 3600000000 AS h FROM events), u AS (SELECT user_id, p, unnest([h - 3, h - 2, h - 1, h]) AS s FROM h),
b AS (SELECT user_id, s, avg(p) AS p FROM u GROUP BY 1, 2), l AS (SELECT * FROM b WHERE p > 0 AND -0.691 + 10 * log10(p) > -70), m AS (SELECT user_id, avg(p) AS m FROM l GROUP BY 1),
k AS (SELECT user_id, p FROM l JOIN m USING (user_id) WHERE log10(p) > log10(m) - 1)
SELECT user_id, round(-0.691 + 10 * log10(avg(p)), 5) AS integrated, count(*) AS blocks FROM k GROUP BY 1""")
def t2(spark, d):
    """Sliding blocks first, then the two gates over the blocks of each user."""
    e = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 100_000).alias("p"))
    blocks = windows.sliding_power(e, ["user_id"], "ts", "p", length="4 hours", hop="1 hour")
    return stats.gated_loudness(blocks, ["user_id"], "power").where("blocks is not null").select("user_id", F.round("integrated", 5).alias("integrated"), "blocks")


@query("a36_footprint", """
SELECT l_shipdate::DATE AS section, l_returnflag AS origin, sum(l_partkey)::BIGINT AS bytes, round(sum(l_partkey) / sum(sum(l_partkey)) OVER (PARTITION BY l_shipdate::DATE), 6) AS share FROM lineitem GROUP BY 1, 2""")
def a36(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("section"), F.col("l_returnflag").alias("origin"), "l_partkey")
    return census.footprint(x, "section", "origin", "l_partkey").withColumn("share", F.round("share", 6))


@query("a38_edit_summary", """
SELECT o_custkey, count(*) AS units, count(*) FILTER (WHERE o_shippriority <> o_custkey % 3) AS changed, count(*) FILTER (WHERE o_orderstatus = 'F') AS stripped, sum(CASE WHEN o_orderstatus = 'F' THEN length(o_orderpriority) ELSE 0 END)::BIGINT AS bytes
FROM (SELECT *, o_orderkey % 3 AS o_shippriority FROM orders) GROUP BY 1""")
def a38(spark, d):
    gone = F.col("o_orderstatus") == "F"
    o = t(spark, d, "orders").withColumns({"old": F.col("o_orderkey") % 3, "new": F.col("o_custkey") % 3, "size": F.char_length("o_orderpriority")})
    return census.edit_summary(o, ["o_custkey"], old="old", new="new", stripped=gone, size="size")


@query("k11_census_json", """SELECT event_type, '{"stream":"' || event_type || '","frames":' || count(*) || ',"bins":' || count(DISTINCT user_id) || '}' AS value FROM events GROUP BY 1""")
def k11(spark, d):
    got = t(spark, d, "events").groupBy(F.col("event_type").alias("stream")).agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("user_id").alias("bins"))
    return got.select(F.col("stream").alias("event_type"), sinks.json_object("stream", "frames", "bins").alias("value"))


@query("p16_enum", """
SELECT o_orderkey, CASE trim(o_orderpriority) WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 5 END AS level, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey * 1000000 < 4294967295 THEN o_orderkey * 1000000 END AS ahead FROM orders""")
def p16(spark, d):
    padded = F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))
    us = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") * 1_000_000).otherwise(0)
    return t(spark, d, "orders").select("o_orderkey", audio.parse_enum(padded, {"1-URGENT": 1, "2-HIGH": 2, "5-LOW": 5}).alias("level"), audio.send_ahead(us).alias("ahead"))


@query("o7_seeded_cases")
def o7(spark, d):
    """A case for each order: rate, channels and length by the master seed and the case's number alone."""
    return t(spark, d, "orders").select("o_orderkey", *(audio.draw(7, F.col("o_orderkey"), name, among).alias(name) for name, among in (("rate", [44_100, 48_000, 96_000]), ("channels", [1, 2, 6, 8]), ("blocks", list(range(1, 7))))))


@query("t19_merged_report", """
WITH x AS (SELECT event_type AS stream, event_id AS seq, event_id % 3 * 50 + 100 AS size, CASE WHEN event_id % 5 <> 0 THEN 8000 * (event_id % 4 + 1) END AS rate, CASE WHEN event_id % 7 = 0 THEN user_id END AS layout FROM events),
g AS (SELECT stream, count(*) AS units, sum(size)::BIGINT AS bytes, arg_min(rate, CASE WHEN rate IS NOT NULL THEN seq END)::BIGINT AS rate, min(size) <> max(size) AS variable, arg_min(layout, CASE WHEN layout IS NOT NULL THEN seq END) AS first_layout, count(*) * 1536 AS samples FROM x GROUP BY stream)
SELECT stream, units, bytes, rate, variable, first_layout, round(CASE WHEN rate > 0 THEN samples / rate ELSE 0 END, 6) AS seconds, round(bytes * 8 / (samples / rate) / 1000, 6) AS kbps FROM g""")
def t19(spark, d):
    """Parts of the streams by day, merged to one report of each stream."""
    k = F.col("event_id")
    x = t(spark, d, "events").select(F.col("event_type").alias("stream"), k.alias("seq"), F.to_date("ts").alias("day"), (k % 3 * 50 + 100).alias("size"), F.lit(1536).alias("samples"), F.when(k % 5 != 0, 8000 * (k % 4 + 1)).alias("rate"), F.when(k % 7 == 0, F.col("user_id")).alias("layout"))
    parts = reports.part_of(x, ["stream", "day"], size="size", samples="samples", rate="rate", seq="seq", first=["layout"])
    return reports.report(parts.drop("day"), ["stream"]).withColumns({c: F.round(c, 6) for c in ("seconds", "kbps")})


@query("fn_text_direction", r"""
SELECT doc_id, regexp_matches(regexp_extract(text, '[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}\x{2C00}-\x{2FFF}\x{3040}-\x{FDFF}\x{FE10}-\x{FFFC}\x{FFFE}-\x{10FFFF}]'), '[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}]') AS right_to_left,
  NOT regexp_matches(text, '[^\x{00}-\x{7F}\x{A0}-\x{FF}]') AS covered FROM documents""")
def fn_text_direction(spark, d):
    """Direction of every text, and whether a font of Latin-1's printed characters covers it."""
    return t(spark, d, "documents").select("doc_id", text.is_right_to_left(F.col("text")).alias("right_to_left"), text.is_covered(F.col("text"), [(0x20, 0x7E), (0xA0, 0xFF)]).alias("covered"))
