"""Queries of the census, classification and array families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import census
from tidemark.plans.series import query, t


@query("a11_bin_census", """
WITH x AS (SELECT label, unnest(embedding) AS v FROM embeddings)
SELECT label, count(*) AS bins, count(*) FILTER (WHERE floor(v * 20) = 0) AS zero_bins, round(count(*) FILTER (WHERE floor(v * 20) = 0) / count(*), 6) AS zero_fraction FROM x GROUP BY 1""")
def a11(spark, d):
    e = t(spark, d, "embeddings").select("label", F.transform("embedding", lambda v: F.floor(v.cast("double") * 20)).alias("b"))
    return census.bin_census(e, ["label"], "b").withColumn("zero_fraction", F.round("zero_fraction", 6))


@query("a12_tool_census", """
SELECT o_orderpriority, count(*) AS blocks, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 200000) AS large, count(*) FILTER (WHERE o_custkey % 2 = 0 AND o_orderstatus = 'O') AS both FROM orders GROUP BY 1""")
def a12(spark, d):
    s = F.col("o_orderstatus")
    return census.tool_census(t(spark, d, "orders"), ["o_orderpriority"], {"finished": s == "F", "large": F.col("o_totalprice") > 200_000, "both": (F.col("o_custkey") % 2 == 0) & (s == "O")})


@query("a14_stream_report", """
WITH g AS (SELECT user_id, count(*) AS units, sum(event_id % 1000 + 1)::BIGINT AS bytes, sum(1536) AS s, min(event_id % 1000) != max(event_id % 1000) AS variable, arg_min(event_type, event_id) AS first_event_type FROM events GROUP BY 1)
SELECT user_id, units, bytes, 48000 AS rate, variable, first_event_type, round(s / 48000, 6) AS seconds, round(bytes * 8 / (s / 48000) / 1000, 5) AS kbps FROM g""")
def a14(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 1000 + 1).alias("size"), F.lit(1536).alias("samples"), F.lit(48_000).alias("rate"))
    got = census.stream_report(e, ["user_id"], size="size", samples="samples", rate="rate", seq="event_id", first=["event_type"])
    return got.withColumn("seconds", F.round("seconds", 6)).withColumn("kbps", F.round("kbps", 5))


@query("a22_band_noise", """
WITH x AS (SELECT l_suppkey, l_partkey % 50 AS band, l_extendedprice AS r, l_extendedprice * l_discount AS d FROM lineitem), g AS (SELECT l_suppkey, band, sum(r * r) AS s, sum(d * d) AS n FROM x GROUP BY 1, 2)
SELECT l_suppkey, band, round(CASE WHEN n <= 1e-20 THEN 200 WHEN s <= 1e-20 THEN -200 ELSE least(200, greatest(-200, 10 * log10(s / n))) END, 4) AS snr_db FROM g""")
def a22(spark, d):
    x = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("band"), F.col("l_extendedprice").alias("r"), (F.col("l_extendedprice") * F.col("l_discount")).alias("n"))
    return census.band_snr(x, ["l_suppkey"], "band", "r", "n").withColumn("snr_db", F.round("snr_db", 4))


@query("a32_exact_totals", "SELECT count(*) AS rows, sum(l_linenumber)::BIGINT AS ours, sum(l_orderkey % 9)::BIGINT AS theirs, round(sum(l_linenumber) / sum(l_orderkey % 9), 6) AS ratio FROM lineitem WHERE l_returnflag = 'N'")
def a32(spark, d):
    x = t(spark, d, "lineitem").withColumn("m", F.col("l_orderkey") % 9)
    return census.exact_totals(x, F.col("l_returnflag") == "N", "l_linenumber", "m").withColumn("ratio", F.round("ratio", 6))


@query("a34_coverage", """
SELECT DISTINCT p_brand, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 11 = 3) THEN 'seen' WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 9) THEN 'allowed gap' ELSE 'missing' END AS state FROM part""")
def a34(spark, d):
    p = t(spark, d, "part")
    return census.coverage(p.where("p_partkey % 11 = 3"), p, p.where("p_size = 9"), "p_brand")


@query("p7_classify", "SELECT page_id, CASE WHEN regexp_matches(url, '^https://m\\.') THEN 'mobile' WHEN regexp_matches(url, '\\?page=') THEN 'paged' WHEN regexp_matches(url, '/(en|fr)/') THEN 'main' ELSE 'other' END AS lane FROM pages")
def p7(spark, d):
    return census.classify(t(spark, d, "pages").select("page_id", "url"), "url", [("mobile", r"^https://m\."), ("paged", r"\?page="), ("main", "/(en|fr)/")]).select("page_id", "lane")


@query("p18_ranked_choice", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE rn = 1""")
def p18(spark, d):
    s = F.col("o_orderstatus")
    rank = [F.when(s == "F", 0).when(s == "O", 1).otherwise(2), F.desc("o_totalprice"), F.col("o_orderkey")]
    return census.ranked_choice(t(spark, d, "orders"), ["o_custkey"], rank).select("o_custkey", "o_orderkey")


@query("j11_band_overlap", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS n FROM embeddings),
w AS (SELECT vec_id, n, list_transform(range(n), lambda i: e[i + 1] * CASE WHEN n > 2 THEN 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) ELSE 1 END) AS x FROM e),
b AS (SELECT vec_id, n, x, unnest(range(n // 2 + 1)) AS k FROM w),
p AS (SELECT vec_id, k, 48000.0 / n AS width, list_sum(list_transform(range(n), lambda i: x[i + 1] * cos(2 * pi() * i * k / n))) ^ 2 + list_sum(list_transform(range(n), lambda i: x[i + 1] * sin(2 * pi() * i * k / n))) ^ 2 AS power FROM b),
t AS (SELECT unnest(range(-17, 14)) AS band), s AS (SELECT vec_id, band, power, (least((k + 0.5) * width, 1000 * 2 ^ ((band + 0.5) / 3)) - greatest((k - 0.5) * width, 1000 * 2 ^ ((band - 0.5) / 3))) / width AS share FROM p, t)
SELECT vec_id, band::INT AS band, round(10 * log10(sum(power * least(1, share))), 4) AS level_db FROM s WHERE share > 0 GROUP BY 1, 2""")
def j11(spark, d):
    """Third-octave levels of the embeddings read as 48 kHz samples: each bin is dealt to the bands it reaches into."""
    e = t(spark, d, "embeddings").select("vec_id", arrays.spectrum_power(F.col("embedding").cast("array<double>")).alias("p"), F.size("embedding").alias("n"))
    bins = e.select("vec_id", (F.lit(48_000.0) / F.col("n")).alias("width"), F.posexplode("p").alias("bin", "power"))
    parts = bins.select("vec_id", "power", F.inline(arrays.bin_bands(F.col("bin"), F.col("width"))))
    return parts.groupBy("vec_id", "band").agg(F.round(10 * F.log10(F.sum(F.col("power") * F.col("share"))), 4).alias("level_db"))


@query("fn_arrays", """
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda v: v * v)), 5) AS norm, len(e) AS n, round(e[3], 5) AS third FROM x""")
def fn_arrays(spark, d):
    e = F.col("embedding").cast("array<double>")
    return t(spark, d, "embeddings").select("vec_id", F.round(arrays.dot(e, e), 5).alias("norm"), F.size(e).cast("long").alias("n"), F.round(F.get(arrays.reorder(e, [2, 0, 1]), 0), 5).alias("third"))
