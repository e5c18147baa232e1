"""Array rules and censuses on small data."""

import json
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import census, stats


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def lit(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_native_rules(spark):
    got = one(spark, arrays.dot(lit(1, 2), lit(3, 4)), arrays.drop_leading(lit(9, 9, 1, 9), F.lit(9.0)), arrays.drop_leading(lit(9, 9), F.lit(9.0)), arrays.channel_label(F.lit(6), F.lit(5)), arrays.channel_label(F.lit(3), F.lit(1)), arrays.within_thresholds(lit(1, 2), lit(1, 3)), *arrays.align(lit(1, 2, 3), lit(0, 1, 2), F.lit(1)))
    assert tuple(got) == (11.0, [1.0, 9.0], [], "LFE", "ch1", [True, False], [1.0, 2.0], [1.0, 2.0])
    for bad in (arrays.dot(lit(1), lit(1, 2)), arrays.within_thresholds(lit(1), lit(1, 2))):
        with pytest.raises(Exception, match="differ"):
            one(spark, bad)


def test_transforms(spark):
    n = 480
    x = np.sin(2 * np.pi * 12 * np.arange(n) / n)
    got = one(spark, arrays.spectrum_power(lit(*x)), arrays.resample(1, 2)(lit(*x)), arrays.true_peak(lit(*np.sin(np.pi / 4 + np.pi / 2 * np.arange(64)))), arrays.biquad(0.5, 0.5, 0, 0, 0)(lit(1, 3, 5)), arrays.biquad(1, 0, 0, -0.5, 0)(lit(1, 0, 0)))
    assert int(np.argmax(got[0])) == 12 and len(got[1]) == n // 2
    assert np.abs(np.array(got[1])[40:-40] - x[::2][40:-40]).max() < 0.01
    assert 0.97 < got[2] < 1.1 and got[3] == [0.5, 2.0, 4.0] and got[4] == [1.0, 0.5, 0.25]
    shares = arrays.band_shares(4800, 48_000.0)
    total = {b: sum(s for x, _, s in shares if x == b) for b in (-3, 0, 6)}
    assert all(math.isclose(total[b], 100 * 2 ** (b / 3) * (2 ** (1 / 6) - 2 ** (-1 / 6)), rel_tol=1e-6) for b in total)


def test_crc16(spark):
    frame = spark.createDataFrame([(b"123456789",), (b"",), (None,), (b"\0\1",)], "b binary")
    assert [r.c for r in frame.select(arrays.crc16("b").alias("c")).collect()] == [0xFEE8, 0, None, 0x8005]


def test_findings(spark):
    rows = spark.createDataFrame([("r1", "error", "m", "src/a.c", 3), ("r1", "note", "n", "src/a.c", 1), ("r2", "note", "n", "gen/b.c", 1)], "rule string, level string, message string, path string, line int")
    got = census.findings_document(rows, tool="t", drop=["gen"]).collect()
    run = json.loads(got[0].value)["runs"][0]
    assert len(got) == 1 and [r["ruleId"] for r in run["results"]] == ["r1", "r1"] and run["tool"]["driver"]["rules"] == [{"id": "r1"}]


def test_levels(spark):
    b = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [1.0, -0.5]), ("s", [0.0])], "k string, x array<float>")
    got = {r.k: r for r in stats.channel_summary(b, ["k"], "x").collect()}
    assert got["a"].clipped == 1 and got["a"].peak_dbfs == 0.0 and math.isclose(got["a"].rms, math.sqrt(1.25 / 4)) and got["s"].rms_dbfs == -120.0
    p = spark.createDataFrame([("a", 1e-3)] * 3 + [("a", 1e-9), ("a", 1e-5), ("b", 0.0)], "k string, p double")
    got = {r.k: (r.integrated, r.blocks) for r in stats.gated_loudness(p, ["k"], "p").collect()}
    assert math.isclose(got["a"][0], -0.691 - 30) and got["a"][1] == 3 and got["b"] == (None, None)
    f = spark.createDataFrame([("s", 1.0, 1.0), ("z", 0.0, 1.0), ("n", 1.0, 0.0)], "k string, r double, a double")
    assert {r.k: r.snr_db for r in stats.snr(f, ["k"], "r", "a").collect()} == {"s": math.inf, "z": -math.inf, "n": 0.0}


def test_bins_meet_bands_by_expression(spark):
    for n in (7, 64, 480, 4800):
        got = spark.range(n // 2 + 1).select(F.col("id").alias("bin"), F.lit(48_000.0 / n).alias("w")).select("bin", F.inline(arrays.bin_bands(F.col("bin"), F.col("w")))).collect()
        want = {(b, k): s for b, k, s in arrays.band_shares(n, 48_000.0)}
        assert {(r.band, r.bin) for r in got} == set(want) and all(math.isclose(r.share, want[r.band, r.bin], rel_tol=1e-9, abs_tol=1e-12) for r in got)


def test_binomial_tails_of_all_sizes(spark):
    """Against exact integers, beyond the 1,074 trials where 2 ** -n is no double any more, and against the normal law."""
    cases = [(k, n) for n in (1, 2, 15, 16, 40, 1074, 1075, 3000) for k in sorted({0, 1, n // 2 - 3, n // 2, n // 2 + 1, n // 2 + 40, n - 1, n}) if 0 <= k <= n]
    frame = spark.createDataFrame(cases, "k long, n long").select("k", "n", stats.binomial_tail(F.col("k"), F.col("n")).alias("p"))
    for r in frame.collect():
        want = float(Fraction(sum(math.comb(r.n, j) for j in range(r.k, r.n + 1)), 2**r.n))
        assert math.isclose(r.p, want, rel_tol=1e-9, abs_tol=1e-300), tuple(r)
    big = spark.createDataFrame([(50_000, 100_000), (50_500, 100_000), (49_000, 100_000), (500_100_000, 1_000_000_000)], "k long, n long").select("k", "n", stats.binomial_tail(F.col("k"), F.col("n")).alias("p"))
    for r in big.collect():
        assert math.isclose(r.p, 0.5 * math.erfc((r.k - 0.5 - r.n / 2) / math.sqrt(r.n / 2)), rel_tol=2e-3), tuple(r)


def test_abx_without_answers(spark):
    got = stats.abx(spark.createDataFrame([("a", None, 1), ("b", 1, 1), ("b", 0, 1)], "leg string, answer int, x int"), ["leg"]).orderBy("leg").collect()
    assert (got[0].n, got[0].share, got[0].low) == (0, None, None) and math.isnan(got[0].chance) and (got[1].right, got[1].n, got[1].chance) == (1, 2, 0.75)
