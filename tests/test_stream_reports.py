"""Resampling in blocks, reports that grow, and directions of texts."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import census
from tidemark.streaming import folds, reports


def run_blocks(fold, x, sizes):
    state, out, at, k = fold[0](), [], 0, 0
    while at < len(x):
        n = sizes[k % len(sizes)]
        first, samples = fold[1](state, SimpleNamespace(samples=x[at : at + n]))
        assert first == len(out)
        out += samples
        at, k = at + n, k + 1
    return np.array(out)


@pytest.mark.parametrize("up,down", [(1, 2), (2, 1), (147, 160), (3, 2), (1, 1)])
def test_blocks_of_any_cut(up, down):
    fold = folds.resampler(up, down)
    x = np.random.default_rng(0).normal(size=700)
    whole = run_blocks(fold, x, [700])
    assert len(whole) == 700 * up // down
    for sizes in ([1], [7, 64, 3], [199]):
        assert np.allclose(run_blocks(fold, x, sizes), whole, atol=1e-12)


@pytest.mark.parametrize("up,down", [(1, 2), (2, 1), (147, 160)])
def test_tones_pass_or_stop(up, down):
    fold, n = folds.resampler(up, down), 3000
    low = min(1.0, up / down)
    for share, level in ((0.1, 1.0), (0.8, 1.0), (1.1, 0.0) if low < 1 else (0.5, 1.0)):
        x = np.sin(math.pi * share * low * np.arange(n))
        y = run_blocks(fold, x, [256])[len(x) * up // down // 2 :]
        assert abs(math.sqrt(2) * y.std() - level) < 2e-3, share


def test_resampled_table_and_stream_state(spark):
    x = np.random.default_rng(1).normal(size=200)
    rows = [("a", k, [float(v) for v in x[k * 40 : (k + 1) * 40]]) for k in range(5)] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "key string, n int, samples array<double>")
    got = folds.over_table(df, "key", ["n"], folds.resampler(1, 2), "key string, first long, samples array<double>").collect()
    mine = sorted((r.first, r.samples) for r in got if r.key == "a")
    assert np.allclose(sum((list(s) for _, s in mine), []), run_blocks(folds.resampler(1, 2), x, [200]))
    assert [list(r.samples) for r in got if r.key == "b"] == [[]]


def units(n, seed):
    draw = random.Random(seed)
    return [(draw.choice("xyz"), k, draw.choice([100, 100, 200]), 1536, draw.choice([None, 48_000, 44_100]) if k > 5 else None, draw.choice([None, "5.1", "2.0"])) for k in range(n)]


def test_reports_of_batches(spark, tmp_path):
    kind = "stream string, seq int, size int, samples int, rate int, layout string"
    rows = units(300, 1)
    columns = {"size": "size", "samples": "samples", "rate": "rate", "seq": "seq", "first": ["layout"]}
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep = reports.keep_parts(f"{tmp_path}/parts", ["stream"], **columns)
    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    whole = census.stream_report(spark.createDataFrame(rows, kind), ["stream"], **columns)
    told = lambda: sorted(map(tuple, reports.read_report(spark, f"{tmp_path}/parts", ["stream"]).select(whole.columns).collect()))
    want = sorted(map(tuple, whole.collect()))
    assert told() == want
    keep(spark.createDataFrame(rows[100:200], kind), 1)  # comes again after a failure
    again = sorted(spark.read.parquet(f"{tmp_path}/parts").groupBy("batch").agg(F.sum("units").alias("n")).collect())
    assert [r.n for r in again] == [100, 100, 100]


def test_directions(spark):
    rows = ["abc", "שלום abc", "... שלום", "12 – abc שלום", "", "123 ×÷ €", "é שלום", "العربية", "日本語 א", "　א", None, "𞤀", "️א"]
    want = [False, True, True, False, False, False, False, True, False, True, None, True, True]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, t string").select("n", text.is_right_to_left(F.col("t")).alias("r"), text.is_covered(F.col("t"), [(0x20, 0x7E), (0xE9, 0xE9)]).alias("c")).orderBy("n").collect()
    assert [r.r for r in df] == want
    assert [r.c for r in df] == [None if t is None else all(ord(c) < 0x20 or ord(c) == 0x7F or 0x20 <= ord(c) <= 0x7E or c == "é" for c in t) for t in rows]
    cut = spark.range(1).select(text.without_prefix(F.lit("bench-linux"), "bench-").alias("a"), text.without_prefix(F.lit("linux"), "bench-").alias("b"), text.without_suffix(F.lit("x.json"), ".json").alias("c"), text.without_suffix(F.lit("x"), ".json").alias("d")).first()
    assert tuple(cut) == ("linux", "linux", "x", "x")
