"""Sources and sinks on small files, and operators on their published examples."""

import json
import math
import pathlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import audio
from tidemark.operators import compare, stats, timeline, trailing
from tidemark.sources import appended, histories, sinks, timed_text


def put(path, text):
    path = pathlib.Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_history_keeps_order(spark, tmp_path):
    p = put(tmp_path / "h.jsonl", '{"commit":"b","worst_db":50}\n\n{bad\n{"commit":"a","worst_db":30}\n')
    got = histories.read_history(spark, p, "commit string, worst_db double").orderBy("seq").collect()
    assert [(r.seq, r.commit, r.worst_db) for r in got] == [(0, "b", 50.0), (3, "a", 30.0)]
    with pytest.raises(Exception, match=r"(?i)malformed"):
        histories.read_history(spark, p, "commit string, worst_db double", skip_malformed=False).collect()


@pytest.fixture
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield spark
    spark.conf.set(name, old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_large_history_is_read_by_many_tasks(small_blocks, tmp_path):
    lines = [json.dumps({"n": k, "pad": "é" * (k * 7 % 90)}) for k in range(200)]
    for k in (0, 5, 6, 120):
        lines[k] = ""
    lines[77] = '{"n": "cut'
    put(tmp_path / "a.jsonl", "\r\n".join(lines))
    put(tmp_path / "b.jsonl", "\n" * 300 + '{"n": 7}\n')
    put(tmp_path / "c.jsonl", "")
    read = histories.numbered_lines(small_blocks, str(tmp_path))
    assert read.where("file LIKE '%a.jsonl'").rdd.getNumPartitions() > 20
    got = {(r.file[-7:], r.seq): r.line for r in read.collect()}
    assert [got["a.jsonl", k] for k in range(200)] == lines
    assert got["b.jsonl", 300] == '{"n": 7}' and len(got) == 501
    rows = histories.read_history(small_blocks, str(tmp_path), "n int").collect()
    assert sorted((r.file[-7:], r.seq, r.n) for r in rows) == [("a.jsonl", k, k) for k in range(200) if lines[k] and k != 77] + [("b.jsonl", 300, 7)]


def test_appended_lines_come_once(spark, tmp_path):
    folder, at, out = tmp_path / "in", str(tmp_path / "at"), str(tmp_path / "out")
    folder.mkdir()

    def told(**more):
        frame = appended.follow_history(spark, str(folder), "n int", part_bytes=50, **more)
        query = frame.writeStream.format("parquet").option("checkpointLocation", at).option("path", out).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.file[-7:], r.at, r.n) for r in spark.read.parquet(out).collect())

    def line(n):
        return json.dumps({"n": n, "pad": "ß" * (n * 5 % 70)}) + "\n"

    (folder / "a.jsonl").write_text("".join(map(line, range(40))) + '{"n": 40')  # the last line is still being written
    (folder / "notes.txt").write_text('{"n": 1}\n')
    where = [0]
    for n in range(40):
        where.append(where[-1] + len(line(n).encode()))
    first = [("a.jsonl", where[n], n) for n in range(40)]
    assert told() == first
    with open(folder / "a.jsonl", "a") as f:
        f.write('}\n\n{bad\n{"n": 42}\r\n')
    (folder / "b.jsonl").write_text('{"n": 5}\n')
    second = sorted([*first, ("a.jsonl", where[40], 40), ("a.jsonl", where[40] + 10 + 1 + 5, 42), ("b.jsonl", 0, 5)])
    assert told() == second
    assert told() == second  # a restart without news


def test_results_with_environment(spark, tmp_path):
    put(tmp_path / "bench-linux/bench_a.json", json.dumps({"real_time_budget_ms_per_frame": 32.0, "results": [{"name": "x", "ms_per_frame": 2.0}, {"name": "y", "ms_per_frame": 1.0}]}))
    put(tmp_path / "bench-mac/bench_b.json", json.dumps({"results": [{"name": "x", "ms_per_frame": 3.0}]}))
    put(tmp_path / "bench-linux/environment.json", json.dumps({"cpu_model": "m1"}))
    got = histories.read_results(spark, str(tmp_path), "real_time_budget_ms_per_frame double, results array<struct<name: string, ms_per_frame: double>>", prefix="bench-", environment="cpu_model string", stem="check").collect()
    assert sorted((r.leg, r.name, r.ms_per_frame, r.cpu_model or "", r.check) for r in got) == [("linux", "x", 2.0, "m1", "bench_a"), ("linux", "y", 1.0, "m1", "bench_a"), ("mac", "x", 3.0, "", "bench_b")]
    runs = histories.load_runs(spark, str(tmp_path), entries="results", key="name", value="ms_per_frame", pattern="bench_*.json")
    best = {r.workload: (r.best, r.spread, r.runs) for r in compare.best_of_runs(runs, ["workload"], "value").collect()}
    assert best == {"x": (2.0, 0.5, 2), "y": (1.0, 0.0, 1)}


def test_sheets(spark, tmp_path):
    put(tmp_path / "r/a.csv", "listener,trial,answer\nl1,1,A\n , ,\nl2,1,B\n")
    put(tmp_path / "r/responses_template.csv", "listener,trial,answer\nx,1,A\n")
    assert sorted(r.listener for r in histories.read_responses(spark, str(tmp_path / "r")).collect()) == ["l1", "l2"]
    method, key = histories.read_key(spark, put(tmp_path / "k.csv", "trial,leg,system,x\n1,l,s,A\n"))
    assert method == "abx" and key.count() == 1
    with pytest.raises(ValueError, match="no rows"):
        histories.read_key(spark, put(tmp_path / "e.csv", "trial,leg\n"))
    m = histories.read_manifest(spark, put(tmp_path / "m.json", '{"legs": {"a": {"v": 1.5}, "b": {}}}'), "v: double")
    assert {(r.name, r.v) for r in m.collect()} == {("a", 1.5), ("b", None)}
    log = put(tmp_path / "log.txt", "2026-01-02T03:04:05.6Z \x1b[32mpeak 12 of 34\nother\n")
    assert [(r.a, r.b) for r in histories.scan_log(spark, log, r"^peak (\d+) of (\d+)", ["a", "b"]).collect()] == [("12", "34")]


def test_timed_text(spark, tmp_path):
    p = put(tmp_path / "a.lrc", "[ti:Song]\n[00:10.50][01:00.5]Hey <00:11.00>you\n[00:02]First\n\n[75:00.123]Late\n")
    got = timed_text.read_lrc(spark, p).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(2000, 10500, "First"), (10500, 60500, "Hey you"), (60500, 4500123, "Hey you"), (4500123, None, "Late")]
    lines = [r.value for r in timed_text.lrc_lines(timed_text.read_lrc(spark, p).orderBy("start_ms")).collect()]
    assert lines == ["[00:02.00]First", "[00:10.50]Hey you", "[01:00.50]Hey you", "[75:00.12]Late"]
    s = put(tmp_path / "a.srt", "1\r\n00:00:01,500 --> 00:00:02,000\r\n<i>One</i>\r\ntwo\r\n\r\n2\n01:00:00,000 --> 01:00:01,000\nThree\n")
    assert [(r.start_ms, r.end_ms, r.text) for r in timed_text.read_subrip(spark, s).orderBy("seq").collect()] == [(1500, 2000, "One two"), (3600000, 3601000, "Three")]


def test_scene(spark, tmp_path):
    p = put(tmp_path / "s.txt", "# comment\n1 0.0 0.040 0.5 0\n1 2.0 0.960 0.5 0 0.5 # more\n")
    frames = timed_text.read_scene(spark, p)
    q = spark.createDataFrame([(1, -1.0), (1, 1.0), (1, 5.0)], "object int, time_s double")
    got = {r.time_s: r.x for r in timeline.at_times(q, frames, ["object"], "time_s", "x", hold=["gain"]).collect()}
    assert got[-1.0] == 0.04 and abs(got[1.0] - 0.5) < 1e-12 and got[5.0] == 0.96
    for bad in ("1 0 0 x 0\n", "1 0 0 0 0\n1 0 1 1 1\n"):
        with pytest.raises(Exception, match="keyframe"):
            timed_text.read_scene(spark, put(tmp_path / "bad.txt", bad)).collect()


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([(0, 0, 0, 1, True, [7, 8]), (0, 0, 1, 1, False, [9])], "frame int, substream int, block int, stream int, allocated boolean, mask array<int>")
    assert [tuple(r) for r in sinks.tidy_trace(b, {"mask": "mask"}).collect()] == [(0, 0, 0, 1, "mask", 0, 7), (0, 0, 0, 1, "mask", 1, 8)]
    h = spark.createDataFrame([("c1", "k", 1.0)], "commit string, k string, v double")
    rows = spark.createDataFrame([("c1", "k", 1.0), ("c2", "k", 2.0)], h.schema)
    assert sinks.append_new(rows, h, ["commit", "k"], str(tmp_path / "out")).count() == 2
    assert [r.commit for r in spark.read.json(str(tmp_path / "out")).collect()] == ["c2"]
    twice = rows.unionByName(rows)  # a batch that repeats itself is appended once
    assert sinks.append_new(twice, None, ["commit", "k"], str(tmp_path / "once")).count() == 4 and spark.read.json(str(tmp_path / "once")).count() == 2
    many = spark.range(100).select((F.col("id") / 4).cast("int").cast("string").alias("commit"), F.col("id").alias("seq"))
    assert not sinks.write_recent(many, "commit", "seq", str(tmp_path / "w"), n=25) and sinks.write_recent(many, "commit", "seq", str(tmp_path / "w"), n=3)
    assert sorted(r.seq for r in spark.read.json(str(tmp_path / "w")).collect()) == list(range(88, 100))
    one = spark.range(1).select(sinks.badge(F.lit("a"), F.lit("b"), F.lit("red")).alias("b"), sinks.report_line(F.lit(1), F.lit(None), side=F.lit("new")).alias("r")).first()
    assert json.loads(one.b) == {"schemaVersion": 1, "label": "a", "message": "b", "color": "red"} and one.r == "| 1 | - | new |"


def test_changed_files_and_beds(spark, tmp_path):
    import hashlib

    for name in ("a.wav", "b.wav", "c.wav"):
        (tmp_path / name).write_bytes(name.encode() * 1000)
    sha = lambda x: hashlib.sha256(x.encode() * 1000).hexdigest()
    manifest = spark.createDataFrame([("a.wav", sha("a.wav").upper()), ("b.wav", sha("x")), ("d.wav", sha("d.wav")), ("c.wav", None)], "name string, sha256 string")
    got = lambda m: sorted(map(tuple, histories.changed_files(spark, str(tmp_path), m).collect()))
    assert got(manifest) == [("b.wav", "changed"), ("c.wav", "changed"), ("d.wav", "missing")]
    assert got(manifest.limit(0)) == [(n, "unlisted") for n in ("a.wav", "b.wav", "c.wav")]
    beds = spark.createDataFrame([(0,), (0b1110000000 + 0b1000000,), (0x3FF,), (0b0010000000,), (None,)], "m int").select(audio.bed_channels(F.col("m")).alias("n"))
    assert [r.n for r in beds.collect()] == [0, 6, 17, 1, None]


def test_published_examples(spark):
    h = spark.createDataFrame([(0, "a", [10.0]), (1, "a", [20.0, 30.0]), (2, "a", [40.0, 50.0]), (3, "a", [0.0, 0.0])], "seq int, leg string, ch array<double>")
    assert trailing.trailing_channels(h, ["leg"], ["seq"], "ch").where("seq = 3").first().baseline == [30.0, 40.0]
    words = spark.range(256).select(F.col("id").cast("int").alias("w")).select("w", audio.dynrng_gain(F.col("w")).alias("d"), audio.compr_gain(F.col("w")).alias("c")).collect()
    assert words[0x7F].d == 15.75 and words[0x80].d == 0.0625 and words[0x7F].c == 248.0 and words[0x80].c == 1 / 256
    tiers = spark.range(1).select(*(compare.tier(F.lit(x), F.lit(0.05)).alias(n) for n, x in (("a", 1.0), ("b", 0.2), ("c", 0.04), ("d", -0.2), ("e", 0.1)))).first()
    assert tuple(tiers) == ("hard", "regression", "unchanged", "faster", "slower")
    p = spark.range(1).select(stats.binomial_tail(F.lit(8), F.lit(10)).alias("p"), stats.binomial_tail(F.lit(0), F.lit(0)).alias("z"), *(x.alias(n) for n, x in zip("lh", stats.wilson(F.lit(0), F.lit(0)), strict=True))).first()
    assert math.isclose(p.p, 0.0546875) and p.z == 1.0 and p.l is None and p.h is None
    folded = spark.createDataFrame([(x,) for x in (600.0, -600.0, 601.0, -1201.0)], "c double").select(audio.fold_octaves(F.col("c")).alias("f"))
    assert [r.f for r in folded.collect()] == [600.0, 600.0, -599.0, -1.0]
    base, ours, theirs = (spark.createDataFrame([(r, k) for k, r in enumerate(x)], "row string, seq int") for x in (["a"], ["a", "b"], ["a", "c"]))
    got = {(r.row, r.added) for r in compare.three_way_union(base, ours, theirs, "row", "seq").collect()}
    assert got == {("a", False), ("b", False), ("c", True)}
    with pytest.raises(Exception, match="no entry"):
        compare.require_lookup(spark.range(3).toDF("k"), spark.range(2).toDF("k"), ["k"]).collect()
    t = spark.createDataFrame([("1.5",), ("1,5",), (" 1",), ("nan",), ("1e3",)], "s string").select(audio.strict_number(F.col("s")).alias("n"))
    assert [r.n for r in t.collect()] == [1.5, None, None, None, 1000.0]
    w = spark.createDataFrame([(1, 0, "one ", 0, 1000), (1, 1, "three", 0, 1000), (1, 2, "-", 0, 1000)], "line int, k int, word string, s long, e long")
    assert [(r.word_start, r.word_end) for r in trailing.word_times(w, "line", "k", "word", "s", "e").orderBy("k").collect()] == [(0, 330), (330, 890), (890, 1000)]
