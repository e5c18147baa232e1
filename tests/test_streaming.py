"""Folds: tables against a plain loop, streams against tables."""

import math
import random
import statistics
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays, audio
from tidemark.operators import dynamics, ordered, timeline, trailing
from tidemark.streaming import folds, windows

CASES = {
    "meter": (folds.level_meter(), f"key long, at_ms {folds.METER}"),
    "late": (folds.late_bursts(), "key long, due_us long, action string, late long, dropped long"),
    "queue": (folds.queue_model(capacity=900, rate_per_ms=0.5), "key long, at_ms double, queued double, underruns long, dry_ms double, least double"),
    "governor": (folds.governor(dwell_us=100_000, window=4, grace_us=50_000, flap_us=400_000), f"key long, {folds.GOVERNOR}"),
    "range": (folds.range_control(dynamics.PROFILES["speech"], 256 / 48), "key long, at_ms double, gain double"),
    "heavy": (folds.heavy_control(0.64), "key long, at_ms double, gain double"),
    "playhead": (folds.playhead(most=4), "key long, at_us long, position_ms double"),
    "silence": (folds.silence_watch(timeout_ms=31.0), "key long, at_ms double, quiet_ms double, timed_out boolean"),
    "in_order": (folds.in_order(), "key long, at_ms double, end long, taken boolean"),
    "servo": (folds.drift_servo(), "key long, at_ms double, ratio double"),
    "hold": (folds.hold_first(), "key long, at_ms double, released_ms double"),
    "power": (folds.power_average(tau_s=0.05), "key long, at_ms double, db double"),
    "bar": (folds.ballistic(fall_db=10.0, hold_s=0.05, peak_fall_db=4.0), "key long, at_ms double, level double, peak double"),
    "follower": (folds.follower(most=4), "key long, at_us long, item long, position_ms double"),
    "snapshots": (folds.snapshots(every=100), "key long, frame long, snapshot long, level double"),
    "clock": (folds.clock_sync(burst=3, settle=2), "key long, bursts long, offset_us long, error_us long, settled boolean"),
}


@pytest.fixture(scope="module")
def frame(spark):
    at = F.col("id") * 10 + F.pmod(F.xxhash64("id"), F.lit(7))
    r = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000))
    return spark.range(300).select(
        (F.col("id") % 3).alias("key"), "id", at.cast("double").alias("at_ms"), (r / 900).alias("peak"), (r / 2000).alias("power"), (at * 1000 - r * 30).alias("due_us"), (at * 1000).alias("slot_us"),
        F.lit(20_000).alias("period_us"), (r / 5000).alias("seconds"), (r * 60).alias("cost_us"), (r * 17).alias("late_us"), F.lit(0).alias("missed"), r.cast("double").alias("amount"), (r / 1000).alias("load"), (-r / 50).alias("target_db"), (at * 1000).alias("at_us"), r.cast("double").alias("position_ms"), F.lit(1.0).alias("speed"), (r % 2 == 0).alias("is_query"), (F.col("id") * 10 - r % 3 * 20).alias("first"), (F.col("id") * 10 + 30).alias("last"), (r - 500).cast("double").alias("error"), r.alias("offset_us"), (r * 3 % 500).alias("error_us"),
        (-r / 20).alias("db"), F.element_at(F.array(*map(F.lit, ("document", "anchor", "anchor", "query", "query", "clear", "reset"))), (r % 7 + 1).cast("int")).alias("kind"), (r % 2).alias("item"), (F.col("id") * 10).alias("frame"), r.cast("double").alias("level"), (F.col("id") * 10 - r).alias("heard"),
    )


@pytest.mark.parametrize("name", CASES)
def test_table_and_stream_equal_a_loop(spark, frame, tmp_path, name):
    fold, schema = CASES[name]
    want = []
    for key in range(3):
        state = fold[0]()
        want += [(key, *got) for row in frame.where(F.col("key") == key).orderBy("at_ms", "id").collect() if (got := fold[1](state, row)) is not None]
    got = [tuple(r) for r in folds.over_table(frame, "key", ["at_ms", "id"], fold, schema).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for k in range(3):
        frame.where(F.col("id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = folds.over_stream(stream, "key", ["at_ms", "id"], fold, schema).writeStream.format("memory").queryName(f"fold_{name}").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((tuple(r) for r in spark.table(f"fold_{name}").collect()), key=str) == sorted(want, key=str)


def test_notes(spark):
    a, b = 440.0, 494.0
    points = [(0, k, a) for k in range(10)] + [(0, 10, 0.0), (0, 11, 0.0)] + [(0, k, a) for k in range(12, 16)] + [(0, k, b) for k in range(16, 30)] + [(0, k, 0.0) for k in range(30, 40)] + [(0, 40, a), (0, 41, -1.0)]
    got = folds.over_table(spark.createDataFrame(points, "key long, grid_idx long, hz double"), "key", ["grid_idx"], folds.notes(), "key long, start_idx long, end_idx long, hz double").collect()
    assert [tuple(r) for r in got] == [(0, 0, 15, a), (0, 16, 29, b)]


def test_sliding_power(spark):
    rows = spark.range(20).select(F.lit(1).alias("k"), F.timestamp_millis(F.col("id") * 50 + 10_000).alias("ts"), F.col("id").cast("double").alias("p"))
    full = windows.sliding_power(rows, ["k"], "ts", "p").where("samples = 8").orderBy("start").collect()
    assert [r.power for r in full] == [3.5 + 2 * k for k in range(7)]


def loop(fold, rows):
    state = fold[0]()
    return [got for r in rows if (got := fold[1](state, r)) is not None]


def series(n, seed, **columns):
    rnd = random.Random(seed)
    at, out = 0.0, []
    for _ in range(n):
        at += rnd.choice([1, 5, 20, 40])
        out.append(SimpleNamespace(at_ms=at, **{k: f(rnd, at) for k, f in columns.items()}))
    return out


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def test_rule_of_the_range_control():
    """From 0 dB; the gain is the weighted sum of all targets so far, each with what the later steps left of it."""
    rows = series(80, 1, target_db=lambda r, _: -r.random() * 20)
    fast, slow = math.exp(-0.5), math.exp(-0.05)
    terms, gain, want = [(1.0, 0.0)], 0.0, []
    for r in rows:
        keep = fast if r.target_db < gain else slow
        terms = [(w * keep, x) for w, x in terms] + [(1 - keep, r.target_db)]
        gain = sum(w * x for w, x in terms)
        want.append((r.at_ms, gain))
    profile = dynamics.Profile(attack_ms=10.0, release_ms=100.0)
    near(loop(folds.range_control(profile, 5.0), rows), want)
    assert loop(folds.range_control(dynamics.Profile(attack_ms=0.0), 5.0), rows)[0] == (rows[0].at_ms, rows[0].target_db)


def test_heavy_gain_as_a_window_and_as_a_fold(spark):
    rows = series(300, 9, target_db=lambda r, _: r.choice([-9.0, 3.0, r.uniform(-20, 10)]))
    want = loop(folds.heavy_control(0.64), rows)
    df = spark.createDataFrame([("a", r.at_ms, k, r.target_db) for k, r in enumerate(rows)] + [("a", 5.0, 1000, None), ("b", 0.0, 0, 4.0)], "k string, at_ms double, n int, t double")
    got = dynamics.heavy_gain(df, ["k"], ["n"], "t", 0.64).orderBy("k", "n").collect()
    near([(r.at_ms, r.gain_db) for r in got], [*want, (0.0, 4.0)])
    assert want[0][1] == rows[0].target_db and any(b[1] - a[1] == pytest.approx(0.64) for a, b in zip(want, want[1:], strict=False))


@pytest.mark.parametrize("words", [dynamics.RANGE, dynamics.HEAVY])
def test_gain_words(spark, words):
    gains = {w: dynamics.gain_of(w, words) for w in range(256)}
    assert len(set(gains.values())) == 256 and all(math.isclose(20 * math.log10(gains[w]), x) for w, x in ((0, 0.0), (256 - (1 << words.bits), 20 * math.log10(0.5))))
    draw = random.Random(4)
    db = [20 * math.log10(g) for g in gains.values()] + [draw.uniform(-60, 60) for _ in range(2000)] + [-900.0, 900.0]
    df = spark.createDataFrame([(x,) for x in db], "db double").select("db", dynamics.encode(F.col("db"), words).alias("near"), dynamics.encode(F.col("db"), words, at_most=True).alias("under"))
    for r in df.collect():
        g = 10 ** (r.db / 20)
        least = min(abs(x - g) for x in gains.values())
        assert math.isclose(abs(gains[r.near] - g), least, rel_tol=1e-9, abs_tol=1e-12)
        under = max((x for x in gains.values() if x <= g * (1 + 1e-9)), default=min(gains.values()))
        assert math.isclose(gains[r.under], under, rel_tol=1e-9)
    assert df.select(dynamics.encode(F.lit(None).cast("double"), words).alias("w")).first().w is None


def test_curves(spark):
    for name, p in dynamics.PROFILES.items():
        levels = [x / 4 for x in range(-480, 41)]
        got = [r.g for r in spark.createDataFrame([(x,) for x in levels], "x double").select("x", dynamics.static_gain(p, F.col("x")).alias("g")).orderBy("x").collect()]
        assert all(a >= b >= a - 0.25 for a, b in zip(got, got[1:], strict=False)), name  # falling, without steps
        assert got[0] == p.most_boost and all(g == 0 for x, g in zip(levels, got, strict=True) if p.null_low <= x <= p.null_high)
        assert got[-1] - got[-5] == pytest.approx(-1 / p.cut_ratio)
    assert [dynamics.corners(dynamics.PROFILES[n])[0][0] for n in ("film-standard", "film-light", "music-standard", "music-light")] == [-43, -53, -55, -65]
    peak = spark.range(1).select(dynamics.heavy_target(F.lit(-30.0), F.lit(27)).alias("quiet"), dynamics.heavy_target(F.lit(-1.0), F.lit(31)).alias("loud"), dynamics.heavy_target(F.lit(-30.0), F.lit(0)).alias("reserved")).first()
    assert tuple(peak) == (0.0, -10.5, 0.0)


def test_rule_of_the_clock():
    rows = series(120, 2, offset_us=lambda r, _: r.randrange(4000), error_us=lambda r, _: r.randrange(50))
    best = []
    for k in range(0, 120, 8):
        least = min(x.error_us for x in rows[k : k + 8])
        best.append(next((x.offset_us, x.error_us) for x in rows[k : k + 8] if x.error_us == least))
    settled = [any(j >= 8 and abs(best[j][0] - best[j - 1][0]) <= 1000 for j in range(k + 1)) for k in range(15)]
    assert loop(folds.clock_sync(), rows) == [(k + 1, *best[k], settled[k]) for k in range(15)] and any(settled)


def test_rule_of_the_playhead():
    rows = series(200, 3, at_us=lambda r, at: int(at * 1000) - r.choice([0, 0, 30_000]), position_ms=lambda r, _: r.random() * 1000, speed=lambda r, _: r.choice([0.0, 0.5, 1.0]), is_query=lambda r, _: r.random() < 0.5)
    want = []
    for k, q in enumerate(rows):
        if not q.is_query:
            continue
        anchors = {}
        for a in rows[:k]:
            if not a.is_query:
                anchors[a.at_us] = a
                anchors = {t: anchors[t] for t in sorted(anchors)[-4:]}
        due = [t for t in anchors if t <= q.at_us]
        a = anchors[max(due)] if due else None
        want.append((q.at_us, max(0.0, a.position_ms + (q.at_us - a.at_us) / 1000 * a.speed) if a else None))
    near(loop(folds.playhead(most=4), rows), want)


def test_rule_of_the_level_meter():
    rows = series(150, 4, seconds=lambda r, _: r.choice([0.005, 0.05, 0.4]), peak=lambda r, _: -(r.random() ** 4) if r.random() < 0.9 else 0.0, power=lambda r, _: r.random())
    got = loop(folds.level_meter(hold_ms=60.0, clip=0.9), rows)
    ends = [sum(x.seconds for x in rows[: k + 1]) for k in range(len(rows))]
    for k, (r, (at, peak, held, rms, clipped)) in enumerate(zip(rows, got, strict=True)):
        past = list(zip(rows, ends, strict=True))[: k + 1]
        db = [20 * math.log10(abs(x.peak)) if x.peak else -120.0 for x, _ in past]
        assert at == r.at_ms and clipped == any(abs(x.peak) >= 0.9 for x, _ in past)
        assert peak == pytest.approx(max(-120.0, max(b - 20 * (ends[k] - end) for b, (_, end) in zip(db, past, strict=True))), abs=1e-9)
        power = sum((1 - math.exp(-x.seconds / 0.3)) * math.exp(-(ends[k] - end) / 0.3) * x.power for x, end in past)  # from silence
        assert rms == pytest.approx(10 * math.log10(power), abs=1e-9)
        top = max(j for j, b in enumerate(db) if b == max(db))
        assert max(db[-1], peak) - 1e-9 <= held <= max(db) and (ends[k] - ends[top] > 0.06 or held == max(db))
    assert got[0][3] < 20 * math.log10(math.sqrt(rows[0].power))


def test_rule_of_the_queue():
    """What has drained since the start, less the dry time, is what left the queue."""
    rows = series(100, 5, amount=lambda r, _: float(r.randrange(12)))
    got = loop(folds.queue_model(capacity=30, rate_per_ms=0.5), rows)
    fill, dry, under, least, last = 0.0, 0.0, 0, None, None
    for r, g in zip(rows, got, strict=True):
        for _ in range(int(r.at_ms - last) if last is not None else 0):  # a millisecond at a time
            fill -= 0.5
        if last is not None:
            least = fill if least is None or fill < least else least
            if fill < 0:
                under, dry = under + 1, dry - 2 * fill
        fill = min(30.0, (fill if fill > 0 else 0.0) + r.amount)
        last = r.at_ms
        near([g], [(r.at_ms, fill, under, dry, least)])
    assert under and any(g[1] == 30.0 for g in got)


def test_rule_of_the_servo_and_of_bytes_in_order():
    rows = series(90, 6, error=lambda r, _: r.uniform(-90, 90))
    want = []
    for k, r in enumerate(rows):
        trim = sum(0.1 * 0.9 ** (k - j) * min(0.05, max(-0.05, x.error / 100)) for j, x in enumerate(rows[: k + 1]))
        want.append((r.at_ms, min(2.0, max(0.5, 1 + trim))))
    near(loop(folds.drift_servo(), rows), want)
    rows = series(150, 7, first=lambda r, at: int(at) - r.randrange(60), last=lambda r, at: int(at) + r.randrange(60))
    have, want = {rows[0].first}, []
    for r in rows:  # the bytes themselves
        end = max(have)
        taken = r.first in have and r.last > end or r.first < min(have) and r.last > end
        have |= set(range(end, r.last + 1)) if taken else set()
        want.append((r.at_ms, max(have), taken))
    assert loop(folds.in_order(), rows) == want and len({t for _, _, t in want}) == 2


def updates(*parts):
    """Rows of updates 50 ms apart: (how many, cost in ms, late in ms, missed)."""
    out = []
    for n, cost, late, missed in parts:
        out += [SimpleNamespace(at_us=50_000 * (len(out) + k), cost_us=1000 * cost, late_us=1000 * late, missed=missed) for k in range(n)]
    return out


def changes(rows, **limits):
    got, was = loop(folds.governor(**limits), rows), False
    out = []
    for now, n, slow, dwell, *_ in got:
        if slow != was:
            out.append((n, slow, dwell // 1_000_000))
        was = slow
    return out, got


def test_rule_of_the_governor():
    falls = lambda *parts, **limits: changes(updates(*parts), **limits)[0]
    # two seconds of grace (40 updates), then a full window
    assert falls((200, 36, 0, 0)) == [(60, True, 10)]
    assert falls((300, 35, 0, 0)) == []  # 70 % is not over 70 %
    assert falls((100, 10, 16, 0)) == [(60, True, 10)]  # late, though cheap
    assert falls((100, 10, 15, 0), (3, 10, 16, 0), (100, 10, 0, 0)) == []  # three late ones don't do
    assert falls((100, 10, 0, 0), (4, 10, 0, 1), (19, 10, 0, 0)) == [(104, True, 10)]  # missed steps do
    rise = 60 + 200  # ten seconds after the fall
    assert falls((60, 40, 0, 0), (300, 29, 0, 0)) == [(60, True, 10), (rise, False, 10)]
    assert falls((60, 40, 0, 0), (300, 31, 0, 0)) == [(60, True, 10)]  # between the thresholds
    assert falls((60, 40, 0, 0), (195, 29, 0, 0), (1, 29, 16, 0), (60, 29, 0, 0))[1] == (276, False, 10)  # a late update has to leave the window
    # a fall within a minute of a rise doubles the dwell; a minute at the fast rate puts it back
    quick = [(60, 40, 0, 0), (200, 29, 0, 0), (420, 40, 0, 0)]
    assert falls(*quick, (1000, 29, 0, 0)) == [(60, True, 10), (260, False, 10), (280, True, 20), (699, False, 20)]
    again = falls((60, 40, 0, 0), (200, 29, 0, 0), (20, 40, 0, 0), (400, 29, 0, 0), (1199, 29, 0, 0), (100, 40, 0, 0))
    assert again[:4] == [(60, True, 10), (260, False, 10), (280, True, 20), (680, False, 20)] and again[4][1:] == (True, 10)
    assert falls(*quick, most_us=15_000_000)[2] == (280, True, 15)


def test_rule_of_late_bursts_and_of_power():
    rows = series(120, 9, due_us=lambda r, at: int(at * 1000) - r.randrange(30_000), slot_us=lambda r, at: int(at * 1000) if at > 60 else None, period_us=lambda *_: 20_000)
    got = loop(folds.late_bursts(), rows)
    moved = [(k, r) for k, r in enumerate(rows) if r.slot_us is not None]
    for k, r in moved:
        past = [x for j, x in moved if j <= k]
        assert got[k][2:] == (sum(x.due_us < x.slot_us for x in past), sum(x.slot_us - x.due_us > 15_000 for x in past))
        assert got[k][1] == ("drop" if r.slot_us - r.due_us > 15_000 else "play" if r.due_us - r.slot_us <= 10_000 else "wait")
    rows = series(60, 10, db=lambda r, _: r.uniform(-60, 0))
    for k, (_, db) in enumerate(loop(folds.power_average(tau_s=0.05), rows)):
        past = rows[: k + 1]
        weights = [math.exp(-(rows[k].at_ms - x.at_ms) / 50) * (1.0 if j == 0 else 1 - math.exp(-(x.at_ms - past[j - 1].at_ms) / 50)) for j, x in enumerate(past)]
        assert math.isclose(db, 10 * math.log10(sum(w * 10 ** (x.db / 10) for w, x in zip(weights, past, strict=True))), rel_tol=1e-9)


def test_rule_of_notes():
    """Random melodies: each note's points lie within the split of the median before them, and nothing longer fits."""
    rnd = random.Random(11)
    points, want, k = [], [], 0
    for _ in range(40):
        hz, n, rest = 220 * 2 ** (rnd.randrange(12) / 12), rnd.randrange(2, 12), rnd.choice([5, 6, 9])
        here = [k + j for j in range(n)]
        points += [SimpleNamespace(grid_idx=j, hz=hz) for j in here]
        k += n
        points += [SimpleNamespace(grid_idx=k + j, hz=0.0) for j in range(rest)]
        k += rest
        if n >= 6:
            want.append((here[0], here[-1], hz))
    assert loop(folds.notes(), [*points, SimpleNamespace(grid_idx=k, hz=-1.0)]) == want and len(want) > 10


def test_rules_of_the_bar_the_follower_and_snapshots():
    db = [-20.0, -5.0, -30.0, -30.0, -30.0, -30.0, -2.0]
    rows = [SimpleNamespace(at_ms=1000.0 * k, db=x) for k, x in enumerate(db)]
    got = loop(folds.ballistic(fall_db=10.0, hold_s=2.0, peak_fall_db=4.0), rows)
    assert [g[1] for g in got] == [-20.0, -5.0, -15.0, -25.0, -30.0, -30.0, -2.0] and [g[2] for g in got] == [-20.0, -5.0, -5.0, -5.0, -9.0, -13.0, -2.0]
    row = lambda at, kind, item=0, position=0.0: SimpleNamespace(at_us=at, kind=kind, item=item, position_ms=position, speed=1.0)
    rows = [row(0, "anchor", 1, 5.0), row(1, "query"), row(2, "document", 1), row(3, "anchor", 2, 7.0), row(4, "query"), row(1000, "anchor", 1, 50.0), row(3000, "query"), row(3001, "clear"), row(3002, "query"), row(3003, "anchor", 1, 9.0), row(4003, "query"), row(5000, "reset"), row(5001, "query")]
    assert loop(folds.follower(), rows) == [(1, None, None), (4, 1, None), (3000, 1, 52.0), (3002, 1, None), (4003, 1, 10.0), (5001, None, None)]
    rows = [SimpleNamespace(frame=f, level=float(f), heard=h) for f, h in ((5, 0), (12, 0), (25, 9), (31, 10), (32, 29), (45, 45))]
    assert loop(folds.snapshots(every=10), rows) == [(5, None, None), (12, None, None), (25, None, None), (31, 10, 12.0), (32, 20, 25.0), (45, 40, 45.0)]


def test_the_own_commit_is_left_out(spark):
    rows = [(0, "a", "m", 50.0), (1, "b", "m", 30.0), (2, "b", "m", 10.0), (3, "a", "m", 20.0), (4, None, "m", 1.0), (5, None, "m", 2.0), (6, "b", "m", 7.0)]
    frame = spark.createDataFrame(rows, "seq int, commit string, leg string, v double")
    got = {r.seq: r.baseline for r in trailing.trailing_mean(frame, ["leg"], ["seq"], "v", n=2, commit="commit").collect()}
    assert got == {0: None, 1: 50.0, 2: 50.0, 3: 20.0, 4: 15.0, 5: 10.5, 6: 1.5}
    both = trailing.like_for_like(frame.withColumn("cpu", F.lit("x")), ["leg"], "cpu", ["seq"], "v", n=2, commit="commit")
    assert {r.seq: r.baseline for r in both.collect()} == got


def test_baselines_by_stretches_of_commits(spark):
    """Interleaved commits and null ones against a plain loop, and a commit with very many records."""
    draw = random.Random(12)
    rows = [(draw.choice("ab"), k, draw.choice([None, "x", "y", "z"]) if draw.random() < 0.4 else "x", draw.choice([None, 1.0, 2.0, 5.0])) for k in range(400)]
    df = spark.createDataFrame([*rows, (None, 900, "x", 1.0), (None, 901, "y", 1.0)], "leg string, seq int, commit string, v double")
    for n in (1, 3, 10):
        got = {r.seq: (r.baseline, r.n) for r in trailing.trailing_mean(df, ["leg"], ["seq"], "v", n=n, count="n", commit="commit").collect()}
        assert got.pop(900) == got.pop(901) == (None, 0)
        for leg, seq, commit, _ in rows:
            past = [v for g, s, c, v in rows if g == leg and s < seq and (c is None or c != commit)][-n:]
            past = [v for v in past if v is not None]
            want = (sum(past) / len(past) if past else None, len(past))
            assert got[seq][1] == want[1] and (got[seq][0] == want[0] or abs(got[seq][0] - want[0]) < 1e-12), (n, seq)
    many = spark.range(100_000).select(F.lit("a").alias("leg"), F.col("id").cast("int").alias("seq"), F.when(F.col("id") < 3, "old").otherwise("big").alias("commit"), F.col("id").cast("double").alias("v"))
    got = trailing.trailing_mean(many, ["leg"], ["seq"], "v", commit="commit").where("seq >= 3").select("baseline").distinct().collect()
    assert [r.baseline for r in got] == [1.0]


def test_keyframes_pitch_and_json_numbers(spark):
    with pytest.raises(Exception, match="two keyframes at"):
        timeline.keyframes(spark.createDataFrame([(1, 5), (1, 5)], "k int, at int"), ["k"], "at").collect()
    tone = [math.sin(2 * math.pi * 440 * k / 16_000) for k in range(1184)]
    frame = spark.createDataFrame([(0, tone), (1, [0.0] * 1184), (2, None), (3, tone[:10])], "id int, x array<double>")
    framed = frame.select("id", F.inline_outer(arrays.frames_of(F.col("x"), 1024, 160)))
    got = framed.withColumn("p", arrays.pitch(16_000.0)(F.col("samples"))).select("id", "frame", "p.*").collect()
    assert [(r.id, r.frame) for r in got if r.id == 0] == [(0, 0), (0, 1)] and all(abs(r.hz - 440) < 0.5 and r.clarity > 0.95 for r in got if r.id == 0)
    assert [r.hz for r in got if r.id == 1] == [0.0, 0.0] and [(r.frame, r.hz) for r in got if r.id > 1] == [(None, None)] * 2
    texts = spark.createDataFrame([('{"v": 3}',), ('{"v": 2.5}',), ('{"v": true}',), ('{"v": "7"}',), ("{}",), ("broken",), (None,)], "j string")
    assert [r.n for r in texts.select(audio.json_number(F.col("j"), "v").alias("n")).collect()] == [3.0, 2.5, None, None, None, None, None]


def test_snapshots_cost_the_same_far_from_zero():
    """Frames that begin at 10^15, with holes: what is released is the newest multiple that was heard, the state stays small."""
    rnd, fold = random.Random(3), folds.snapshots(every=10)
    state, frame, rows, got = fold[0](), 10**15, [], []
    for _ in range(2000):
        frame += rnd.choice([1, 3, 40, 10**6])
        rows.append(SimpleNamespace(frame=frame, level=float(rnd.randrange(1000)), heard=frame - rnd.choice([0, 5, 60, 3 * 10**6])))
        got.append(fold[1](state, rows[-1]))
        assert len(state["held"]) < 2000
    best = -1
    for k, r in enumerate(rows):
        best = max(best, r.heard // 10 * 10)
        assert got[k] == (r.frame, best, next(x.level for x in rows if x.frame >= best))


def test_baselines_of_sparse_series_take_one_sort(spark, monkeypatch):
    """Series whose commits have few records each side by side are not dealt with by stretches, crowded ones are; both and
    series with ties and null commits are as a plain loop has them."""
    seen, slow = [], trailing._with_stretches
    monkeypatch.setattr(trailing, "_with_stretches", lambda df, *a: seen.append({r.leg for r in df.select("leg").distinct().collect()}) or slow(df, *a))
    draw = random.Random(13)
    commits = {"sparse": lambda k: f"c{k // 2 % 7 if k % 40 == 1 else k % 7}", "crowded": lambda k: draw.choice("xxxxxxxy"), "alternating": lambda k: "xy"[k % 2], "null": lambda k: draw.choice([None, "x"])}
    rows = [(leg, k, f(k), [float(draw.randrange(9)), float(k)]) for leg, f in commits.items() for k in range(120)]
    df = spark.createDataFrame([*rows, (None, 900, "x", [1.0]), (None, 901, "y", [1.0])], "leg string, seq int, commit string, v array<double>")
    got = {(r.leg, r.seq): r.baseline for r in trailing.trailing_channels(df, ["leg"], ["seq"], "v", n=4, commit="commit").collect()}
    assert len(seen) == 1 and "crowded" in seen[0] and not {"sparse", "alternating"} & seen[0]
    assert got.pop((None, 900)) is None and got.pop((None, 901)) is None
    for leg, seq, commit, _ in rows:
        past = [v for g, s, c, v in rows if g == leg and s < seq and (c is None or c != commit)][-4:]
        assert got[leg, seq] == ([sum(x[k] for x in past) / len(past) for k in range(2)] if past else None)
