"""The bleed monitor recovers planted rooms and delays, and doesn't depend on how signals are cut into blocks."""

import numpy as np
import pytest

from tidemark.operators import bleed

O = bleed.Bleed(rate=4000, taps=8)


def noise(seed, n):
    return np.random.default_rng(seed).normal(0, 0.1, n)


def room(played, delay, taps):
    out = np.convolve(np.concatenate([np.zeros(delay), played]), taps)
    return out[: len(played)]


def blocks(spark, signals, sizes):
    rows = []
    for key, x in signals.items():
        at, k = 0, 0
        while at < len(x):
            n = sizes[k % len(sizes)]
            rows.append((key, at, [float(v) for v in x[at : at + n]]))
            at, k = at + n, k + 1
    return spark.createDataFrame(rows, "key string, start long, samples array<double>")


@pytest.fixture(scope="module")
def signals():
    n = 4 * O.rate
    played = {k: noise(s, n) for k, s in zip("abcd", range(4), strict=True)}
    taps = np.array([0.7, -0.3, 0.15])
    mic = {"a": room(played["a"], 333, taps), "b": room(played["b"], 60, taps) + noise(9, n) * 0.05, "c": noise(7, n), "d": np.zeros(n)}
    mic["a"][3 * O.rate :] = noise(8, O.rate)  # a singer alone at the end
    return played, mic, taps


def test_planted_delays_and_taps(spark, signals):
    played, mic, taps = signals
    p, m = blocks(spark, played, [700]), blocks(spark, mic, [700])
    got = {(r.key, r.update): r for r in bleed.room_paths(p, m, o=O).collect()}
    assert {k for k, _ in got} == {"a", "b"} and {u for k, u in got if k == "b"} == set(range(7))
    for key, delay in (("a", 333), ("b", 60)):
        r = got[key, 2]
        begin = delay - r.delay + O.taps // 4  # where the room's first tap is in the path
        assert abs(r.delay - delay) <= 1 and np.allclose(r.path[begin : begin + 3], taps, atol=0.08) and r.recent > 0.9 and r.end == 2 * O.rate


def test_frames(spark, signals):
    played, mic, _ = signals
    frames = bleed.bleed_frames(blocks(spark, played, [700]), blocks(spark, mic, [700]), o=O)
    rows = {(r.key, r.centre): r for r in frames.collect()}
    size, hop = O.frame, O.samples(O.hop_ms)
    assert sorted(c for k, c in rows if k == "c") == [e - size + size // 2 for e in range(size, 4 * O.rate + 1, hop)]
    for (key, centre), r in rows.items():
        end = centre - size // 2 + size
        assert r.known == (key in "ab" and end >= O.first)
        if key == "b" and r.known:
            assert r.bleed and r.explained > 0.8 and abs(r.gain_db + 4) < 4
        if key in "cd" or key == "a" and centre > 3 * O.rate + size:
            assert not r.bleed
        if key == "a" and O.first <= end < 3 * O.rate:
            assert r.bleed
        if key == "d":
            assert r.level_db == -120
    other = {(r.key, r.centre): r for r in bleed.bleed_frames(blocks(spark, played, [64, 1900, 3]), blocks(spark, mic, [5000]), o=O).collect()}
    assert other.keys() == rows.keys() and all(abs(other[x].explained - rows[x].explained) < 1e-9 and other[x].known == rows[x].known for x in rows)
    empty = blocks(spark, {}, [1])
    assert bleed.bleed_frames(empty, empty, o=O).count() == 0


def test_delay_against_a_plain_search():
    """The vote over all lags, written out."""
    played, mic = noise(1, 6000), room(noise(1, 6000), 100, np.array([1.0]))[2000:4000]
    at, vote = bleed.median_vote(mic, played[1500:4200], 700)
    votes = []
    for lag in range(700):
        each = []
        for s in range(8):
            m, p = mic[s * 250 : (s + 1) * 250], played[1500 + lag + s * 250 : 1500 + lag + (s + 1) * 250]
            each.append(m @ p / np.sqrt((m @ m) * (p @ p)))
        votes.append(abs(np.median(each)))
    assert at == int(np.argmax(votes)) == 400 and abs(vote - max(votes)) < 1e-9
