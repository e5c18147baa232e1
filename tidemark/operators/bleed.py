"""How much of a microphone is what a room makes of the signal that is played in it.

Both signals are tables of blocks. Each update of the estimate has the blocks of its own window, so a long recording is
many small groups and no loop; what an update leaves open is taken from the one before by a window over updates.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a coarse one; parts of a window that vote on the delay; a weaker vote finds none.
COARSE, PARTS, WEAKEST = 4, 8, 0.12


class Bleed(NamedTuple):
    """Rates in samples a second, lengths in milliseconds; the ridge is a share of the played power."""

    rate: int = 16_000
    max_delay_ms: int = 400
    lead_ms: int = 20
    frame_ms: int = 64
    hop_ms: int = 10
    window_ms: int = 2000
    update_ms: int = 500
    taps: int = 16
    ridge: float = 0.01
    explained: float = 0.65
    floor_db: float = -60.0

    def samples(self, ms: int) -> int:
        return self.rate * ms // 1000

    @property
    def frame(self) -> int:
        return max(16, self.samples(self.frame_ms))

    @property
    def window(self) -> int:
        return max(16 * 4 * COARSE, self.samples(self.window_ms))

    @property
    def first(self) -> int:
        """Microphone samples before the first update."""
        return min(self.rate, self.window)


def median_vote(mic: np.ndarray, played: np.ndarray, lags: int, parts: int = PARTS) -> tuple[int, float]:
    """The place in `played` whose stretch as long as `mic` correlates with it best, and how well: the median over parts
    of their normalised correlations, so that what keeps its sign wins over what matches one note."""
    size = len(mic) // parts
    energy = np.concatenate([[0.0], np.cumsum(played * played)])
    votes = np.full((parts, lags), np.nan)
    for s in range(parts):
        part = mic[s * size : (s + 1) * size]
        span = played[s * size : s * size + size + lags - 1]
        n = 1 << (len(span) + size).bit_length()
        dot = np.fft.irfft(np.fft.rfft(span, n) * np.conj(np.fft.rfft(part, n)), n)[:lags]
        under = energy[s * size + size : s * size + size + lags] - energy[s * size : s * size + lags]
        own = float(part @ part)
        if own > 1e-12:
            votes[s] = np.where(under > 1e-12, dot / np.sqrt(own * np.maximum(under, 1e-12)), np.nan)
    known = (~np.isnan(votes)).sum(0) >= 3
    if not known.any():
        return 0, 0.0
    found = np.where(known, np.abs(np.nanmedian(np.where(known, votes, 0.0), 0)), 0.0)
    at = int(found.argmax())
    return at, float(found[at])


def means(x: np.ndarray) -> np.ndarray:
    n = len(x) // COARSE
    return x[: n * COARSE].reshape(n, COARSE).mean(1)


class Span:
    """Samples of a group by their place in the recording; zero where there are none."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = [(int(s), np.asarray(x, float)) for s, x in zip(rows["start"], rows["samples"], strict=True)]
        self.end = max((s + len(x) for s, x in self.rows), default=0)

    def get(self, a: int, b: int) -> np.ndarray:
        out = np.zeros(max(0, b - a))
        for s, x in self.rows:
            low, high = max(a, s), min(b, s + len(x))
            if low < high:
                out[low - a : high - a] = x[low - s : high - s]
        return out


def find_delay(o: Bleed, mic: Span, played: Span, end: int) -> int | None:
    """How far the microphone is behind, over the window that ends at `end`; first coarsely, then to the sample."""
    start = max(0, end - o.window)
    width = end - start
    most, lead = o.samples(o.max_delay_ms), o.samples(o.lead_ms)
    heard = mic.get(start, end)
    if width < o.rate // 2 or not (heard != 0).any():
        return None
    low = -(-lead // COARSE)  # places before and behind, in coarse samples
    high = most // COARSE
    span = played.get(start - high * COARSE, end + low * COARSE)
    at, vote = median_vote(means(heard), means(span), high + low + 1)
    if vote < WEAKEST:
        return None
    centre, reach = (high - at) * COARSE, 2 * COARSE
    at, vote = median_vote(heard, played.get(start - centre - reach, end - centre + reach), 2 * reach + 1)
    return centre + reach - at if vote >= WEAKEST else None


def lagged(o: Bleed, played: Span, delay: int, a: int, b: int) -> np.ndarray:
    """What each tap sees of the played signal at the microphone's samples from a to b: a row a sample."""
    begin = delay - o.taps // 4
    x = played.get(a - begin - o.taps + 1, b - begin)
    return np.lib.stride_tricks.sliding_window_view(x, o.taps)[:, ::-1]


def fit_path(o: Bleed, mic: Span, played: Span, delay: int, end: int) -> tuple[list | None, float]:
    """The room as taps around the delay by ridge regression, and the share of the window's energy that they explain."""
    start = max(0, end - o.window)
    x, m = lagged(o, played, delay, start, end), mic.get(start, end)
    power = float(x[:, 0] @ x[:, 0])
    if power <= 1e-9:
        return None, 0.0
    path = np.linalg.solve(x.T @ x + (o.ridge * power + 1e-12) * np.eye(o.taps), x.T @ m)
    rest = m - x @ path
    return path.tolist(), float(min(1.0, max(0.0, 1 - rest @ rest / (m @ m))))


def _dealt(o: Bleed, played: DataFrame, mic: DataFrame, key: str, before: int, behind: int, least: int) -> DataFrame:
    """The blocks of both signals, each at every update whose stretch, from `before` to `behind` its end, it reaches into."""
    step = o.samples(o.update_ms)
    both = played.withColumn("kind", F.lit("p")).unionByName(mic.withColumn("kind", F.lit("m")))
    low = F.floor((F.col("start") - behind - o.first) / step) + 1
    high = F.ceil((F.col("start") + F.size("samples") + before - o.first) / step) - 1
    reached = F.filter(F.sequence(F.least(low, high), high), lambda u: (u >= low) & (u >= least))
    return both.where(F.size("samples") > 0).select(F.col(key).alias("key"), "kind", "start", "samples", F.explode(reached).alias("update"))


def room_paths(played: DataFrame, mic: DataFrame, key: str = "key", o: Bleed = Bleed()) -> DataFrame:
    """(key, update, end, delay, path, recent) for every update that finds a delay: the microphone's delay in samples, the
    room's taps and how much of the window they explain. `played` and `mic` have key, start and samples, in blocks of any
    size, each from sample 0; the microphone's sample k is heard at played sample k."""
    margin = o.window + o.samples(o.max_delay_ms) + 2 * o.taps + 4 * COARSE
    step = o.samples(o.update_ms)

    def run(keys, rows):
        k, update = keys
        end = o.first + int(update) * step
        heard, sent = Span(rows[rows.kind == "m"]), Span(rows[rows.kind == "p"])
        delay = find_delay(o, heard, sent, end) if heard.end >= end else None
        out = [] if delay is None else [(k, update, end, delay, *fit_path(o, heard, sent, delay, end))]
        return pd.DataFrame(out, columns=["key", "update", "end", "delay", "path", "recent"])

    kind = played.schema[key].dataType.simpleString()
    dealt = _dealt(o, played, mic, key, margin, o.samples(o.lead_ms) + 2 * o.taps + 4 * COARSE, 0)
    return dealt.groupBy("key", "update").applyInPandas(run, f"key {kind}, update long, end long, delay long, path array<double>, recent double")


def bleed_frames(played: DataFrame, mic: DataFrame, key: str = "key", o: Bleed = Bleed()) -> DataFrame:
    """(key, centre, explained, level_db, gain_db, known, bleed) of every whole frame of the microphone.

    A frame is read with the delay and path of the last update at or before its end that found any; before that `known`
    is false. `explained` is the share of its energy that the path predicts, `gain_db` the predicted level against the
    played one; more than the allowed share of a frame that is not silent is bleed.
    """
    step, hop = o.samples(o.update_ms), max(1, o.samples(o.hop_ms))
    least = -(-(o.frame - o.first) // step) - 1
    most, lead = o.samples(o.max_delay_ms), o.samples(o.lead_ms)
    dealt = _dealt(o, played, mic, key, o.frame + most + 2 * o.taps + 2 * COARSE, step + lead + 2 * o.taps + 2 * COARSE, least)
    paths = room_paths(played, mic, key, o).select("key", "update", F.struct("delay", "path").alias("fit"))
    places = dealt.select("key", "update").distinct().join(paths.withColumnRenamed("key", "_k").withColumnRenamed("update", "_u"), F.col("key").eqNullSafe(F.col("_k")) & (F.col("update") == F.col("_u")), "left")
    latest = F.last("fit", ignorenulls=True).over(Window.partitionBy("key").orderBy("update").rowsBetween(Window.unboundedPreceding, 0))
    fits = places.select(F.col("key").alias("k"), F.col("update").alias("u"), latest.alias("fit")).select("k", "u", "fit.delay", "fit.path")

    def run(keys, rows, fits):
        k, update = keys
        begin = o.first + int(update) * step
        heard, sent = Span(rows[rows.kind == "m"]), Span(rows[rows.kind == "p"])
        delay = None if not len(fits) or pd.isna(fits.delay.iloc[0]) else int(fits.delay.iloc[0])
        path = None if delay is None or fits.path.iloc[0] is None else np.asarray(fits.path.iloc[0], float)
        from_ = max(o.frame, begin)
        from_ += -(from_ - o.frame) % hop
        out = []
        for end in range(from_, min(heard.end, begin + step - 1) + 1, hop):
            a = end - o.frame
            m = heard.get(a, end)
            energy, explained, gain = float(m @ m), 0.0, -120.0
            level = max(-120.0, 20 * math.log10(math.sqrt(energy / o.frame) + 1e-12))
            if path is not None and energy > 0:
                guess, p = lagged(o, sent, delay, a, end) @ path, sent.get(a - delay, end - delay)
                rest = m - guess
                explained = float(min(1.0, max(0.0, 1 - rest @ rest / energy)))
                if guess @ guess > 0 and p @ p > 0:
                    gain = max(-120.0, 10 * math.log10((guess @ guess) / (p @ p)))
            out.append((k, a + o.frame // 2, explained, level, gain, delay is not None, explained > o.explained and level > o.floor_db))
        return pd.DataFrame(out, columns=["key", "centre", "explained", "level_db", "gain_db", "known", "bleed"])

    kind = played.schema[key].dataType.simpleString()
    schema = f"key {kind}, centre long, explained double, level_db double, gain_db double, known boolean, bleed boolean"
    return dealt.groupBy("key", "update").cogroup(fits.groupBy("k", "u")).applyInPandas(run, schema)
