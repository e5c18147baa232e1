"""Array rules: native where Spark has the parts, numpy in Arrow batches for transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType


def dot(a: Column, b: Column) -> Column:
    """Inner product; arrays of different lengths are an error."""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("arrays differ in length")).cast("array<double>")).otherwise(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.aggregate(checked, F.lit(0.0), lambda s, x: s + x)


def align(a: Column, b: Column, lag: Column) -> tuple[Column, Column]:
    """Both arrays where they overlap when b is `lag` samples later (earlier, if negative) than a."""
    n = F.greatest(F.lit(0), F.least(F.size(a) - F.greatest(F.lit(0), -lag), F.size(b) - F.greatest(F.lit(0), lag)))
    return F.slice(a, F.greatest(F.lit(0), -lag) + 1, n), F.slice(b, F.greatest(F.lit(0), lag) + 1, n)


def drop_leading(values: Column, most: Column) -> Column:
    """The array without its leading run of `most`."""
    first = F.array_position(F.transform(values, lambda x: x != most), True)
    return F.when(first == 0, F.slice(values, 1, 0)).otherwise(F.slice(values, F.greatest(first, F.lit(1)).cast("int"), F.size(values)))


def reorder(channels: Column, order: list[int]) -> Column:
    return F.array(*(F.get(channels, k) for k in order))


def channel_label(count: Column, index: Column) -> Column:
    """Names of 1, 2 and 6 channels, else ch and the number."""
    named = F.when(count == 1, F.array(F.lit("M"))).when(count == 2, F.array(F.lit("L"), F.lit("R"))).when(count == 6, F.array(*map(F.lit, ("L", "C", "R", "Ls", "Rs", "LFE"))))
    return F.coalesce(F.get(named, index), F.concat(F.lit("ch"), index.cast("string")))


def within_thresholds(values: Column, thresholds: Column) -> Column:
    """Whether each value reaches its threshold; a different number of thresholds is an error, never padded."""
    checked = F.when(F.size(values) != F.size(thresholds), F.raise_error(F.lit("thresholds and channels differ in number")).cast("array<boolean>"))
    return checked.otherwise(F.zip_with(values, thresholds, lambda v, t: v >= t))


@F.pandas_udf(ArrayType(DoubleType()))
def spectrum_power(samples: pd.Series) -> pd.Series:
    """Power of each bin of the real transform under a Hann window; null for null or empty arrays."""

    def one(x):
        if x is None or len(x) == 0:
            return None
        w = np.hanning(len(x)) if len(x) > 2 else np.ones(len(x))
        return np.abs(np.fft.rfft(np.asarray(x, float) * w)) ** 2

    return samples.map(one)


def resample(up: int, down: int, taps: int = 24):
    """A column function: rational resampling by a windowed sinc, silence outside, round(n up / down) samples out."""

    def one(x):
        if x is None:
            return None
        x = np.asarray(x, float)
        n = int(np.floor(len(x) * up / down + 0.5))
        at = np.arange(n) * down / up
        k = np.floor(at).astype(int)[:, None] + np.arange(-taps, taps + 1)
        cut = min(1.0, up / down)
        d = at[:, None] - k
        weights = cut * np.sinc(cut * d) * np.where(np.abs(d) <= taps, 0.5 + 0.5 * np.cos(np.pi * d / (taps + 1)), 0)
        inside = (k >= 0) & (k < len(x))
        return (np.where(inside, x[np.clip(k, 0, max(0, len(x) - 1))] if len(x) else 0.0, 0.0) * weights).sum(1)

    return F.pandas_udf(lambda s: s.map(one), ArrayType(DoubleType()))


def true_peak(samples: Column) -> Column:
    """Largest magnitude after fourfold resampling."""
    return F.aggregate(resample(4, 1)(samples), F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))


def biquad(b0: float, b1: float, b2: float, a1: float, a2: float):
    """A column function: a second-order recursive filter (direct form II transposed) over each array."""

    def filter_(samples: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"), F.array().cast("array<double>").alias("out"))

        def step(s, x):
            y = b0 * x + s["s1"]
            return F.struct((b1 * x - a1 * y + s["s2"]).alias("s1"), (b2 * x - a2 * y).alias("s2"), F.concat(s["out"], F.array(y)).alias("out"))

        return F.aggregate(F.transform(samples, lambda x: x.cast("double")), start, step, lambda s: s["out"])

    return filter_


def bin_bands(bin: Column, width: Column, first: int = -17, last: int = 13) -> Column:
    """(band, share) of the third-octave bands around 1 kHz that a bin of a transform, `width` Hz wide, reaches into: how
    much of the bin is in each. An array for explode, so spectra of any lengths meet their bands without a join."""
    low, high = (bin - 0.5) * width, (bin + 0.5) * width
    place = lambda hz: 3 * F.log2(hz / 1000)  # noqa: E731  the middle of band b is at b
    begin = F.when(low > 0, F.ceil(place(low) - 0.5)).otherwise(F.lit(first))
    bands = F.sequence(F.greatest(F.lit(first), begin.cast("int") - 1), F.least(F.lit(last), F.floor(place(high) + 0.5).cast("int")) + 1)

    def share(b):
        inside = F.least(high, 1000 * F.pow(F.lit(2.0), (b + 0.5) / 3)) - F.greatest(low, 1000 * F.pow(F.lit(2.0), (b - 0.5) / 3))
        return F.struct(b.alias("band"), F.least(F.lit(1.0), inside / width).alias("share"))

    return F.filter(F.transform(F.filter(bands, lambda b: b.between(first, last)), share), lambda x: x["share"] > 0)


def band_shares(size: int, rate: float, first: int = -17, last: int = 13) -> list[tuple[int, int, float]]:
    """(band, bin, share) of a transform of one size as a table: the overlaps of all bins' and all bands' edges."""
    width = rate / size
    edges = (np.arange(size // 2 + 2) - 0.5) * width
    bands = 1000 * 2.0 ** ((np.arange(first, last + 2) - 0.5) / 3)
    share = (np.minimum(edges[None, 1:], bands[1:, None]) - np.maximum(edges[None, :-1], bands[:-1, None])) / width
    return [(first + int(b), int(k), float(share[b, k])) for b, k in zip(*np.nonzero(share > 0), strict=True)]


@F.pandas_udf(LongType())
def crc16(data: pd.Series) -> pd.Series:
    """CRC-16 (polynomial 0x8005, from 0, most significant bit first) of binary values, all of a batch together."""
    sizes = data.map(lambda x: 0 if x is None else len(x)).to_numpy()
    table = np.arange(256, dtype=np.int64) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    crc = np.zeros(len(data), np.int64)
    order = np.argsort(-sizes, kind="stable")
    raw = [np.frombuffer(data.iloc[k] or b"", np.uint8) for k in order]
    for place in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes[order], -place, "left"))
        byte = np.fromiter((r[place] for r in raw[:live]), np.int64, live)
        at = order[:live]
        crc[at] = (crc[at] << 8 & 0xFF00) ^ table[(crc[at] >> 8) ^ byte]
    return pd.Series(crc).where(data.notna().to_numpy())


def frames_of(samples: Column, size: int, hop: int) -> Column:
    """(frame, samples) of the overlapping frames that an array of samples has whole, as an array for explode."""
    last = F.floor((F.size(samples) - size) / hop).cast("int")
    each = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("frame"), F.slice(samples, k * hop + 1, size).alias("samples")))
    return F.when(F.size(samples) >= size, each)


def low_pass(factor: int) -> np.ndarray:
    """Taps of the low-pass before taking every `factor`-th sample: a Blackman-windowed sinc of 16 taps a step and one,
    cut off at a quarter of the rate after it, of gain 1 for a constant."""
    if factor <= 1:
        return np.ones(1)
    n = 16 * factor + 1
    taps = np.sinc((np.arange(n) - 8 * factor) / (2 * factor)) * np.blackman(n)
    return taps / taps.sum()


def decimate(factor: int):
    """A column function: each `factor`-th sample of the low-passed array, silence before its start."""
    taps = low_pass(factor)

    def one(x):
        return None if x is None else np.convolve(np.asarray(x, float), taps)[: len(x) : factor]

    return F.pandas_udf(lambda s: s.map(one), ArrayType(DoubleType()))


def pitch_frames(df: DataFrame, samples: str, rate: int, *, frame_ms: float = 64.0, hop_ms: float = 10.0) -> DataFrame:
    """The rows with (frame, centre, frame_samples) for each frame that their signal of `rate` samples a second has at its
    analysis rate, the largest whole part of the rate up to 16 kHz. `centre` is the input sample that a frame's middle
    stems from, the filter's delay taken off; signals shorter than a frame keep a row without one."""
    factor = next(f for f in range(1, rate + 1) if rate % f == 0 and rate / f <= 16_000)
    size, hop = (max(1, int(rate / factor * ms / 1000 + 0.5)) for ms in (frame_ms, hop_ms))
    delay = (len(low_pass(factor)) - 1) // 2
    kept = df.withColumn("_kept", decimate(factor)(F.col(samples)) if factor > 1 else F.col(samples))
    found = kept.select(*df.columns, F.inline_outer(frames_of(F.col("_kept"), size, hop)).alias("frame", "frame_samples"))
    return found.withColumn("centre", ((F.col("frame") * hop + size // 2) * factor - delay).cast("long"))


def pitch(rate: float, *, lowest: float = 70.0, highest: float = 1100.0, clearest: float = 0.6, floor_db: float = -55.0, ratio: float = 0.9):
    """A column function over frames: {hz, clarity, level_db} by the normalised square difference; hz is 0 where the
    frame, without its mean, is too quiet, no maximum is clear enough, or the pitch is out of range.

    Every lag is compared over as many samples: those that the longest lag leaves of the frame. Of the highest points of
    the stretches above zero, but for that around lag 0, the first within `ratio` of the highest counts; a parabola
    through its neighbours places it between samples. Frames are shorter than twice the longest lag: an error.
    """
    least, most = max(2, int(rate // highest)), int(np.ceil(rate / lowest)) + 1

    def one(x):
        if x is None:
            return None
        x = np.asarray(x, float)
        n = len(x)
        if n < 2 * most:
            raise ValueError(f"a frame of {n} samples is too short for lags up to {most}")
        x = x - x.mean()
        level = max(-120.0, 20 * np.log10(np.sqrt(np.mean(x * x)) + 1e-9))
        if level < floor_db:
            return 0.0, 0.0, level
        width, square = n - most, np.concatenate([[0.0], np.cumsum(x * x)])
        same = np.fft.irfft(np.conj(np.fft.rfft(x[:width], 2 * n)) * np.fft.rfft(x, 2 * n), 2 * n)[: most + 1]
        lags = np.arange(most + 1)
        power = square[width] + square[lags + width] - square[lags]
        d = np.where(power > 1e-12, 2 * same / np.maximum(power, 1e-12), 0.0)
        d[0] = 1.0
        lobe = np.cumsum((d[1:] > 0) & (d[:-1] <= 0))  # of lags from 1; 0 is the stretch around lag 0
        tops = []
        for k in range(1, int(lobe[-1]) + 1):
            inside = 1 + np.flatnonzero((lobe == k) & (d[1:] > 0))
            top = int(inside[np.argmax(d[inside])])
            if least <= top < most:
                tops.append(top)
        top = max((d[k] for k in tops), default=0.0)
        if not tops or top < clearest:
            return 0.0, float(min(1.0, max(0.0, top))), level
        k = next(k for k in tops if d[k] >= ratio * top)
        a, b, c = d[k - 1], d[k], d[k + 1]
        bend = a - 2 * b + c
        shift = min(0.5, max(-0.5, 0.5 * (a - c) / bend)) if bend else 0.0
        clear, hz = b - 0.25 * (a - c) * shift, rate / (k + shift)
        if clear < clearest or not lowest <= hz <= highest:
            return 0.0, 0.0, level
        return hz, min(1.0, clear), level

    return F.pandas_udf(lambda s: pd.DataFrame([one(x) or (None, None, None) for x in s], columns=["hz", "clarity", "level_db"], dtype=float), "hz double, clarity double, level_db double")
