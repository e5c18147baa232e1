"""Range control: the compression curves, gains that follow them, and the 8-bit words that carry gains."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Profile(NamedTuple):
    """A curve of five straight pieces over the level: boost up to a limit, a band left alone, an early cut, a cut."""

    null_low: float = -31.0
    null_high: float = -26.0
    boost_ratio: float = 2.0
    most_boost: float = 6.0
    early_ratio: float = 2.0
    early_end: float = -16.0
    cut_ratio: float = 20.0
    attack_ms: float = 10.0
    release_ms: float = 1000.0


#: The usual profiles by name.
PROFILES = {
    "film-standard": Profile(),
    "film-light": Profile(null_low=-41.0, null_high=-21.0, early_end=-11.0),
    "music-standard": Profile(most_boost=12.0),
    "music-light": Profile(null_low=-41.0, null_high=-21.0, most_boost=12.0, early_end=-11.0),
    "speech": Profile(boost_ratio=5.0, most_boost=15.0),
}
#: Level of dialogue that the curves are drawn against, and the gain that a decoder adds before the heavy word (dB).
DIALOGUE, ADDED = 31, 11.0


def corners(p: Profile) -> list[tuple[float, float]]:
    """The curve's corners (level, gain), in the order of levels; left of the first it is level, right of the last it
    falls by 1 / cut_ratio."""
    cut = -(p.early_end - p.null_high) / p.early_ratio
    return [(p.null_low - p.most_boost * p.boost_ratio, p.most_boost), (p.null_low, 0.0), (p.null_high, 0.0), (p.early_end, cut)]


def static_gain(p: Profile, level: Column) -> Column:
    """The curve's gain in dB for a level in dB that is referred to dialogue."""
    (a, top), (b, _), (c, _), (d, cut) = corners(p)
    found = F.when(level <= a, F.lit(top)).when(level < b, (b - level) / p.boost_ratio).when(level <= c, F.lit(0.0))
    return found.when(level <= d, (c - level) / p.early_ratio).otherwise(cut - (level - d) / p.cut_ratio)


def referred(level: Column, dialnorm: Column) -> Column:
    """The level as it is once dialogue is at its place."""
    return level + dialnorm - DIALOGUE


def heavy_target(peak: Column, dialnorm: Column, *, target: float = -20.0, ceiling: float = -0.5) -> Column:
    """The gain that brings dialogue to its target, or less if the peak would pass the ceiling. A dialnorm outside 1 to
    31 counts as 31."""
    known = F.when(dialnorm.between(1, DIALOGUE), dialnorm).otherwise(F.lit(DIALOGUE))
    fixed = known - DIALOGUE + ADDED
    return F.when(peak.isNotNull(), F.least(target + known - fixed, ceiling - peak - fixed))


def heavy_gain(df: DataFrame, keys: list[str], order: list[str], target: str, step: float, name: str = "gain_db") -> DataFrame:
    """A gain that falls to its target at once and rises by `step` a row at the most.

    That is the least of all targets so far, each raised by the steps since: a running minimum over `target` minus the
    steps up to its row, so it is a window and no loop. Null targets are left out; a key's first target is its first gain.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    place = F.row_number().over(w) * F.lit(step)
    low = F.min(F.col(target) - F.col("_place")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.where(F.col(target).isNotNull()).withColumn("_place", place).withColumn(name, low + F.col("_place")).drop("_place")


class Words(NamedTuple):
    """An 8-bit gain word: a signed power of two in the high bits, from `low` to `high`, and a fraction in the others."""

    bits: int
    low: int
    high: int


#: The word of the range control and that of the heavy compressor.
RANGE, HEAVY = Words(5, -4, 3), Words(4, -8, 7)


def encode(gain_db: Column, words: Words, *, at_most: bool = False) -> Column:
    """The word whose gain is nearest to the given one, halfway upwards, or the largest that is no greater.

    Gains beyond the words' range get the least or the greatest word; a null stays null.
    """
    scale = 1 << words.bits
    gain = F.pow(F.lit(10.0), gain_db / 20)
    rough = F.floor(F.log2(gain)).cast("int")
    two = F.lit(2.0)
    power = F.when(F.pow(two, rough + 1) <= gain, rough + 1).when(F.pow(two, rough) > gain, rough - 1).otherwise(rough)
    part = (gain / F.pow(two, power) - 1) * scale
    part = F.floor(part + 1e-9 if at_most else part + 0.5).cast("int")
    place = power * scale + part  # a fraction that is rounded to a whole is the next power's first
    held = F.greatest(F.lit(words.low * scale), F.least(F.lit((words.high + 1) * scale - 1), place))
    return F.when(gain_db.isNotNull(), F.pmod(held, F.lit(256)))


def gain_of(word: int, words: Words) -> float:
    """Linear gain of a word."""
    scale = 1 << words.bits
    place = word - 256 if word >= 128 else word
    return 2.0 ** (place // scale) * (1 + place % scale / scale)


def share(time_ms: float, block_ms: float) -> float:
    """What a block of a length takes of the way to its target, for a time constant; all of it for none."""
    return 1.0 if time_ms <= 0 else -math.expm1(-block_ms / time_ms)
