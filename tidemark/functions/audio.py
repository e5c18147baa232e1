"""Scalar rules of levels, pitch, gain words, geometry and time, as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def meter_fraction(db: Column, floor: float) -> Column:
    """(db - floor) / -floor within 0 and 1; 0 for a floor that isn't negative."""
    return F.lit(0.0) if floor >= 0 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (db - floor) / -floor))


def to_db(x: Column) -> Column:
    return F.when(x > 1e-10, 20 * F.log10(x)).otherwise(F.lit(-200.0))


def db_to_power(db: Column) -> Column:
    return F.pow(F.lit(2.0), db * (math.log2(10) / 10))


def power_to_db(power: Column) -> Column:
    return F.when(power > 0, F.greatest(F.lit(-120.0), F.log2(power) * (10 / math.log2(10)))).otherwise(F.lit(-120.0))


def midi_from_hz(hz: Column) -> Column:
    return F.when(hz > 0, 69 + 12 * F.log2(hz / 440))


def hz_from_midi(midi: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (midi - 69) / 12)


def cents_between(hz: Column, reference: Column) -> Column:
    return F.when((hz > 0) & (reference > 0), 1200 * F.log2(hz / reference))


def fold_octaves(cents: Column) -> Column:
    """Into (-600, 600]: the remainder keeps the sign of its argument."""
    rest = cents % 1200
    return F.when(rest > 600, rest - 1200).when(rest <= -600, rest + 1200).otherwise(rest)


def half_up(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def half_away(x: Column) -> Column:
    """Whole number nearest, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def dynrng_gain(word: Column) -> Column:
    """Linear gain of an 8-bit gain word: three signed bits of 6 dB steps, five bits of fraction."""
    high = F.shiftright(word, 5)
    return F.pow(F.lit(2.0), F.when(high >= 4, high - 8).otherwise(high)) * (32 + word.bitwiseAND(31)) / 32


def compr_gain(word: Column) -> Column:
    """Linear gain of the heavier word: four signed bits of 6 dB steps, four bits of fraction."""
    high = F.shiftright(word, 4)
    return F.pow(F.lit(2.0), F.when(high >= 8, high - 16).otherwise(high) + 1) * (16 + word.bitwiseAND(15)) / 32


def smoothstep(f: Column) -> Column:
    return f * f * (3 - 2 * f)


def orbit(turn: Column) -> tuple[Column, Column]:
    """Place on the unit room's circle after `turn` turns."""
    return 0.5 + 0.5 * F.sin(2 * math.pi * turn), 0.5 - 0.5 * F.cos(2 * math.pi * turn)


def polar_to_cartesian(azimuth: Column, elevation: Column, distance: Column) -> tuple[Column, Column, Column]:
    """Degrees, azimuth to the left, to x right, y front, z up."""
    a, e = F.radians(azimuth), F.radians(elevation)
    return -F.sin(a) * F.cos(e) * distance, F.cos(a) * F.cos(e) * distance, F.sin(e) * distance


def bark(hz: Column) -> Column:
    k = hz / 1000
    return 13 * F.atan(0.76 * k) + 3.5 * F.atan(k * k / 56.25)


def spreading_db(bark_distance: Column) -> Column:
    x = bark_distance + 0.474
    return 15.81 + 7.5 * x - 17.5 * F.sqrt(1 + x * x)


def threshold_in_quiet_db(hz: Column) -> Column:
    """Terhardt's curve; frequencies under 20 Hz count as 20."""
    k = F.greatest(F.lit(20.0), hz) / 1000
    return 3.64 * F.pow(k, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * (k - 3.3) * (k - 3.3)) + 0.001 * F.pow(k, F.lit(4.0))


def dialnorm(lkfs: Column) -> Column:
    return F.least(F.lit(31), F.greatest(F.lit(1), half_away(-lkfs))).cast("int")


def real_time_multiple(ms: Column, budget: Column) -> Column:
    """Budget over time; a missing or zero budget is 32, times that aren't positive have none."""
    return F.when(ms > 0, F.coalesce(F.nullif(budget, F.lit(0.0)), F.lit(32.0)) / ms)


def loudness_weight(azimuth: Column, elevation: Column, lfe: Column) -> Column:
    """1.41 for 60 to 120 degrees to a side under 30 degrees of height, else 1; none for the LFE."""
    side = F.abs(azimuth).between(60, 120) & (F.abs(elevation) < 30)
    return F.when(lfe, None).when(side, F.lit(1.41)).otherwise(F.lit(1.0))


def gate(value: Column, target: Column, tolerance: Column) -> Column:
    """A band where there is a tolerance, else a ceiling; a null value fails."""
    return F.coalesce(F.when(tolerance.isNotNull(), F.abs(value - target) <= tolerance).otherwise(value <= target), F.lit(False))


def json_safe_db(db: Column) -> Column:
    return F.least(F.lit(200.0), F.greatest(F.lit(-200.0), db))


def branch_slug(name: Column) -> Column:
    return F.translate(name, "/\\", "__")


def strict_number(text: Column) -> Column:
    """A double if the whole text is a plain decimal number, else null; no locale, no blanks, no names."""
    return F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def lrc_time(ms: Column) -> Column:
    """[mm:ss.cc], minutes without an hour's limit."""
    c = F.floor(ms / 10).cast("long")
    return F.format_string("[%02d:%02d.%02d]", F.floor(c / 6000), F.floor(c / 100) % 60, c % 100)


def parse_lrc_time(text: Column) -> Column:
    """Milliseconds of [mm:ss], [mm:ss.c], [mm:ss.cc] or [mm:ss.mmm]; null for other texts."""
    pattern = r"^\[(\d+):([0-5]?\d)(?:[.:](\d{1,3}))?\]"
    fraction = F.rpad(F.regexp_extract(text, pattern, 3), 3, "0").cast("int")
    whole = F.regexp_extract(text, pattern, 1).cast("long") * 60_000 + F.regexp_extract(text, pattern, 2).cast("long") * 1000
    return F.when(text.rlike(pattern), whole + fraction)


def rotate(point: tuple[Column, Column, Column], yaw: float, pitch: float, roll: float) -> tuple[Column, Column, Column]:
    """A point of the room (x and y from 0 to 1, z about 0) turned by degrees about the middle, first by yaw (front to
    right), then by pitch (front up), then by roll (right up); kept inside the room. No angles leave it untouched."""
    if not (yaw or pitch or roll):
        return point
    (cy, sy), (cp, sp), (cr, sr) = ((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (yaw, pitch, roll))
    turn = np.array([[cr, 0, -sr], [0, 1, 0], [sr, 0, cr]]) @ np.array([[1, 0, 0], [0, cp, sp], [0, -sp, cp]]) @ np.array([[cy, -sy, 0], [sy, cy, 0], [0, 0, 1]])
    flat = (2 * point[0] - 1, 2 * point[1] - 1, point[2])
    x, y, z = (sum((c * float(w) for w, c in zip(row, flat, strict=True)), F.lit(0.0)) for row in turn)
    within = lambda v, low: F.least(F.lit(1.0), F.greatest(F.lit(low), v))
    return within((x + 1) / 2, 0.0), within((y + 1) / 2, 0.0), within(z, -1.0)


def thousands(x: Column) -> Column:
    """One decimal, commas between thousands."""
    return F.format_number(x.cast("double"), 1)


def merge_subject(subject: Column) -> tuple[Column, Column]:
    """The number and branch of a merge commit's subject; null and an empty text for other subjects."""
    pattern = r"^Merge pull request #(\d+) from (\S+)"
    number = F.regexp_extract(subject, pattern, 1)
    return F.when(number != "", number.cast("long")), F.coalesce(F.regexp_extract(subject, pattern, 2), F.lit(""))


def base64url(data: Column) -> Column:
    """Base64 in the alphabet for addresses, without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/=", "-_ "))


def sample_time(unit: Column, per_unit: int, rate: int) -> Column:
    """Seconds at which an access unit starts."""
    return unit * per_unit / float(rate)


def json_number(text: Column, field: str) -> Column:
    """A field of a JSON text if it is a number there: not true or false, not a number in quotes."""
    value = F.try_variant_get(F.try_parse_json(text), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(value, "$", "double"))


def parse_enum(text: Column, values: dict[str, int]) -> Column:
    """The number of a name, blanks and line ends around it ignored; null for other names."""
    word = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    out = F.lit(None).cast("int")
    for name, number in values.items():
        out = F.when(word == name, F.lit(number)).otherwise(out)
    return out


def send_ahead(us: Column) -> Column:
    """Microseconds as an unsigned 32-bit number; none (0 or less) and too many (its largest or more) say nothing: null."""
    return F.when((us > 0) & (us < 0xFFFFFFFF), us.cast("long"))


def draw(seed: int, case: Column, name: str, among: list) -> Column:
    """One of the values for a case, by the seed, the case's number and the name of what is drawn: a case drawn alone is
    the same as among others."""
    return F.element_at(F.array(*map(F.lit, among)), (F.pmod(F.xxhash64(F.lit(seed), case, F.lit(name)), F.lit(len(among))) + 1).cast("int"))


#: The bits of a bed's mask that stand for pairs of channels.
BED_PAIRS = 0b1001111110


def bed_channels(mask: Column) -> Column:
    """Channels of a bed by its ten-bit mask: pairs count twice."""
    ten = mask.bitwiseAND(0x3FF)
    return F.bit_count(ten) + F.bit_count(ten.bitwiseAND(BED_PAIRS))
