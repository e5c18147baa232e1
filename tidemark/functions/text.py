"""Which way a text runs, and whether a font's ranges cover it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Ranges = list[tuple[int, int]]

#: Letters of right-to-left scripts; what is neither way from 0xC0 on (signs, punctuation, selectors).
RIGHT_TO_LEFT: Ranges = [(0x590, 0x8FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF), (0x10800, 0x10FFF), (0x1E800, 0x1EFFF)]
NEUTRAL: Ranges = [(0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x2BFF), (0x3000, 0x303F), (0xFE00, 0xFE0F), (0xFFFD, 0xFFFD)]
#: The letters below 0xC0, which run left to right.
LATIN: Ranges = [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA)]


def between(ranges: Ranges, first: int, last: int) -> Ranges:
    """What the ranges leave of first to last."""
    out, at = [], first
    for a, b in sorted(ranges):
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    return [*out, (at, last)] if at <= last else out


LEFT_TO_RIGHT: Ranges = LATIN + between(RIGHT_TO_LEFT + NEUTRAL, 0xC0, 0x10FFFF)


def character_class(ranges: Ranges, *, out: bool = False) -> str:
    """A regular expression for one character in the ranges, or outside them."""
    return f"[{'^' if out else ''}{''.join(rf'\x{{{a:X}}}-\x{{{b:X}}}' for a, b in ranges)}]"


def is_right_to_left(text: Column) -> Column:
    """Whether the first letter that has a direction runs right to left; false if none has. A null stays null."""
    return F.regexp_extract(text, character_class(RIGHT_TO_LEFT + LEFT_TO_RIGHT), 0).rlike(character_class(RIGHT_TO_LEFT))


def is_covered(text: Column, ranges: Ranges) -> Column:
    """Whether the ranges (first, last) hold every character of a text that is no control; an empty text is covered."""
    return ~text.rlike(character_class([(0, 0x1F), (0x7F, 0x7F), *ranges], out=True))


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), text.substr(F.lit(len(prefix) + 1), F.char_length(text))).otherwise(text)


def without_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.left(text, F.char_length(text) - len(suffix))).otherwise(text)
