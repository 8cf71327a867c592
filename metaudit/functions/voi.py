"""Column functions from stored pixel words to grey levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stored_value(word: Column, bits_stored: Column, high_bit: Column, signed: Column) -> Column:
    """The sample within a stored word: shifted down, masked, and sign-extended if ``signed``."""
    one = F.lit(1).cast("bigint")
    power = lambda k: F.call_function("shiftleft", one, k.cast("int"))
    raw = F.call_function("shiftright", word.cast("bigint"), (high_bit + 1 - bits_stored).cast("int")).bitwiseAND(power(bits_stored) - 1)
    negative = signed & (raw.bitwiseAND(power(bits_stored - 1)) != 0)
    return F.when(negative, raw - power(bits_stored)).otherwise(raw)


def rescale(stored: Column, slope: Column, intercept: Column) -> Column:
    return stored * slope + intercept


def grey_level(x: Column, center: Column, width: Column, invert: Column) -> Column:
    """The linear window function onto 0..255, halves rounded up; inverted afterwards for MONOCHROME1."""
    low, high = center - 0.5 - (width - 1) / 2, center - 0.5 + (width - 1) / 2
    inside = F.floor((F.try_divide(x - (center - 0.5), width - 1) + 0.5) * 255 + 0.5)
    y = F.when(x <= low, F.lit(0)).when(x > high, F.lit(255)).otherwise(inside).cast("int")
    return F.when(invert, 255 - y).otherwise(y)


def window_of(low: Column, high: Column) -> tuple[Column, Column]:
    """(center, width) that shows all values from ``low`` to ``high``; a flat image gets width 1."""
    return (low + high) / 2, F.when(high == low, F.lit(1.0)).otherwise(high - low)
