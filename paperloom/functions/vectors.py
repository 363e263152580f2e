"""Score-vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Softmax of each row's scores, shifted by the row maximum."""
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(powers, lambda p: p / total)


def argmax(scores: Column) -> Column:
    """Zero-based index of the largest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confidence(scores: Column) -> Column:
    """Largest score to four decimals."""
    return F.round(F.array_max(scores), 4)


def normalise_pixels(px: Column) -> Column:
    """Gray levels 0..255 to -1..1 with mean and deviation one half."""
    return F.transform(px, lambda v: (v / F.lit(255.0) - F.lit(0.5)) / F.lit(0.5))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """8-bit luma with the fixed 16-bit weights 19595, 38470, 7471 and rounding."""
    return F.shiftright(red * 19595 + green * 38470 + blue * 7471 + 32768, 16)
