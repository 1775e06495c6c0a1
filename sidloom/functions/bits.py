"""Columns over signed action bitmaps: tiers, levels, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the action bitmap.
VIEW_EXIT = 4096
STRONG = [2, 4, 8, 256, 512, 1024, 2048, 131072, 262144, 524288, 1048576]
WEAK = [1, 16, 64, 128, 8192, 16384, 32768, 65536]
TRADE = [131072, 262144]
QUALITY = {
    262144: 4000.0, 131072: 1.0, 524288: 5.0, 8: 4000.0, 256: 4000.0, 2: 1.0, 512: 1.0, 1048576: 2000.0,
    2048: 2000.0, 4: 3.0, 1024: 3.0, 16: 0.1, 8192: 0.1, 65536: 0.1, 32: 0.1, 1: 0.1,
}


def has_any(bitmap: Column, bits: list[int]) -> Column:
    return bitmap.bitwiseAND(F.lit(sum(bits))) != 0


def masked(bitmap: Column) -> Column:
    """The bitmap without the view-exit bit."""
    return bitmap.bitwiseAND(F.lit(~VIEW_EXIT))


def tier(bitmap: Column) -> Column:
    """negative before strong before weak; anything else is neutral."""
    return F.when(bitmap < 0, "negative").when(has_any(bitmap, STRONG), "strong").when(has_any(bitmap, WEAK), "weak").otherwise("neutral")


def level(bitmap: Column) -> Column:
    """1 weak, 2 strong, 3 trade; the view-exit bit doesn't count."""
    b = masked(bitmap)
    return F.when(has_any(b, TRADE), 3).when(has_any(b, STRONG), 2).otherwise(1)


def quality(bitmap: Column) -> Column:
    """log10(1 + the weights of the bits that are set); -1 for negative feedback."""
    total = F.lit(0.0)
    for bit, weight in QUALITY.items():
        total = total + F.when(bitmap.bitwiseAND(F.lit(bit)) != 0, weight).otherwise(0.0)
    return F.when(bitmap < 0, -1.0).otherwise(F.log10(1.0 + total))
