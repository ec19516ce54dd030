"""Colour arithmetic on flat (3, H, W) array columns in [0, 1], as expressions that Catalyst compiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The luma weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)


def plane(data: Column, k: int, pixels: int) -> Column:
    return F.slice(data, pixels * k + 1, pixels)


def gray(data: Column, pixels: int) -> Column:
    """One luma value a pixel."""
    red_green = F.zip_with(plane(data, 0, pixels), plane(data, 1, pixels), lambda r, g: r * LUMA[0] + g * LUMA[1])
    return F.zip_with(red_green, plane(data, 2, pixels), lambda s, b: s + b * LUMA[2])


def blend(a: Column, b: Column, ratio: float) -> Column:
    """ratio of a and the rest of b, clipped to [0, 1]."""
    return F.zip_with(a, b, lambda x, y: F.least(F.greatest(x * ratio + y * (1 - ratio), F.lit(0.0)), F.lit(1.0)))


def brightness(data: Column, pixels: int, factor: float) -> Column:
    return blend(data, F.array_repeat(F.lit(0.0), 3 * pixels), factor)


def contrast(data: Column, pixels: int, factor: float) -> Column:
    mean = F.aggregate(gray(data, pixels), F.lit(0.0), lambda a, v: a + v) / pixels
    return blend(data, F.array_repeat(mean, 3 * pixels), factor)


def saturation(data: Column, pixels: int, factor: float) -> Column:
    g = gray(data, pixels)
    return blend(data, F.concat(g, g, g), factor)
