"""Crop boxes, cover scaling, file names, sizes: integer and string arithmetic, for columns and for single values."""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_box(image: tuple[int, int], target: int | tuple[int, int], *, randomized: bool = False, origin: tuple[int, int] | None = None, draw: Callable[[int, int], int] = random.randint) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of a crop: at origin, else random, else in the middle. Only an origin is checked.

    draw(a, b) gives a random number from a to b, both inclusive.
    """
    w, h = (target, target) if isinstance(target, int) else target
    if origin is not None:
        x, y = origin
        if x < 0 or y < 0 or x + w > image[0] or y + h > image[1]:
            raise ValueError(f"a crop of {(w, h)} at {origin} leaves the image of {image}")
    elif randomized:
        x, y = draw(0, image[0] - w), draw(0, image[1] - h)
    else:
        x, y = (image[0] - w) // 2, (image[1] - h) // 2
    return x, y, x + w, y + h


def center_box(w: Column, h: Column, tw: int, th: int) -> Column:
    x, y = F.floor((w - tw) / 2).cast("int"), F.floor((h - th) / 2).cast("int")
    return F.struct(x.alias("l"), y.alias("t"), (x + tw).alias("r"), (y + th).alias("b"))


def origin_box(w: Column, h: Column, tw: int, th: int, x: Column, y: Column) -> tuple[Column, Column]:
    """The box of a crop at an origin, and whether it lies inside the image."""
    box = F.struct(*[v.cast("int").alias(c) for c, v in zip("ltrb", (x, y, x + tw, y + th), strict=True)])
    return box, (x >= 0) & (y >= 0) & (x + tw <= w) & (y + th <= h)


def cover_size(image: tuple[int, int], target: int | tuple[int, int]) -> tuple[int, int]:
    """The smallest scaling that covers the target; both sides are cut off to whole numbers."""
    tw, th = (target, target) if isinstance(target, int) else target
    f = max(tw / image[0], th / image[1])
    return int(image[0] * f), int(image[1] * f)


def cover_columns(w: Column, h: Column, tw: int, th: int) -> tuple[Column, Column]:
    f = F.greatest(tw / w, th / h)
    return F.floor(w * f).cast("int"), F.floor(h * f).cast("int")


def slug(name: Column, split: Column) -> Column:
    """A file name: accents dropped, blanks to underscores, slashes removed, the split appended."""

    @F.pandas_udf("string")
    def to_ascii(names):
        return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())

    plain = F.translate(F.regexp_replace(to_ascii(name), " ", "_"), "/\\", "")
    return F.concat(plain, F.coalesce(F.concat(F.lit("__"), split), F.lit("")))


def slug_of(name: str, split: str | None = None) -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return plain.replace(" ", "_").replace("/", "").replace("\\", "") + (f"__{split}" if split else "")


def image_size(values: Sequence[int]) -> tuple[int, int]:
    if len(values) not in (1, 2):
        raise ValueError("an image size is one or two numbers")
    return (values[0], values[-1])


def dataset_size(values: Sequence[int]) -> tuple[int, int, int]:
    if not 1 <= len(values) <= 3:
        raise ValueError("a dataset size is one to three numbers")
    return tuple([*values, 0, 0][:3])


def inverse_permutation(p: Column) -> Column:
    """Positions sorted by their values: the inverse of a permutation, in n log n."""
    pairs = F.array_sort(F.transform(p, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.transform(pairs, lambda x: x["i"].cast("int"))


def chunk_cache(chunk_bytes: int | None, chunks: int | None, override: dict | None = None, least: int = 8191) -> dict:
    """Cache bytes and slots for a number of chunks: slots are the first prime of max(least, 100 * chunks) on.

    Parquet has no such cache; callers that still size one get the same numbers.
    """
    if override is not None:
        return dict(override)
    if chunks is None:
        return {}
    if chunks <= 0:
        raise ValueError("a number of chunks is above 0")
    if chunk_bytes is None:
        return {}
    n = max(least, 100 * chunks)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return {"rdcc_nbytes": chunks * chunk_bytes, "rdcc_nslots": n}
