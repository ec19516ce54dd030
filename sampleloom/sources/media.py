"""Images and audio: bytes to tensors, in the tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ImageTooSmallError
from ..functions.geometry import crop_box
from ..functions.kernels import lanczos_resize, sinc_resample
from .audio import read_flac, read_wav

IMAGE = "path string, height int, width int, data array<smallint>, error string"


def _of_file(seed: int, path: str) -> np.random.Generator:
    """A generator of its own for each file name, whatever the folder, partitioning or retries."""
    return np.random.default_rng([seed, zlib.crc32(path.rsplit("/", 1)[-1].encode())])


def fit_image(x: np.ndarray, target: int | tuple[int, int], *, randomized_crop: bool = False, scale_to_fit: bool = False, crop_origin: tuple[int, int] | None = None, random: np.random.Generator | None = None) -> np.ndarray:
    """An (H, W, 3) image, scaled to cover the target if asked for, then cropped to it."""
    if crop_origin is not None and (randomized_crop or scale_to_fit):
        raise ValueError("a crop origin goes with neither scaling nor random crops")
    tw, th = (target, target) if isinstance(target, int) else target
    h, w = x.shape[:2]
    if scale_to_fit:
        f = max(tw / w, th / h)
        w, h = max(tw, int(w * f)), max(th, int(h * f))
        x = lanczos_resize(x, (w, h))
    if w < tw or h < th:
        raise ImageTooSmallError((w, h), (tw, th))
    left, top, right, bottom = crop_box((w, h), (tw, th), randomized=randomized_crop, origin=crop_origin, draw=lambda a, b: int((random or np.random.default_rng()).integers(a, b + 1)))
    return x[top:bottom, left:right]


def read_images(spark: SparkSession, path: str | list[str], target: int | tuple[int, int], *, reader: dict | None = None, seed: int = 0, **options) -> DataFrame:
    """Rows IMAGE of the images at path (RGB, rows from the top); those that fail have an error and no data.

    Random crops depend on seed and file name only.
    """
    raw = spark.read.format("image").options(**reader or {}).option("dropInvalid", False).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def load(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, h, w, c, data in pdf.itertuples(index=False):
                try:
                    if h < 0:
                        raise ValueError("not an image")
                    x = np.frombuffer(data, np.uint8).reshape(h, w, c)
                    x = np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1]
                    x = fit_image(x, target, random=_of_file(seed, p), **options)
                    out.append((p, x.shape[0], x.shape[1], x.astype(np.int16).ravel(), None))
                except ValueError as e:
                    out.append((p, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "height", "width", "data", "error"])

    return raw.mapInPandas(load, IMAGE)


def decode_audio(raw: bytes, target_length: int, target_sample_rate: int = 22050, load_offset: float = 0, random_slice: bool = False, dtype: str = "int16", resample: Callable | None = None, random: np.random.Generator | None = None) -> np.ndarray:
    """(1, target_length) of the left channel of a WAV or FLAC file; zeros in front (less) and behind (more) where it is short.

    Whole numbers of 8 to 32 bits and floats are read; above 16 bits they become 32. Another sample rate goes through
    resample(x, from, to), by default the windowed sinc of functions/kernels.py.
    """
    if dtype not in ("int16", "int32", "float32", "float64"):
        raise ValueError(f"no audio type {dtype!r}")
    x, rate = read_flac(raw) if raw[:4] == b"fLaC" else read_wav(raw)
    x = x[min(len(x), int(load_offset)) :, 0]
    full = float(np.iinfo(x.dtype).max) if x.dtype.kind == "i" else 1.0
    if rate != target_sample_rate:
        x = (resample or sinc_resample)(x, rate, target_sample_rate)
    if np.dtype(dtype).kind == "f":
        x = (x / full).astype(dtype)
    elif np.dtype(dtype) != x.dtype:
        x = (np.clip(x / full, -1, 1) * np.iinfo(dtype).max).astype(dtype)
    if len(x) < target_length:
        n = target_length - len(x)
        return np.pad(x, (n // 2, n - n // 2))[None]
    a = int((random or np.random.default_rng()).integers(0, len(x) - target_length)) if random_slice and len(x) > target_length else 0
    return x[None, a : a + target_length]


def audio_samples(content: Column, name: Column, target_length: int, *, seed: int = 0, **options) -> Column:
    """A struct (data, error) of the audio file in a binary column (see decode_audio); random slices depend on seed and name only."""

    @F.pandas_udf("data array<double>, error string")
    def load(content, names):
        import pandas as pd

        out = []
        for raw, name in zip(content, names, strict=True):
            try:
                random = _of_file(seed, name)
                out.append((decode_audio(raw, target_length, random=random, **options).astype(float).ravel(), None))
            except (ValueError, KeyError, struct.error) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["data", "error"])

    return load(content, name)


def read_audio(spark: SparkSession, path: str | list[str], target_length: int, *, reader: dict | None = None, seed: int = 0, **options) -> DataFrame:
    """Rows (path, data, error) of the WAV and FLAC files at path. Random slices depend on seed and file name only."""
    files = spark.read.format("binaryFile").options(**reader or {}).load(path).select("path", "content")
    return files.withColumn("r", audio_samples(F.col("content"), F.col("path"), target_length, seed=seed, **options)).select("path", "r.data", "r.error")
