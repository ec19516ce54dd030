"""Transforms as immutable plans on a tensor column: index maps fuse into one gather, linear ops into one map a dim, numeric kernels into one Arrow UDF."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import linear as L
from ..functions.draws import Draw, Numbers

#: The longest index map that goes into a plan as literals; longer ones run as kernels, which draw the same numbers.
LITERAL_INDEX = 4096
#: Elements of the samples that are stacked at a time in a Python worker, about; one sample at least.
STACK = 1 << 20
Shape = tuple[int, ...]
#: Element types of the columns that hold numpy types; Spark has no unsigned and no half type, so these take the next larger one.
STORED = {"bool": "boolean", "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "float16": "float", "float32": "float", "float64": "double"}
_NUMPY = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def stored(dtype) -> str:
    """The Spark type of the elements of a numpy type."""
    name = np.dtype(dtype).name
    if name not in STORED:
        raise TypeError(f"samples of {name} can't be stored")
    return STORED[name]


def element_dtype(df: DataFrame, column: str) -> str:
    """The numpy type of an array column's elements, float64 for others."""
    kind = df.schema[column].dataType
    return _NUMPY.get(kind.elementType.simpleString(), "float64") if kind.typeName() == "array" else "float64"


def rng(seed: int, position: int, key: int, epoch: int = 0) -> Numbers:
    """The random numbers of each (seed, operator, sample, epoch), whatever the partitioning or retries; the same as Catalyst's Draw."""
    return Numbers(seed, position, key, epoch)


@dataclass(frozen=True)
class Op:
    """One transform. train=None is what it is without a mode: both train and eval.

    draws says whether the kernel takes random numbers; those that don't get no generator, which costs more than most
    kernels. batch() does many samples at once, where numpy can.
    """

    draws = True

    def with_mode(self, train: bool) -> Op:
        return replace(self, train=train) if hasattr(self, "train") else self

    def shape(self, shape: Shape) -> Shape:
        """The output shape; raises on inputs that don't fit."""
        return self.kernel(np.zeros(shape), rng(0, 0, 0)).shape

    def index(self, shape: Shape) -> np.ndarray | None:
        """For moves only: where each output element comes from, -1 for fill."""
        return None

    def linear(self, shape: Shape) -> list[L.AxisMap] | None:
        """The op on floats as linear maps along dims, one after the other, if it is that."""
        return None

    def result(self, dtype: str) -> str:
        """The numpy type of the output for that of the input: the same, unless the op says otherwise."""
        return dtype

    def column(self, data: Column, shape: Shape) -> Column | None:
        """A native expression, if there is one."""
        return None

    def drawn(self, data: Column, shape: Shape, draw: Draw) -> Column | None:
        """A native expression that takes its random numbers from draw(k, n), a whole number from 0 to n - 1, or draw(k), from 0 to 1."""
        return None

    def kernel(self, x: np.ndarray, random: Numbers) -> np.ndarray:
        raise NotImplementedError

    def batch(self, x: np.ndarray) -> np.ndarray:
        """The kernel without random numbers on samples stacked along a new first axis."""
        return np.stack([self.kernel(v, None) for v in x])


def chosen(data: Column, maps: Sequence[np.ndarray], which: Column) -> Column | None:
    """data gathered by the which-th of several index maps without fill, if they fit into a plan as literals."""
    if sum(map(len, maps)) > LITERAL_INDEX:
        return None
    tables = F.array(*[F.array(*[F.lit(int(i)) for i in m]) for m in maps])
    return F.transform(F.get(tables, which), lambda i: F.get(data, i))


def _positions(shape: Shape) -> np.ndarray:
    return np.arange(math.prod(shape)).reshape(shape)


def _behind(dims: Sequence[int]) -> tuple[int, ...]:
    """The same dims of a sample where samples are stacked along a new first axis."""
    return tuple(d if d < 0 else d + 1 for d in dims)


@dataclass(frozen=True)
class Move(Op):
    """An op that only moves elements: its kernel applied to positions is its index map."""

    fill = 0.0
    draws = False

    def move(self, x: np.ndarray, fill: float) -> np.ndarray:
        raise NotImplementedError

    def kernel(self, x: np.ndarray, random: Numbers) -> np.ndarray:
        return self.move(x, self.fill)

    def shape(self, shape: Shape) -> Shape:
        return self.move(np.zeros(shape), 0).shape

    def index(self, shape: Shape) -> np.ndarray | None:
        return self.move(np.arange(math.prod(shape)).reshape(shape), -1).ravel()


def _all(x) -> tuple:
    return tuple(x) if isinstance(x, Sequence) else (x,)


@dataclass(frozen=True)
class _AlongDims(Move):
    """A move that goes along each of its dims whatever the others are."""

    def linear(self, shape):
        maps = []
        for d in sorted({d % len(shape) for d in _all(self.dim)}):
            n = shape[d]
            at = np.broadcast_to(np.arange(n).reshape([n if k == d else 1 for k in range(len(shape))]), shape)
            line = np.moveaxis(self.move(at, -1), d, 0).reshape(-1, math.prod(self.shape(shape)) // self.shape(shape)[d]) if math.prod(self.shape(shape)) else None
            if line is None:
                return None
            maps.append(L.taken(d, line.max(axis=1), self.fill))  # where other dims are filled, all is -1
        return maps


@dataclass(frozen=True)
class NoTransform(Move):
    def move(self, x, fill):
        return x

    def linear(self, shape):
        return []


@dataclass(frozen=True)
class Flip(_AlongDims):
    dim: int | tuple[int, ...]

    def move(self, x, fill):
        return np.flip(x, _all(self.dim))


@dataclass(frozen=True)
class Permute(Move):
    dim: tuple[int, ...]

    def move(self, x, fill):
        return np.transpose(x, self.dim)


@dataclass(frozen=True)
class Reshape(Move):
    to: tuple[int, ...]

    def move(self, x, fill):
        return x.reshape(self.to)


@dataclass(frozen=True)
class Rotate90(Move):
    dim: tuple[int, int]
    k: int = 1

    def move(self, x, fill):
        return np.rot90(x, self.k, self.dim)


@dataclass(frozen=True)
class Pad(_AlongDims):
    """Grows dims to target sizes, the smaller half in front; never crops."""

    size: int | tuple[int, ...]
    dim: int | tuple[int, ...]
    mode: str = "constant"
    value: float = 0.0

    def __post_init__(self):
        if len(_all(self.size)) != len(_all(self.dim)):
            raise ValueError("as many sizes as dims are needed")
        if self.mode not in ("constant", "reflect", "replicate", "circular"):
            raise ValueError(f"no padding mode {self.mode!r}")
        object.__setattr__(self, "fill", self.value)

    def move(self, x, fill):
        for n, d in zip(_all(self.size), _all(self.dim), strict=True):
            m = x.shape[d]
            if n <= m:
                continue
            at = np.arange(n) - (n - m) // 2
            inside = (at >= 0) & (at < m)
            if self.mode == "replicate":
                at, inside = np.clip(at, 0, m - 1), np.ones(n, bool)
            elif self.mode == "circular":
                at, inside = np.mod(at, m), np.ones(n, bool)
            elif self.mode == "reflect":
                at = np.mod(at, max(1, 2 * (m - 1)))
                at, inside = np.where(at >= m, 2 * (m - 1) - at, at), np.ones(n, bool)
            y = np.moveaxis(np.take(x, np.where(inside, at, 0), d), d, -1)
            x = np.moveaxis(np.where(inside, y, np.array(fill, x.dtype)), -1, d)
        return x


def _crop(x: np.ndarray, dims: tuple, sizes: tuple, start: Callable[[int], int]) -> np.ndarray:
    if len(dims) != len(sizes):
        raise ValueError("as many sizes as dims are needed")
    for d, s in zip(dims, sizes, strict=True):
        if s > x.shape[d]:
            raise ValueError(f"a crop of {s} is larger than the {x.shape[d]} there are")
        a = start(x.shape[d] - s)
        x = np.take(x, np.arange(a, a + s), d)
    return x


@dataclass(frozen=True)
class CenterCrop(_AlongDims):
    dim: int | tuple[int, ...]
    size: int | tuple[int, ...]

    def move(self, x, fill):
        return _crop(x, _all(self.dim), _all(self.size), lambda n: (n + 1) // 2)


@dataclass(frozen=True)
class _Random(Op):
    """A random op that in eval is the move `calm`, or changes nothing if that is None."""

    def calm(self) -> Move | None:
        return NoTransform()

    def index(self, shape):
        return self.calm().index(shape) if self.train is False and self.calm() else None

    def linear(self, shape):
        return self.calm().linear(shape) if self.train is False and self.calm() else None

    def shape(self, shape):
        return self.calm().shape(shape) if self.calm() else super().shape(shape)

    def kernel(self, x, random):
        if self.train is False and self.calm():
            return self.calm().kernel(x, random)
        return self.draw(x, random)


@dataclass(frozen=True)
class RandomCrop(_Random):
    dim: int | tuple[int, ...]
    size: int | tuple[int, ...]
    train: bool | None = True

    def calm(self):
        return CenterCrop(self.dim, self.size)

    def draw(self, x, random):
        return _crop(x, _all(self.dim), _all(self.size), lambda n: int(random.integers(0, n + 1)))

    def drawn(self, data, shape, draw):
        first = _crop(_positions(shape), _all(self.dim), _all(self.size), lambda n: 0).ravel()
        if len(first) > LITERAL_INDEX:
            return None
        stride = lambda d: math.prod(shape[d % len(shape) + 1 :])
        shift = sum((draw(k, shape[d] - s + 1) * stride(d) for k, (d, s) in enumerate(zip(_all(self.dim), _all(self.size), strict=True))), F.lit(0))
        return F.transform(F.array(*[F.lit(int(i)) for i in first]), lambda i: F.get(data, i + shift))


@dataclass(frozen=True)
class _SliceStart(_AlongDims):
    size: int
    dim: int = -1

    def move(self, x, fill):
        return _crop(x, (self.dim,), (self.size,), lambda n: (n - 1) // 2 if n else 0)


@dataclass(frozen=True)
class RandomSlice(_Random):
    size: int
    dim: int = -1
    train: bool | None = True

    def calm(self):
        return _SliceStart(self.size, self.dim)

    def draw(self, x, random):
        return _crop(x, (self.dim,), (self.size,), lambda n: int(random.integers(0, n + 1)))

    def drawn(self, data, shape, draw):
        if math.prod(shape) == shape[self.dim]:  # one run of elements
            self.shape(shape)
            return F.slice(data, draw(0, shape[self.dim] - self.size + 1) + 1, self.size)
        return RandomCrop(self.dim, self.size).drawn(data, shape, draw)


@dataclass(frozen=True)
class _Patches(Move):
    size: tuple[int, int]
    grid: tuple[int, int]

    def cut(self, x, start):
        (h, w), (rows, cols) = self.size, self.grid
        ch, cw = x.shape[-2] // rows, x.shape[-1] // cols
        if ch < h or cw < w:
            raise ValueError(f"cells of {(ch, cw)} are smaller than patches of {self.size}")
        out = []
        for r in range(rows):
            for c in range(cols):
                a, b = r * ch + start(ch - h), c * cw + start(cw - w)
                out.append(x[..., a : a + h, b : b + w])
        return np.stack(out, axis=-3)

    def move(self, x, fill):
        return self.cut(x, lambda n: (n + 1) // 2)


@dataclass(frozen=True)
class RandomPatchesInGrid(_Random):
    """[..., H, W] to [..., N, h, w]: one patch from each cell of a grid, row by row."""

    size: int | tuple[int, int]
    grid: int | tuple[int, int]
    train: bool | None = True

    def calm(self):
        n = self.grid
        if not isinstance(n, Sequence):
            rows = max(k for k in range(1, math.isqrt(n) + 1) if n % k == 0)
            n = (rows, n // rows)
        return _Patches(_all(self.size) if isinstance(self.size, Sequence) else (self.size, self.size), tuple(n))

    def draw(self, x, random):
        return self.calm().cut(x, lambda n: int(random.integers(0, n + 1)))


@dataclass(frozen=True)
class RandomFlip(_Random):
    dim: int | tuple[int, ...]
    prob: float | tuple[float, ...] = 0.5
    train: bool | None = True

    def __post_init__(self):
        if isinstance(self.prob, Sequence) and len(self.prob) != len(_all(self.dim)):
            raise ValueError("as many probabilities as dims are needed")

    def draw(self, x, random):
        probs = self.prob if isinstance(self.prob, Sequence) else [self.prob] * len(_all(self.dim))
        return np.flip(x, tuple(d for d, p in zip(_all(self.dim), probs, strict=True) if random.random() <= p))

    def drawn(self, data, shape, draw):
        dims = _all(self.dim)
        probs = self.prob if isinstance(self.prob, Sequence) else [self.prob] * len(dims)
        maps = [np.flip(_positions(shape), tuple(d for k, d in enumerate(dims) if n >> k & 1)).ravel() for n in range(1 << len(dims))]
        which = sum((F.when(draw(k) <= float(p), 1 << k).otherwise(0) for k, p in enumerate(probs)), F.lit(0))
        return chosen(data, maps, which)


@dataclass(frozen=True)
class RandomRotate90(_Random):
    dim: tuple[int, int]
    train: bool | None = True

    def shape(self, shape):
        if self.train is not False and shape[self.dim[0]] != shape[self.dim[1]]:
            raise ValueError("random quarter turns keep the shape of square planes only")
        return shape

    def draw(self, x, random):
        return np.rot90(x, int(random.integers(0, 4)), self.dim)

    def drawn(self, data, shape, draw):
        return chosen(data, [np.rot90(_positions(shape), k, self.dim).ravel() for k in range(4)], draw(0, 4))


@dataclass(frozen=True)
class RotateAnyDegree(Op):
    draws = False

    dim: tuple[int, int]
    angle: float
    fill_value: float = 0.0

    def __post_init__(self):
        if not 0 <= self.angle < 360:
            raise ValueError("the angle lies in [0, 360)")

    def linear(self, shape):
        return [K.turn_map(shape, self.dim, self.angle, self.fill_value)]

    def kernel(self, x, random):
        return K.rotate(x, self.dim, self.angle, self.fill_value)


@dataclass(frozen=True)
class RandomRotateAnyDegree(_Random):
    dim: tuple[int, int]
    fill_value: float = 0.0
    train: bool | None = True

    def draw(self, x, random):
        return K.rotate(x, self.dim, float(random.uniform(0, 360)), self.fill_value)


@dataclass(frozen=True)
class RandomErasing(_Random):
    dim: int | tuple[int, ...]
    scale: tuple[float, float] = (0.02, 0.33)
    value: float = 0.0
    train: bool | None = True

    def draw(self, x, random):
        at = [slice(None)] * x.ndim
        for d in _all(self.dim):
            n = int(x.shape[d] * random.uniform(*self.scale))
            a = int(random.integers(0, x.shape[d] - n + 1))
            at[d] = slice(a, a + n)
        y = x.copy()
        y[tuple(at)] = self.value
        return y


@dataclass(frozen=True)
class RandomNoise(_Random):
    """Normal noise that is the same along all but the named dims, clipped to the type's range (floats: 0 to 255)."""

    dim: int | tuple[int, ...]
    scale: float = 1.0
    train: bool | None = True

    def draw(self, x, random):
        dims = {d % x.ndim for d in _all(self.dim)}
        y = x + random.normal(0, self.scale, [n if k in dims else 1 for k, n in enumerate(x.shape)])
        low, high = (np.iinfo(x.dtype).min, np.iinfo(x.dtype).max) if np.issubdtype(x.dtype, np.integer) else (0, 255)
        return np.clip(y, low, high).astype(x.dtype)


def _between(value, random) -> float:
    return float(random.uniform(*value)) if isinstance(value, Sequence) else float(value)


@dataclass(frozen=True)
class GaussianBlur(Op):
    """A pair of sigmas is drawn from, in eval too."""

    dim: int | tuple[int, ...]
    sigma: float | tuple[float, float] = 1.0
    radius: int = 4

    def linear(self, shape):
        return None if isinstance(self.sigma, Sequence) else K.blur_maps(shape, _all(self.dim), float(self.sigma), self.radius)

    def kernel(self, x, random):
        return K.gaussian_blur(x, _all(self.dim), _between(self.sigma, random), self.radius)


@dataclass(frozen=True)
class ResizeRoundTrip(Op):
    draws = False

    dim: int | tuple[int, ...]
    scale: float

    def linear(self, shape):
        return K.resize_maps(shape, _all(self.dim), self.scale)

    def kernel(self, x, random):
        return K.resize_round_trip(x, _all(self.dim), self.scale)


@dataclass(frozen=True)
class RandomResizeRoundTrip(_Random):
    dim: int | tuple[int, ...]
    scale_range: tuple[float, float] = (0.25, 0.75)
    train: bool | None = True

    def draw(self, x, random):
        return K.resize_round_trip(x, _all(self.dim), _between(self.scale_range, random))


@dataclass(frozen=True)
class JPEGCompression(Op):
    """(3, H, W) of whole numbers 0-255 in any type; other values are an error. Train draws the quality of a range, eval takes its middle."""

    quality: int | tuple[int, int] = 75
    train: bool | None = True

    def kernel(self, x, random):
        q = self.quality
        if isinstance(q, Sequence):
            q = sum(q) // 2 if self.train is False else int(random.integers(q[0], q[1] + 1))
        if x.dtype != np.uint8 and not ((x >= 0) & (x <= 255) & (x == np.rint(x))).all():
            raise ValueError("JPEG takes whole numbers from 0 to 255")
        return K.jpeg_round_trip(x.astype(np.uint8), q).astype(x.dtype)


@dataclass(frozen=True)
class ColorJitter(_Random):
    """Brightness, contrast, saturation (factors, 1 changes nothing) and hue (0 changes nothing) in random order; pairs are drawn from.

    Images of bytes stay bytes from step to step, as a byte image does in each of the adjustments; others lie in [0, 1].
    """

    brightness: Any = 1.0
    contrast: Any = 1.0
    saturation: Any = 1.0
    hue: Any = None
    train: bool | None = True

    def draw(self, x, random):
        y = x if x.dtype == np.uint8 else x.astype(np.float32)
        steps = [(K.adjust_brightness, self.brightness), (K.adjust_contrast, self.contrast), (K.adjust_saturation, self.saturation), (K.adjust_hue, self.hue)]
        for k in random.permutation(4):
            f, value = steps[k]
            if value is not None:
                y = f(y, _between(value, random))
        return y.astype(x.dtype)


@dataclass(frozen=True)
class ToFloat32(Op):
    """Single precision, native."""

    draws = False

    def result(self, dtype):
        return "float32"

    def kernel(self, x, random):
        return x.astype(np.float32)

    def batch(self, x):
        return x.astype(np.float32)

    def column(self, data, shape):
        return F.transform(data, lambda v: v.cast("float"))


@dataclass(frozen=True)
class FFT(Op):
    """Fourier transform over dims. Complex numbers lie in a last axis of 2 (real, imaginary); log magnitudes have none."""

    draws = False

    dim: tuple[int, ...]
    shift: bool = False
    log: bool = False
    eps: float = 1e-12

    def result(self, dtype):
        return "float64"

    def kernel(self, x, random):
        return self._over(np.asarray(x, np.float64), self.dim)

    def batch(self, x):
        return self._over(np.asarray(x, np.float64), _behind(self.dim))

    def _over(self, x, dims):
        y = K.fft(x, dims, self.shift, self.log, self.eps)
        return y if self.log else np.stack([y.real, y.imag], axis=-1)


@dataclass(frozen=True)
class InverseFFT(Op):
    """The real part of the inverse transform of what FFT gives; dims count without the last axis."""

    draws = False

    dim: tuple[int, ...]
    shift: bool = False

    def result(self, dtype):
        return "float64"

    def kernel(self, x, random):
        return self._over(np.asarray(x, np.float64), self.dim)

    def batch(self, x):
        return self._over(np.asarray(x, np.float64), _behind(self.dim))

    def _over(self, x, dims):
        y = x[..., 0] + 1j * x[..., 1]
        y = np.fft.ifftshift(y, axes=dims) if self.shift else y
        return np.fft.ifftn(y, axes=dims).real


@dataclass(frozen=True)
class FrequencyMask(Op):
    """Low or high pass on what FFT gives: each coefficient times the mask at its radial frequency."""

    draws = False

    dim: tuple[int, ...]
    cutoff: float
    width: float = 0.1
    slope: str = "linear"
    multiplier: float = 2.0
    high: bool = False
    shift: bool = False

    def result(self, dtype):
        return "float64"

    def kernel(self, x, random):
        return x * self._mask(x.shape[:-1])

    def batch(self, x):
        return x * self._mask(x.shape[1:-1])

    def _mask(self, shape):
        radial = K.radial_frequencies(shape, self.dim, self.shift)
        return K.pass_mask(radial, self.cutoff, self.width, self.slope, self.multiplier, self.high)[..., None]


@dataclass(frozen=True)
class FFTLogMagnitude(Op):
    draws = False

    dim: tuple[int, ...]
    shift: bool = False
    eps: float = 1e-12

    def result(self, dtype):
        return "float64"

    def kernel(self, x, random):
        return K.fft(np.asarray(x, np.float64), self.dim, self.shift, True, self.eps)

    def batch(self, x):
        return K.fft(np.asarray(x, np.float64), _behind(self.dim), self.shift, True, self.eps)


@dataclass(frozen=True)
class DCT(Op):
    draws = False

    dim: tuple[int, ...]
    log: bool = True
    eps: float = 1e-12

    def result(self, dtype):
        return "float64"

    def linear(self, shape):
        return None if self.log else [L.cosine(d % len(shape), shape[d]) for d in self.dim]

    def kernel(self, x, random):
        return K.dct(x, self.dim, self.log, self.eps)

    def batch(self, x):
        return K.dct(x, _behind(self.dim), self.log, self.eps)


@dataclass(frozen=True)
class Normalize(Op):
    """(x - mean) / (std + 1e-12); mean and std are numbers or arrays that broadcast, after an optional permutation."""

    draws = False

    mean: Any
    std: Any
    permute: tuple[int, ...] | None = None

    def result(self, dtype):
        return "float64"

    def kernel(self, x, random):
        y = np.asarray(np.transpose(x, self.permute) if self.permute else x, np.float64)
        y = (y - np.asarray(self.mean)) / (np.asarray(self.std) + 1e-12)
        return np.transpose(y, np.argsort(self.permute)) if self.permute else y

    def column(self, data, shape):
        if np.ndim(self.mean) == 0 and np.ndim(self.std) == 0:
            return F.transform(data, lambda v: (v.cast("double") - float(self.mean)) / (float(self.std) + 1e-12))
        p = self.permute or tuple(range(len(shape)))
        inverse = np.argsort(p)
        spread = lambda v: np.transpose(np.broadcast_to(np.asarray(v, float), [shape[k] for k in p]), inverse).ravel()
        mean, std = spread(self.mean), spread(self.std) + 1e-12
        if len(mean) > LITERAL_INDEX:
            return None
        pairs = F.arrays_zip(F.array(*map(F.lit, mean.tolist())).alias("m"), F.array(*map(F.lit, std.tolist())).alias("s"))
        return F.zip_with(data, pairs, lambda v, p: (v.cast("double") - p["m"]) / p["s"])


@dataclass(frozen=True)
class InvertPhase(Op):
    draws = False

    def result(self, dtype):
        return {"uint8": "int16", "uint16": "int32", "uint32": "int64"}.get(np.dtype(dtype).name, dtype)

    def kernel(self, x, random):
        return -x.astype(self.result(x.dtype.name))

    def column(self, data, shape):
        return F.transform(data, lambda v: -v)


@dataclass(frozen=True)
class ConvertToFloat32(Op):
    """Whole numbers by their type's largest value; floats pass."""

    draws = False

    dtype: str

    def result(self, dtype):
        return "float32"

    def kernel(self, x, random):
        return (x / np.iinfo(self.dtype).max).astype(np.float32) if np.issubdtype(np.dtype(self.dtype), np.integer) else x.astype(np.float32)

    def column(self, data, shape):
        whole = np.issubdtype(np.dtype(self.dtype), np.integer)
        return F.transform(data, lambda v: (v.cast("double") / float(np.iinfo(self.dtype).max)).cast("float") if whole else v.cast("float"))


@dataclass(frozen=True)
class MixSample(Op):
    """x + level * a stretch of sample; eval takes the middle stretch and level 0.5."""

    sample: tuple[float, ...]
    level: float | tuple[float, float] = 0.5
    train: bool | None = True

    def shape(self, shape):
        if len(self.sample) < shape[-1]:
            raise ValueError("the sample is shorter than the input")
        return shape

    def kernel(self, x, random):
        n = len(self.sample) - self.shape(x.shape)[-1]
        a = max(0, (n - 1) // 2) if self.train is False else int(random.integers(0, n + 1))
        level = 0.5 if self.train is False else _between(self.level, random)
        return x + level * np.asarray(self.sample)[a : a + x.shape[-1]]

    def column(self, data, shape):
        if self.train is not False or math.prod(shape) > LITERAL_INDEX:
            return None
        a = max(0, (len(self.sample) - shape[-1] - 1) // 2)
        part = np.broadcast_to(0.5 * np.asarray(self.sample[a : a + shape[-1]]), shape).ravel().tolist()
        return F.zip_with(data, F.array(*map(F.lit, part)), lambda v, s: v.cast("double") + s)

    def result(self, dtype):
        return "float64"

    def drawn(self, data, shape, draw):
        n = shape[-1]
        if self.train is False or math.prod(self.shape(shape)) != n or len(self.sample) > LITERAL_INDEX:
            return None
        part = F.slice(F.array(*[F.lit(float(v)) for v in self.sample]), draw(0, len(self.sample) - n + 1) + 1, n)
        by = F.array_repeat(draw.between(1, self.level), n)
        return F.zip_with(data, F.arrays_zip(part.alias("s"), by.alias("l")), lambda v, p: v.cast("double") + p["s"] * p["l"])


@dataclass(frozen=True)
class RandomAttenuation(_Random):
    attenuation: float | tuple[float, float]
    train: bool | None = True

    def draw(self, x, random):
        return x * _between(self.attenuation, random)

    def result(self, dtype):
        return dtype if self.train is False or np.dtype(dtype).kind == "f" else "float64"

    def drawn(self, data, shape, draw):
        by = F.array_repeat(draw.between(0, self.attenuation), math.prod(shape))  # drawn once, outside the lambda
        return F.zip_with(data, by, lambda v, a: v.cast("double") * a)


@dataclass(frozen=True)
class AudioCodecCompression(Op):
    """MP3 or OGG round trip by a codec(x, format, level) that the caller gives; none is built in."""

    codec: Callable | None = None
    formats: tuple[str, ...] = ("MP3",)
    level: float | tuple[float, float] = 0.5
    train: bool | None = True

    def __post_init__(self):
        if self.codec is None:
            raise NotImplementedError("no MP3 or OGG codec is built in; give one as codec=")

    def shape(self, shape):
        return shape

    def kernel(self, x, random):
        calm = self.train is False
        name = self.formats[0] if calm else self.formats[random.integers(0, len(self.formats))]
        pair = isinstance(self.level, Sequence)
        return self.codec(x, name, sum(self.level) / 2 if calm and pair else _between(self.level, random))


@dataclass(frozen=True)
class Apply(Op):
    """Any function of one sample; dtype is what it gives, by default what it gets; out_shape, where zeros in double precision can't tell it."""

    function: Callable[[np.ndarray], np.ndarray]
    dtype: str | None = None
    out_shape: Shape | None = None

    def shape(self, shape):
        return self.out_shape or super().shape(shape)

    def result(self, dtype):
        return self.dtype or dtype

    def kernel(self, x, random):
        return self.function(x)


@dataclass(frozen=True)
class RandomChoices(_Random):
    """Draws `samples` of weighted ops and applies them in turn; all must keep the shape alike."""

    choices: tuple[tuple[Op, float], ...]
    samples: int = 1
    replace: bool = True
    train: bool | None = True

    def __post_init__(self):
        if not self.replace and self.choices and self.samples > len(self.choices):
            raise ValueError("too few choices to draw without replacement")

    def with_mode(self, train):
        return replace(self, train=train, choices=tuple((op.with_mode(train), w) for op, w in self.choices))

    def result(self, dtype):
        return np.result_type(dtype, *[op.result(dtype) for op, _ in self.choices]).name

    def draw(self, x, random):
        if not self.choices:
            return x
        w = np.array([w for _, w in self.choices], float)
        for k in random.choice(len(w), self.samples, self.replace, w / w.sum()):
            x = self.choices[k][0].kernel(x, random)
        return x


@dataclass(frozen=True, eq=False)
class _Linear(Op):
    """A run of linear ops on floats as few maps; computed in double precision and rounded to the samples' type once."""

    draws = False

    maps: tuple[L.AxisMap, ...]
    ops: tuple[Op, ...]

    def shape(self, shape):
        return Compose(self.ops).shape(shape)

    def result(self, dtype):
        return Compose(self.ops).result(dtype)

    def kernel(self, x, random):
        return self.batch(x[None])[0]

    def batch(self, x):
        y = np.asarray(x, np.float64)
        for m in self.maps:
            y = m.apply(y)
        return y


def fused(ops: Sequence[Op], shape: Shape, dtype: str) -> list[tuple[int, Op]]:
    """The ops with their places in the pipeline; on floats, runs of linear ops that do more than move elements are one op."""
    done: list[tuple[int, Op]] = []
    k = 0
    while k < len(ops):
        j, now, maps, weighs = k, shape, [], False
        while dtype in ("float32", "float64") and j < len(ops) and (step := ops[j].linear(now)) is not None:
            weighs |= ops[j].index(now) is None
            maps, now, j = maps + step, ops[j].shape(now), j + 1
        if weighs:
            done.append((k, _Linear(tuple(L.product(maps)), tuple(ops[k:j]))))
        else:
            j = max(j, k + 1)
            done += list(enumerate(ops[k:j], k))
        for op in ops[k:j]:
            shape, dtype = op.shape(shape), np.dtype(op.result(dtype)).name
        k = j
    return done


class Compose:
    """Ops from left to right. Immutable: append, insert, extend and set give a new one."""

    def __init__(self, ops: Sequence[Op] = ()) -> None:
        self.ops = tuple(ops)

    def __len__(self) -> int:
        return len(self.ops)

    def __getitem__(self, k):
        return self.ops[k]

    def append(self, op: Op) -> Compose:
        return Compose((*self.ops, op))

    def extend(self, ops: Sequence[Op]) -> Compose:
        return Compose((*self.ops, *ops))

    def insert(self, k: int, op: Op) -> Compose:
        return Compose((*self.ops[:k], op, *self.ops[k:]))

    def set(self, k: int, op: Op) -> Compose:
        return Compose(tuple(op if i == k % len(self.ops) else o for i, o in enumerate(self.ops)))

    def with_mode(self, train: bool) -> Compose:
        return Compose([op.with_mode(train) for op in self.ops])

    def shape(self, shape: Shape) -> Shape:
        for op in self.ops:
            shape = op.shape(shape)
        return shape

    def kernel(self, x: np.ndarray, seed: int = 0, key: int = 0, epoch: int = 0) -> np.ndarray:
        for k, op in enumerate(self.ops):
            x = op.kernel(x, rng(seed, k, key, epoch))
        return x

    def result(self, dtype: str) -> str:
        for op in self.ops:
            dtype = op.result(dtype)
        return np.dtype(dtype).name

    def column(self, data: Column, shape: Shape, key: Column, *, seed: int = 0, epoch: int = 0, dtype: str = "float64") -> tuple[Column, Shape]:
        """The transformed column and its shape. Runs of moves become one gather; from the first kernel on, all is one UDF.

        dtype is the samples' numpy type. The ops alone decide the type of the result (see result), not the way they run.
        """
        steps = fused(self.ops, shape, dtype)
        k = 0
        while k < len(steps):
            index, fill, now = None, None, shape
            j = k
            while j < len(steps) and (step := steps[j][1].index(now)) is not None:
                own = getattr(steps[j][1], "fill", 0.0)
                if index is not None and (index < 0).any() and (step < 0).any() and own != fill:
                    break
                fill = own if (step < 0).any() else fill
                index = step if index is None else np.where(step >= 0, index[np.maximum(step, 0)], -1)
                now = steps[j][1].shape(now)
                j += 1
            if index is not None and len(index) <= LITERAL_INDEX:
                if not np.array_equal(index, np.arange(math.prod(shape))):
                    data = gather(data, index, fill)
                k, shape = j, now
                data = data.cast(f"array<{stored(dtype)}>")
                continue
            place, op = steps[k]
            native = op.column(data, shape)
            if native is None and getattr(op, "train", False) is not False:
                native = op.drawn(data, shape, Draw(seed, place, key, epoch))
            if native is not None:
                dtype = op.result(dtype)
                data, shape, k = native.cast(f"array<{stored(dtype)}>"), op.shape(shape), k + 1
                continue
            # Spark allows no lambda over a UDF's result, and the sample is in Python by now: the rest runs there too
            data = _fused(steps[k:], shape, seed, epoch, dtype)(data, key)
            shape, k = Compose([op for _, op in steps[k:]]).shape(shape), len(steps)
        return data, shape

    def apply(self, df: DataFrame, shape: Shape, *, column: str = "data", key: str = "row_idx", seed: int = 0, epoch: int = 0, dtype: str | None = None) -> tuple[DataFrame, Shape]:
        """df with the column transformed, and its new shape; dtype is by default the column's own."""
        out, shape = self.column(F.col(column), shape, F.col(key), seed=seed, epoch=epoch, dtype=dtype or element_dtype(df, column))
        return df.withColumn(column, out), shape


def gather(data: Column, index: np.ndarray, fill: float | None = None) -> Column:
    """Elements of an array column by constant positions; -1 gives fill."""
    at = F.array(*[F.lit(int(i)) for i in index])
    got = lambda i: F.get(data, i)
    return F.transform(at, (lambda i: F.coalesce(got(i), F.lit(float(fill or 0)))) if (index < 0).any() else got)


def _fused(steps: Sequence[tuple[int, Op]], shape: Shape, seed: int, epoch: int, dtype: str):
    types = [dtype]
    for _, op in steps:
        types.append(op.result(types[-1]))
    element = stored(types[-1])

    @F.pandas_udf(f"array<{element}>")
    def run(data, keys):
        import pandas as pd

        out = np.full(len(data), None, object)
        rows, step = np.flatnonzero(data.notna()), max(1, STACK // max(1, math.prod(shape)))
        for at in (rows[k : k + step] for k in range(0, len(rows), step)):
            y = np.stack([np.asarray(x, dtype).reshape(shape) for x in data.iloc[at]])
            for k, (place, op) in enumerate(steps):
                if op.draws:
                    y = np.stack([op.kernel(x, rng(seed, place, int(key), epoch)) for x, key in zip(y, keys.iloc[at], strict=True)])
                else:
                    y = op.batch(y)
                y = y.astype(types[k + 1], copy=False)
            y = y.reshape(len(at), -1).astype(_NUMPY[element])
            for i, x in zip(at, y, strict=True):
                out[i] = x
        return pd.Series(out)

    return run


# Dictionary transforms: named tensors are columns.


def dict_create(df: DataFrame, column: str, transforms: dict[str, Compose], shape: Shape, **options) -> DataFrame:
    """One input column to a column for each name."""
    key = options.pop("key", "row_idx")
    options = {"dtype": element_dtype(df, column)} | options
    return df.withColumns({name: t.column(F.col(column), shape, F.col(key), **options)[0] for name, t in transforms.items()})


def dict_clone(df: DataFrame, source: str, clone: str) -> DataFrame:
    if source not in df.columns:
        raise KeyError(source)
    return df.withColumn(clone, F.col(source))


def dict_apply(df: DataFrame, columns: Sequence[str], transform: Compose, shape: Shape, **options) -> DataFrame:
    for c in columns:
        if c not in df.columns:
            raise KeyError(c)
        df, _ = transform.apply(df, shape, column=c, **options)
    return df
