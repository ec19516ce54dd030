"""Numeric kernels on one sample (numpy arrays); what Catalyst can't express runs these in Arrow batches."""

from __future__ import annotations

import numpy as np

from . import linear as L


def fft(x: np.ndarray, dims: tuple[int, ...], shift: bool = False, log: bool = False, eps: float = 1e-12) -> np.ndarray:
    """Discrete Fourier transform over dims; centred if shift; log magnitudes if log."""
    y = np.fft.fftn(x, axes=dims)
    y = np.fft.fftshift(y, axes=dims) if shift else y
    return np.log(np.abs(y) + eps) if log else y


def mapped(x: np.ndarray, maps: list[L.AxisMap]) -> np.ndarray:
    """Linear maps one after the other on one sample, in double precision."""
    y = np.asarray(x, float)[None]
    for m in maps:
        y = m.apply(y)
    return y[0]


def dct(x: np.ndarray, dims: tuple[int, ...], log: bool = True, eps: float = 1e-12) -> np.ndarray:
    """Unnormalised DCT-II over dims; log magnitudes by default."""
    y = mapped(x, [L.cosine(d % np.ndim(x), np.shape(x)[d]) for d in dims])
    return np.log(np.abs(y) + eps) if log else y


def gaussian_blur(x: np.ndarray, dims: tuple[int, ...], sigma: float, radius: int = 4) -> np.ndarray:
    """Separable blur of a fixed radius; the border is mirrored including its own sample."""
    return mapped(x, blur_maps(x.shape, dims, sigma, radius)).astype(x.dtype)


def blur_maps(shape: tuple[int, ...], dims: tuple[int, ...], sigma: float, radius: int) -> list[L.AxisMap]:
    return [L.blur(d % len(shape), shape[d], sigma, radius) for d in dims]


def resize_maps(shape: tuple[int, ...], dims: tuple[int, ...], scale: float) -> list[L.AxisMap]:
    if scale <= 0:
        raise ValueError("the scale must be above 0")
    size = {d: max(1, round(shape[d] * scale)) for d in dims}
    there = [L.resize(d % len(shape), shape[d], size[d]) for d in dims]
    return there + [L.resize(d % len(shape), size[d], shape[d]) for d in dims]


def resize_round_trip(x: np.ndarray, dims: tuple[int, ...], scale: float) -> np.ndarray:
    """Linear resize of dims to round(scale * n), 1 at least, and back; the ends of the axis stay."""
    return _as(mapped(x, resize_maps(x.shape, dims, scale)), x.dtype)


def _as(y: np.ndarray, dtype: np.dtype) -> np.ndarray:
    return np.rint(y).astype(dtype) if np.issubdtype(dtype, np.integer) else y.astype(dtype)


def turn_map(shape: tuple[int, ...], dims: tuple[int, int], degrees: float, fill: float) -> L.AxisMap:
    a, b = sorted(d % len(shape) for d in dims)
    return L.turn((a, b), shape[a], shape[b], degrees, fill)


def rotate(x: np.ndarray, dims: tuple[int, int], degrees: float, fill: float = 0.0) -> np.ndarray:
    """Rotation in the plane of dims about its centre, same shape; bilinear, `fill` outside."""
    return _as(mapped(x, [turn_map(x.shape, dims, degrees, fill)]), x.dtype)


# The luminance and chrominance quantisation tables of JPEG, Annex K.
_LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]).reshape(8, 8)
_CHROMA = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32).reshape(8, 8)


def _nearest(x: np.ndarray) -> np.ndarray:
    """The nearest whole numbers, ties to even; what is a tie but for the last digits of double precision counts as one."""
    return np.rint(np.round(x, 9))


def jpeg_round_trip(x: np.ndarray, quality: int) -> np.ndarray:
    """The loss of JPEG at a quality, without chroma subsampling, on (3, H, W) uint8."""
    if x.ndim != 3 or x.shape[0] != 3 or x.dtype != np.uint8:
        raise ValueError("a (3, H, W) image of uint8 is needed")
    _, h, w = x.shape
    y = np.pad(x.astype(float), ((0, 0), (0, -h % 8), (0, -w % 8)), mode="edge")
    to = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    ycc = np.rint(np.einsum("ij,jhw->ihw", to, y))
    k = np.arange(8)
    basis = np.cos(np.pi * k[:, None] * (2 * k + 1) / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    out = np.empty_like(ycc)
    for c in range(3):
        table = np.clip(((_CHROMA if c else _LUMA) * scale + 50) // 100, 1, 255)
        blocks = (ycc[c] - (0 if c else 128)).reshape(y.shape[1] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        kept = _nearest(basis @ blocks @ basis.T / table) * table
        out[c] = _nearest((basis.T @ kept @ basis).transpose(0, 2, 1, 3).reshape(ycc[c].shape)) + (0 if c else 128)
    back = np.array([[1, 0, 1.402], [1, -0.344136, -0.714136], [1, 1.772, 0]])
    return np.clip(np.rint(np.einsum("ij,jhw->ihw", back, out)), 0, 255).astype(np.uint8)[:, :h, :w]


def lanczos_resize(x: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Antialiased Lanczos-3 of an (H, W, C) uint8 image to size (width, height), horizontal first."""
    y = x
    for axis, n in ((1, size[0]), (0, size[1])):
        m = y.shape[axis]
        scale = m / n
        wide = max(1.0, scale)
        at = (np.arange(n) + 0.5) * scale
        grid = (np.arange(m)[None, :] + 0.5 - at[:, None]) / wide
        weight = np.where(np.abs(grid) < 3, np.sinc(grid) * np.sinc(grid / 3), 0)
        weight /= weight.sum(axis=1, keepdims=True)
        y = np.clip(np.rint(np.moveaxis(np.tensordot(weight, y.astype(float), (1, axis)), 0, axis)), 0, 255).astype(np.uint8)
    return y


def sinc_resample(x: np.ndarray, rate: int, to: int, zeros: int = 16, block: int = 1 << 14) -> np.ndarray:
    """One channel at another sample rate: a Hann-windowed sinc of `zeros` crossings a side, cut off at the lower rate's half.

    The result has ceil(n * to / rate) samples; integers are rounded and clipped. What lies outside counts as 0. Blocks of
    outputs bound the memory, whatever the length.
    """
    if rate <= 0 or to <= 0:
        raise ValueError("sample rates must be above 0")
    n = -(-len(x) * to // rate)
    cut = min(1.0, to / rate)
    reach = int(np.ceil(zeros / cut))
    signal = np.pad(x.astype(float), reach + 1)
    near = np.arange(-reach, reach + 2)
    out = np.empty(n)
    for a in range(0, n, block):
        k = np.arange(a, min(n, a + block))
        whole, part = k * rate // to, (k * rate % to) / to
        t = (near[None, :] - part[:, None]) * cut
        weight = np.where(np.abs(t) < zeros, np.sinc(t) * np.cos(np.pi * t / (2 * zeros)) ** 2, 0) * cut
        at = np.minimum(whole[:, None] + near[None, :] + reach + 1, len(signal) - 1)  # the last is a zero of the padding
        out[k] = (signal[at] * weight).sum(axis=1)
    if np.issubdtype(x.dtype, np.integer):
        return np.clip(np.rint(out), np.iinfo(x.dtype).min, np.iinfo(x.dtype).max).astype(x.dtype)
    return out.astype(x.dtype)


def _top(x: np.ndarray) -> float:
    return 255.0 if np.issubdtype(x.dtype, np.integer) else 1.0


def check_image(x: np.ndarray, channels: int | None = 3, *, tops: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> None:
    """Rank, channels, type, and for floats that values lie from 0 to the channels' tops (HSV: 360, 1, 1)."""
    if x.ndim != 3 or (channels and x.shape[0] != channels):
        raise ValueError(f"an image of {channels or 'some'} channels first is needed, not {x.shape}")
    if x.dtype not in (np.uint8, np.float32):
        raise ValueError(f"an image is uint8 or float32, not {x.dtype}")
    if x.dtype == np.float32:
        for name, part, top in zip(("first", "second", "third"), x, tops, strict=False):
            if part.size and (part.min() < 0 or part.max() > top):
                raise ValueError(f"values of the {name} channel lie from 0 to {top:g}")


def blend(a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """ratio of a and the rest of b, clipped to the type's range; integers are cut off."""
    return np.clip(ratio * a.astype(float) + (1 - ratio) * np.asarray(b, float), 0, _top(a)).astype(a.dtype)


def gray(x: np.ndarray) -> np.ndarray:
    check_image(x)
    y = np.tensordot(np.array([0.299, 0.587, 0.114]), x.astype(float), (0, 0))[None]
    return _as(y, x.dtype)


def rgb_to_hsv(x: np.ndarray) -> np.ndarray:
    """Hue 0-360 for floats and 0-255 for uint8 (full range), saturation and value in the type's range."""
    check_image(x)
    rgb = x.astype(float) / _top(x)
    v, low = rgb.max(axis=0), rgb.min(axis=0)
    d = v - low
    safe = np.where(d > 0, d, 1)
    r, g, b = rgb
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    hue = np.where(d > 0, np.mod(hue, 360), 0)
    s = np.where(v > 0, d / np.where(v > 0, v, 1), 0)
    if x.dtype == np.uint8:
        return np.stack([np.mod(np.rint(hue * 256 / 360), 256), np.rint(s * 255), np.rint(v * 255)]).astype(np.uint8)
    return np.stack([hue, s, v]).astype(np.float32)


def hsv_to_rgb(x: np.ndarray) -> np.ndarray:
    check_image(x, tops=(360.0, 1.0, 1.0))
    full = x.dtype == np.uint8
    h, s, v = x.astype(float)
    h, s, v = (h * 360 / 256, s / 255, v / 255) if full else (h, s, v)
    part = lambda n: v - v * s * np.clip(np.minimum(k := np.mod(n + h / 60, 6), 4 - k), 0, 1)
    y = np.stack([part(5), part(3), part(1)])
    return np.rint(y * 255).astype(np.uint8) if full else y.astype(np.float32)


def adjust_brightness(x: np.ndarray, factor: float) -> np.ndarray:
    return blend(x, np.zeros_like(x), factor)


def adjust_contrast(x: np.ndarray, factor: float) -> np.ndarray:
    return blend(x, np.full(x.shape, gray(x).astype(float).mean()), factor)


def adjust_saturation(x: np.ndarray, factor: float) -> np.ndarray:
    return blend(x, np.broadcast_to(gray(x), x.shape), factor)


def adjust_hue(x: np.ndarray, factor: float, modulus: float = 180.0) -> np.ndarray:
    """Turns hues by factor (-0.5 to 0.5) of a circle. Hues wrap at 180 as they always did; 360 is the whole circle."""
    if not -0.5 <= factor <= 0.5:
        raise ValueError("the hue factor lies in [-0.5, 0.5]")
    hsv = rgb_to_hsv(x)
    hue = np.mod(hsv[0].astype(float) + 360 * factor, modulus)
    hsv = np.stack([hue.astype(hsv.dtype), hsv[1], hsv[2]])
    return hsv_to_rgb(hsv)


def radial_frequencies(shape: tuple[int, ...], dims: tuple[int, ...], centred: bool) -> np.ndarray:
    """The length of each frequency vector over dims, with size 1 on all other axes."""
    total = np.zeros([1] * len(shape))
    for d in dims:
        f = np.fft.fftfreq(shape[d])
        f = np.fft.fftshift(f) if centred else f
        total = total + (f**2).reshape([-1 if k == d % len(shape) else 1 for k in range(len(shape))])
    return np.sqrt(total)


def pass_mask(radial: np.ndarray, cutoff: float, width: float = 0.1, slope: str = "linear", multiplier: float = 2.0, high: bool = False) -> np.ndarray:
    """1 in the pass band, 0 in the stop band; the bound scales with the largest frequency, the transition doesn't."""
    edge = (cutoff - width if high else cutoff + width) * radial.max()
    ramp = np.clip((radial - edge if high else edge - radial) / (width + 1e-8), 0, 1)
    return ramp ** {"gentle": 1 / multiplier, "steep": multiplier}.get(slope, 1.0)
