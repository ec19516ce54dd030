"""Linear maps of samples along some of their dims, as (index, weight) terms: products of maps, and one pass that applies a map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Inputs from which a map that takes every one of them for every output is a matrix product; shorter ones are summed term by term.
DENSE = 32


@dataclass(frozen=True, eq=False)
class AxisMap:
    """Output o along dims is add[o] and the sum of weight[o, k] * input[index[o, k]] for k < count[o], summed in this order.

    dims are the sample's, ascending; with several, index counts through all of them, row by row. `out` are their sizes
    afterwards. Terms of weight 0 are left out, so nothing comes of what lies behind them, NaN included.
    """

    dims: tuple[int, ...]
    out: tuple[int, ...]
    index: np.ndarray
    weight: np.ndarray
    count: np.ndarray
    add: np.ndarray

    def then(self, after: AxisMap) -> AxisMap:
        """This map and another along the same dims behind it, as one."""
        inner, terms = after.index, np.arange(after.index.shape[1]) < after.count[:, None]
        weight = np.where(terms, after.weight, 0)
        index = self.index[inner].reshape(len(inner), -1)
        used = (np.arange(self.index.shape[1]) < self.count[:, None])[inner] & terms[:, :, None]
        product = np.where(used, self.weight[inner] * weight[:, :, None], 0).reshape(len(inner), -1)
        return terms_of(self.dims, after.out, index, product, after.add + (weight * self.add[inner]).sum(axis=1))

    @property
    def dense(self) -> bool:
        n = len(self.index) and int(self.count.min())
        return n > DENSE and n == self.index.shape[1] and bool((self.index == np.arange(n)).all())

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The map on samples in double precision, stacked along a first axis."""
        behind = tuple(d + 1 for d in self.dims)
        last = tuple(range(-len(behind), 0))
        y = np.moveaxis(x, behind, last)
        left = y.shape[: y.ndim - len(behind)]
        y = y.reshape(*left, -1)
        if self.dense:
            out = y @ self.weight.T + self.add
        else:
            out = np.broadcast_to(self.add, (*left, len(self.add))).copy()
            for k in range(self.index.shape[1]):
                rows = np.flatnonzero(self.count > k)
                part = slice(None) if len(rows) == len(self.count) else rows
                out[..., part] += self.weight[rows, k] * y[..., self.index[rows, k]]
        return np.moveaxis(out.reshape(*left, *self.out), last, behind)

    def shape(self, shape: Sequence[int]) -> tuple[int, ...]:
        out = list(shape)
        for d, n in zip(self.dims, self.out, strict=True):
            out[d] = n
        return tuple(out)


def terms_of(dims: Sequence[int], out: Sequence[int], index: np.ndarray, weight: np.ndarray, add: np.ndarray | None = None) -> AxisMap:
    """A map of terms in any order: those of one input are added up, those that come to 0 go."""
    n = len(index)
    row = np.repeat(np.arange(n), index.shape[1])
    width = int(index.max(initial=0)) + 1
    keys, at = np.unique(row * width + index.ravel(), return_inverse=True)
    sums = np.bincount(at.ravel(), weight.ravel(), len(keys))
    keys, sums = keys[sums != 0], sums[sums != 0]
    row = keys // width
    count = np.bincount(row, minlength=n)
    place = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
    packed_index, packed_weight = np.zeros((n, int(count.max(initial=0))), np.int64), np.zeros((n, int(count.max(initial=0))))
    packed_index[row, place], packed_weight[row, place] = keys % width, sums
    return AxisMap(tuple(dims), tuple(out), packed_index, packed_weight, count, np.zeros(n) if add is None else add)


def product(maps: Sequence[AxisMap]) -> list[AxisMap]:
    """The maps in turn as fewer ones: maps along the same dims become one, past maps along others, with which they commute.

    A map that adds something commutes with none, so it goes past none and none past it.
    """
    done: list[AxisMap] = []
    for m in maps:
        k = len(done) - 1
        while k >= 0 and done[k].dims != m.dims and not set(done[k].dims) & set(m.dims) and not m.add.any() and not done[k].add.any():
            k -= 1
        if k >= 0 and done[k].dims == m.dims:
            done[k] = done[k].then(m)
        else:
            done.append(m)
    return done


def blur(dim: int, n: int, sigma: float, radius: int) -> AxisMap:
    """Gaussian weights of a fixed radius; the border is mirrored including its own sample."""
    k = np.arange(-radius, radius + 1)
    w = np.exp(-(k**2) / (2 * sigma**2))
    at = np.mod(np.arange(n)[:, None] + k, 2 * n)
    return terms_of((dim,), (n,), np.where(at >= n, 2 * n - 1 - at, at), np.tile(w / w.sum(), (n, 1)))


def resize(dim: int, n: int, size: int) -> AxisMap:
    """Linear interpolation of n samples at `size` places from the first to the last."""
    at = np.arange(size) * ((n - 1) / (size - 1)) if size > 1 else np.zeros(1)
    low = np.minimum(np.floor(at).astype(int), n - 1)
    return terms_of((dim,), (size,), np.stack([low, np.minimum(low + 1, n - 1)], axis=1), np.stack([1 - (at - low), at - low], axis=1))


def turn(dims: tuple[int, int], h: int, w: int, degrees: float, fill: float) -> AxisMap:
    """Rotation of an (h, w) plane about its centre, bilinear; `fill` outside."""
    t = np.deg2rad(degrees)
    r, c = (v.ravel() for v in np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij"))
    r, c = np.cos(t) * r + np.sin(t) * c + (h - 1) / 2, -np.sin(t) * r + np.cos(t) * c + (w - 1) / 2
    r, c = (np.where(np.abs(v - np.rint(v)) < 1e-9, np.rint(v), v) for v in (r, c))
    inside = (r >= 0) & (r <= h - 1) & (c >= 0) & (c <= w - 1)
    near_r, near_c = (np.floor(v).astype(int)[:, None] + np.array(d) for v, d in ((r, (0, 0, 1, 1)), (c, (0, 1, 0, 1))))
    weight = (1 - np.abs(r[:, None] - near_r)) * (1 - np.abs(c[:, None] - near_c)) * inside[:, None]
    return terms_of(dims, (h, w), np.clip(near_r, 0, h - 1) * w + np.clip(near_c, 0, w - 1), weight, np.where(inside, 0.0, fill))


def cosine(dim: int, n: int) -> AxisMap:
    """The unnormalised DCT-II."""
    k = np.arange(n)
    basis = 2 * np.cos(np.pi * k[:, None] * (2 * k + 1) / (2 * n))
    return AxisMap((dim,), (n,), np.tile(k, (n, 1)), basis, np.full(n, n), np.zeros(n))


def taken(dim: int, index: np.ndarray, fill: float) -> AxisMap:
    """A move along one dim: where each output comes from, -1 for fill."""
    return terms_of((dim,), (len(index),), np.maximum(index, 0)[:, None], (index >= 0).astype(float)[:, None], np.where(index >= 0, 0.0, fill))
