"""Hashed word shingles and fast similarity sketches, vectorised over the bytes of a batch of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z count as a-z
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Key of the word hashes: shared by all tasks, so that results repeat. Who feeds texts from strangers sets one of their own.
KEY = b"sampleloom word hash"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each text's offsets (one more than texts); a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray, key: bytes = KEY) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z as a-z, and each text's offsets into them.

    Every different word goes through keyed BLAKE2b: words that collide can't be built from the structure of the hash, and without the key not at all.
    """
    if not len(data):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[:-1][np.diff(at) > 0]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    offsets = np.append(np.concatenate([[0], np.cumsum(inside)])[starts], inside.sum()).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
    hashes = b"".join([hashlib.blake2b(w, digest_size=8, key=key).digest() for w in words.dictionary.to_pylist()])
    return np.frombuffer(hashes, "<u8").astype(U)[words.indices.to_numpy()], np.searchsorted(starts, at)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of each text's shingles in text order, repeats too, and each text's offsets; fewer words than width make one, none make none."""
    words, at = word_hashes(*text_bytes(column))
    n, count = len(words), np.diff(at)
    rolled = words.copy()
    for k in range(1, width):
        rolled *= U(_BASE)
        rolled[: max(0, n - k)] += words[k:]
    rolled = mix(rolled)
    short = np.flatnonzero((count > 0) & (count < width))
    for k in short.tolist():
        h = U(count[k]) * np.ones(1, U)
        for w in words[at[k] : at[k + 1]]:
            h = h * U(_BASE) + w
        rolled[at[k]] = mix(h)[0]
    size = np.maximum(count - width + 1, np.minimum(count, 1))
    keep = np.zeros(n + 1, np.int64)  # the shingles of a text begin at its first `size` words
    full = np.flatnonzero(size)
    np.add.at(keep, at[:-1][full], 1)
    np.add.at(keep, at[:-1][full] + size[full], -1)
    return rolled[np.cumsum(keep[:n]) > 0], np.concatenate([[0], np.cumsum(size)])


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    values, at = shingles(column, width)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        x = np.sort(values[a:b])
        sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return sets


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches (Dahlgaard, Knudsen, Thorup 2017), a row of `size` coordinates for each set.

    Round i < size hashes every element to one bin with value i + [0, 1); round size + j puts every element into bin j,
    so 2 * size rounds fill each coordinate of a set that isn't empty. A set leaves when its bins are full: later values
    are larger. Equal coordinates have the Jaccard similarity as probability, concentrated as if they were independent.
    """
    out = np.full((len(sets), size), np.iinfo(U).max, U)
    flat = out.reshape(-1)
    live = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    elements = np.concatenate([sets[k] for k in live]) if len(live) else np.zeros(0, U)
    rows = np.repeat(live, [len(sets[k]) for k in live])
    for i in range(2 * size):
        if not len(live):
            break
        h = mix(elements + U((i * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1)))
        bins = ((h >> U(32)) * U(size) >> U(32)).astype(np.int64) if i < size else i - size
        value = (U(i) << U(48)) | (mix(h) >> U(16))
        np.minimum.at(flat, rows * size + bins, value)
        if i < 8 or i % 16 == 0 or i >= size:
            full = (out[live] != np.iinfo(U).max).all(axis=1)
            if full.any():
                live = live[~full]
                keep = np.zeros(len(sets), bool)
                keep[live] = True
                take = keep[rows]
                elements, rows = elements[take], rows[take]
    return out
