"""Audio containers: WAV with whole or floating numbers, and FLAC, to arrays of samples; a small FLAC writer."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence

import numpy as np

_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


def read_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """(samples, channels) of a RIFF WAVE file, and its rate: int16 or int32 (8 and 24 bits move up), or the floats that it has."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == _EXTENSIBLE and len(body) >= 26:  # the real code opens the 16 bytes of the sub-format
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            return _wav_samples(body, form), form[2]
        at += 8 + size + size % 2
    raise ValueError("no samples in the file")


def _wav_samples(body: bytes, form: tuple) -> np.ndarray:
    code, channels, _, _, _, bits = form
    width = -(-bits // 8)
    if channels < 1 or (code, width) not in {(_PCM, 1), (_PCM, 2), (_PCM, 3), (_PCM, 4), (_FLOAT, 4), (_FLOAT, 8)}:
        raise ValueError(f"no WAVE format {code} of {bits} bits")
    body = body[: len(body) // (width * channels) * width * channels]
    if code == _FLOAT:
        x = np.frombuffer(body, f"<f{width}")
    elif width == 3:  # the three bytes are the upper ones of four
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel()
    else:
        x = np.frombuffer(body, {1: "u1", 2: "<i2", 4: "<i4"}[width])
        x = (x.astype(np.int16) - 128) << 8 if width == 1 else x
    return x.reshape(-1, channels)


def write_wav(x: np.ndarray, rate: int) -> bytes:
    """A WAVE file of (samples, channels): int16 or int32, or floats of 4 or 8 bytes."""
    x = np.asarray(x)
    code, width = _FLOAT if x.dtype.kind == "f" else _PCM, x.dtype.itemsize
    if x.dtype.name not in ("int16", "int32", "float32", "float64"):
        raise ValueError(f"no WAVE format for {x.dtype}")
    body = x.astype(x.dtype.newbyteorder("<")).tobytes()
    form = struct.pack("<HHIIHH", code, x.shape[1], rate, rate * width * x.shape[1], width * x.shape[1], 8 * width)
    chunks = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


class _Bits:
    """Big-endian bits of a buffer, most significant first."""

    def __init__(self, raw: bytes, at: int) -> None:
        self.raw, self.at = raw, 8 * at

    def read(self, n: int) -> int:
        first, end = self.at >> 3, (self.at + n + 7) >> 3
        if end > len(self.raw):
            raise ValueError("the stream ends early")
        word = int.from_bytes(self.raw[first:end])
        self.at += n
        return word >> (8 * end - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        """Zeros before the next one, which is read too."""
        n = 0
        while not (word := self.read(step := min(32, 8 * len(self.raw) - self.at))):
            if not step:
                raise ValueError("the stream ends early")
            n += step
        zeros = step - word.bit_length()
        self.at -= step - zeros - 1
        return n + zeros


def _crc(data: bytes, poly: int, bits: int) -> int:
    table, top, mask = _crc_table(poly, bits), bits - 8, (1 << bits) - 1
    crc = 0
    for b in data:
        crc = (crc << 8 & mask) ^ table[(crc >> top) ^ b]
    return crc


def _crc_table(poly: int, bits: int, known: dict = {}) -> list[int]:  # noqa: B006  one table for each polynomial
    if (poly, bits) not in known:
        table = []
        for k in range(256):
            v = k << (bits - 8)
            for _ in range(8):
                v = (v << 1) ^ (poly if v >> (bits - 1) else 0)
            table.append(v & ((1 << bits) - 1))
        known[poly, bits] = table
    return known[poly, bits]


_CRC8, _CRC16 = (0x07, 8), (0x8005, 16)


def _residual(bits: _Bits, size: int, order: int) -> list[int]:
    """Rice-coded differences from the prediction, in partitions with a parameter each."""
    wide = {0: 4, 1: 5}.get(bits.read(2))
    if wide is None:
        raise ValueError("an unknown residual coding")
    parts = 1 << bits.read(4)
    out: list[int] = []
    for k in range(parts):
        n, rice = size // parts - (order if k == 0 else 0), bits.read(wide)
        if rice == (1 << wide) - 1:
            raw = bits.read(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            v = bits.unary() << rice | bits.read(rice)
            out.append(v >> 1 ^ -(v & 1))
    return out


#: The coefficients of FLAC's fixed predictors, latest sample first.
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _subframe(bits: _Bits, size: int, depth: int) -> list[int]:
    if bits.read(1):
        raise ValueError("a subframe is damaged")
    kind, wasted = bits.read(6), bits.read(1)
    if wasted:
        wasted += bits.unary()
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out, shift, weights = [bits.signed(depth) for _ in range(order)], 0, _FIXED[order] if kind < 32 else []
        if kind >= 32:
            precision, shift = bits.read(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, size, order):
            past = out[: -order - 1 : -1] if order else ()
            out.append(r + (sum(map(int.__mul__, weights, past)) >> shift))
    else:
        raise ValueError("an unknown kind of subframe")
    return [v << wasted for v in out] if wasted else out


def read_flac(raw: bytes) -> tuple[np.ndarray, int]:
    """(samples, channels) of a FLAC file, and its rate: int16 up to 16 bits, else int32; fewer bits move up.

    The check sums of headers and frames and, where the file has it, the MD5 of the samples must agree.
    """
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(raw):
            raise ValueError("the stream ends early")
        head = int.from_bytes(raw[at : at + 4])
        last, kind, size = head >> 31, head >> 24 & 127, head & 0xFFFFFF
        if kind == 0:
            info = _Bits(raw, at + 4 + 10)
        at += 4 + size
    if info is None:
        raise ValueError("no stream information")
    rate, channels, depth, total, digest = info.read(20), info.read(3) + 1, info.read(5) + 1, info.read(36), info.read(128)
    blocks, n = [], 0
    while at < len(raw) and (not total or n < total):
        found, at = _frame(raw, at, depth)
        if len(found) != channels:
            raise ValueError("a frame has other channels than the stream")
        blocks.append(np.array(found, np.int64).T)
        n += len(blocks[-1])
    x = np.concatenate(blocks) if blocks else np.zeros((0, channels), np.int64)
    if total and n != total:
        raise ValueError("the stream ends early")
    width = -(-depth // 8)
    packed = np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    if digest and hashlib.md5(packed).digest() != digest.to_bytes(16):
        raise ValueError("the samples' MD5 differs")
    kind = np.int16 if depth <= 16 else np.int32
    return (x << (np.iinfo(kind).bits - depth)).astype(kind), rate


def _frame(raw: bytes, at: int, depth: int) -> tuple[list[list[int]], int]:
    bits = _Bits(raw, at)
    if bits.read(14) != 0x3FFE or bits.read(1):
        raise ValueError("no frame where one should begin")
    bits.read(1)
    size, rate, layout, width = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    bits.read(1)
    lead = bits.read(8)  # the frame's number, as long as UTF-8 says
    for _ in range(max(0, 7 - (lead ^ 0xFF).bit_length() if lead >= 0xC0 else 0)):
        bits.read(8)
    if size in (6, 7):
        size = bits.read(8 * (size - 5)) + 1
    else:
        size = 192 if size == 1 else 576 << size - 2 if 2 <= size <= 5 else 256 << size - 8 if size >= 8 else 0
    bits.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
    if _crc(raw[at : bits.at >> 3], *_CRC8) != bits.read(8):
        raise ValueError("a frame's header is damaged")
    depth = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(width, 0)
    if not size or not depth or layout > 10:
        raise ValueError("an unknown kind of frame")
    side = {8: 1, 9: 0, 10: 1}.get(layout)
    out = [_subframe(bits, size, depth + (k == side)) for k in range(layout + 1 if layout < 8 else 2)]
    end = (bits.at + 7) // 8
    if _crc(raw[at:end], *_CRC16) != int.from_bytes(raw[end : end + 2]) or end + 2 > len(raw):
        raise ValueError("a frame is damaged")
    if layout == 8:
        out[1] = [a - b for a, b in zip(*out, strict=True)]
    elif layout == 9:
        out[0] = [a + b for a, b in zip(*out, strict=True)]
    elif layout == 10:
        mid = [m << 1 | s & 1 for m, s in zip(*out, strict=True)]
        out = [[m + s >> 1 for m, s in zip(mid, out[1], strict=True)], [m - s >> 1 for m, s in zip(mid, out[1], strict=True)]]
    return out, end + 2


class _Writer:
    def __init__(self) -> None:
        self.bits: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.bits.append(format(value & (1 << n) - 1, f"0{n}b"))

    def bytes(self) -> bytes:
        text = "".join(self.bits)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8) if text else b""


def write_flac(x: np.ndarray, rate: int, depth: int = 16, block: int = 4096, order: int = 1, weights: Sequence[int] | None = None, shift: int = 0) -> bytes:
    """A FLAC file of (samples, channels) whole numbers: channels apart, a fixed predictor of an order or one with given weights, Rice-coded."""
    if not len(x) or not 1 <= x.shape[1] <= 8:
        raise ValueError("a FLAC file has samples of one to eight channels")
    values, width = np.asarray(x, np.int64), -(-depth // 8)
    digest = hashlib.md5(np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest()
    head = _Writer()
    for v, n in ((block, 16), (block, 16), (0, 24), (0, 24), (rate, 20), (x.shape[1] - 1, 3), (depth - 1, 5), (len(x), 36)):
        head.put(v, n)
    out = [b"fLaC", (1 << 31 | 34).to_bytes(4), head.bytes() + digest]
    for number, a in enumerate(range(0, len(x), block)):
        out.append(_frame_bytes(values[a : a + block], number, depth, order, weights, shift))
    return b"".join(out)


def _frame_bytes(x: np.ndarray, number: int, depth: int, order: int, weights: Sequence[int] | None, shift: int) -> bytes:
    w = _Writer()
    for v, n in ((0x3FFE, 14), (0, 2), (7, 4), (0, 4), (x.shape[1] - 1, 4), (0, 3), (0, 1)):
        w.put(v, n)
    head = w.bytes() + chr(number).encode() + (len(x) - 1).to_bytes(2)
    w = _Writer()
    for row in x.T.tolist():
        own = min(len(weights) if weights else order, len(row) - 1)
        used = list(weights)[:own] if weights else _FIXED[own]
        w.put(0, 1)
        w.put(31 + own if weights and own else 8 + own, 6)
        w.put(0, 1)
        for v in row[:own]:
            w.put(v, depth)
        if weights and own:
            w.put(14, 4)
            w.put(shift, 5)
            for v in used:
                w.put(v, 15)
        rest = [row[k] - (sum(map(int.__mul__, used, row[k - own : k][::-1])) >> (shift if weights else 0)) for k in range(own, len(row))]
        folded = [2 * v if v >= 0 else -2 * v - 1 for v in rest]
        rice = min(14, max(0, int(np.mean(folded)).bit_length() - 1)) if folded else 0
        w.put(0, 2)
        w.put(0, 4)
        w.put(rice, 4)
        for v in folded:
            w.bits.append("0" * (v >> rice) + "1")
            w.put(v, rice)
    body = head + bytes([_crc(head, *_CRC8)]) + w.bytes()
    return body + _crc(body, *_CRC16).to_bytes(2)
