"""Audio containers: WAV of all sample formats and FLAC, exact values and damaged files."""

import struct

import numpy as np
import pytest

from sampleloom.sources.audio import read_flac, read_wav, write_flac
from sampleloom.sources.media import decode_audio, read_audio


def wav(x, code, bits, rate=22050, extensible=False, extra=b""):
    """A WAVE file of (samples, channels); `extra` chunks stand before the samples."""
    body = {(1, 8): lambda: (x + 128).astype("u1"), (1, 16): lambda: x.astype("<i2"), (1, 32): lambda: x.astype("<i4"), (3, 32): lambda: x.astype("<f4"), (3, 64): lambda: x.astype("<f8")}.get((code, bits))
    raw = body().tobytes() if body else np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    width = bits // 8
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else code, x.shape[1], rate, rate * width * x.shape[1], width * x.shape[1], bits)
    if extensible:
        form += struct.pack("<HHI", 22, bits, 3) + struct.pack("<H", code) + bytes.fromhex("000000001000800000aa00389b71")
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + extra + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


RNG = np.random.default_rng(5)


@pytest.mark.parametrize("extensible", [False, True])
@pytest.mark.parametrize("code,bits", [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_wav(code, bits, extensible):
    x = RNG.uniform(-1, 1, (50, 2)) if code == 3 else RNG.integers(-(2 ** (bits - 1)), 2 ** (bits - 1), (50, 2))
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"  # an odd chunk is padded
    got, rate = read_wav(wav(x, code, bits, 8000, extensible, odd))
    want = x.astype(f"f{bits // 8}") if code == 3 else x << (16 if bits <= 16 else 32) - bits
    assert rate == 8000 and got.shape == (50, 2) and (got == want).all()


@pytest.mark.parametrize("raw", [b"", b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WAVEdata\0\0\0\0", wav(np.zeros((4, 1)), 1, 16).replace(b"fmt \x10\0\0\0\x01", b"fmt \x10\0\0\0\x55")])
def test_wav_that_cant_be_read(raw):
    with pytest.raises(ValueError):
        read_wav(raw)


@pytest.mark.parametrize("depth", [8, 12, 16, 20, 24, 32])
@pytest.mark.parametrize("order", [0, 1, 2, 3, 4])
def test_flac_fixed(depth, order):
    top = 2 ** (depth - 1)
    x = np.clip(np.cumsum(RNG.normal(0, top / 200, (1000, 2)), axis=0), -top, top - 1).astype(np.int64)
    got, rate = read_flac(write_flac(x, 44100, depth, block=300, order=order))
    assert rate == 44100 and (got == x << (16 if depth <= 16 else 32) - depth).all()


def test_flac_predicted():
    x = (10000 * np.sin(np.arange(500) / 9)).astype(np.int64)[:, None]
    raw = write_flac(x, 8000, 16, 128, weights=[7900, -3950], shift=12)
    assert (read_flac(raw)[0] == x).all() and len(raw) < 1000


def test_flac_extremes():
    x = np.array([[-(2**15)], [2**15 - 1]] * 40)
    assert (read_flac(write_flac(x, 8000, 16, 16, order=4))[0] == x).all()
    one = np.array([[7]])
    assert (read_flac(write_flac(one, 8000, 16))[0] == one).all()


def frame(parts, layout, size, depth=16):
    """A stream of one frame whose subframes are given as bits."""
    from sampleloom.sources.audio import _CRC8, _CRC16, _crc, _Writer

    w = _Writer()
    for v, n in ((size, 16), (size, 16), (0, 48), (8000, 20), (1 if layout > 7 else layout, 3), (depth - 1, 5), (size, 36), (0, 128)):
        w.put(v, n)
    h = _Writer()
    for v, n in ((0x3FFE, 14), (0, 2), (6, 4), (0, 4), (layout, 4), (4, 3), (0, 1), (0, 8), (size - 1, 8)):
        h.put(v, n)
    head = h.bytes()
    b = _Writer()
    b.bits += parts
    body = head + bytes([_crc(head, *_CRC8)]) + b.bytes()
    return b"fLaC" + (1 << 31 | 34).to_bytes(4) + w.bytes() + body + _crc(body, *_CRC16).to_bytes(2)


def verbatim(values, depth, wasted=0):
    bits = "0000001" + (("1" + "0" * (wasted - 1) + "1") if wasted else "0")
    return bits + "".join(format((v >> wasted) & (1 << depth - wasted) - 1, f"0{depth - wasted}b") for v in values)


@pytest.mark.parametrize("layout", [8, 9, 10])
def test_flac_stereo_decorrelation(layout):
    left, right = RNG.integers(-(2**15), 2**15, (2, 20)).tolist()
    side = [a - b for a, b in zip(left, right)]
    first, second = {8: (verbatim(left, 16), verbatim(side, 17)), 9: (verbatim(side, 17), verbatim(right, 16)), 10: (verbatim([(a + b) >> 1 for a, b in zip(left, right)], 16), verbatim(side, 17))}[layout]
    got, _ = read_flac(frame([first, second], layout, 20))
    assert got[:, 0].tolist() == left and got[:, 1].tolist() == right


def test_flac_constant_wasted_and_escaped():
    assert (read_flac(frame(["00000000" + format(5, "016b")], 0, 30))[0] == 5).all()
    even = (RNG.integers(-1000, 1000, 30) * 8).tolist()
    assert read_flac(frame([verbatim(even, 16, 3)], 0, 30))[0][:, 0].tolist() == even
    escaped = "00010000" + "00" + "0000" + "1111" + "01010" + "".join(format(v & 1023, "010b") for v in range(-15, 15))
    assert read_flac(frame([escaped], 0, 30))[0][:, 0].tolist() == list(range(-15, 15))


def test_damaged_flac():
    raw = write_flac(RNG.integers(-100, 100, (600, 1)), 8000, 16, 200)
    for k in range(42, len(raw), 37):
        with pytest.raises(ValueError):
            read_flac(raw[:k] + bytes([raw[k] ^ 1]) + raw[k + 1 :])
        with pytest.raises(ValueError):
            read_flac(raw[:k])
    with pytest.raises(ValueError):
        read_flac(b"fLaC")


def test_folders_of_both(spark, tmp_path):
    x = RNG.integers(-(2**15), 2**15, (64, 1))
    (tmp_path / "a.flac").write_bytes(write_flac(x, 22050))
    (tmp_path / "b.wav").write_bytes(wav(x, 1, 16))
    (tmp_path / "c.wav").write_bytes(wav(x / 2**15, 3, 32))
    (tmp_path / "d.wav").write_bytes(b"RIFF")
    got = {r.path[-6:]: r for r in read_audio(spark, str(tmp_path), 64).collect()}
    assert got["a.flac"[-6:]].data == got["/b.wav"].data == x[:, 0].astype(float).tolist()
    assert np.abs(np.array(got["/c.wav"].data) - x[:, 0]).max() <= 1 and got["/d.wav"].error
    assert decode_audio(wav(np.array([[2.0], [-2.0], [0.5]]), 3, 64), 3).tolist() == [[32767, -32767, 16383]]  # beyond full scale is clipped
