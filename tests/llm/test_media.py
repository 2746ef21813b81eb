import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import media
from tests.llm import cases


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000), st.integers(2, 7))
def test_round_trip(data, level):
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload.startswith(data)
    samples, channels = media.read_png(media.write_png(payload, level=level))
    assert samples.tobytes() == payload and channels == 1


@pytest.mark.parametrize("colour, step", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_filter_is_undone(colour, step):
    rng = np.random.default_rng(colour)
    rows = rng.integers(0, 256, (11, 5 * step)).astype(np.int64)
    lines = []
    for y, row in enumerate(rows):
        above = rows[y - 1] if y else np.zeros_like(row)
        kind = y % 5
        out = []
        for x, value in enumerate(row):
            left, up, corner = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            out.append((value - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        lines.append(bytes([kind, *out]))
    image = media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 11, 8, colour, 0, 0, 0)) + media.chunk(b"IDAT", zlib.compress(b"".join(lines))) + media.chunk(b"IEND", b"")
    samples, channels = media.read_png(image)
    assert channels == step and (samples == rows).all()


def test_damage_is_found():
    image = media.write_png(media.padded(b"hello"))
    for at in range(8, len(image)):
        bad = bytearray(image)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            media.read_png(bytes(bad))
    with pytest.raises(ValueError):
        media.read_png(image[:-3])


def test_hash_is_stable_under_small_changes():
    rng = np.random.default_rng(1)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((40, 72))).astype(np.uint8)
    near = np.clip(image.astype(int) + rng.integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    far = np.kron(rng.integers(0, 256, (8, 8)), np.ones((40, 72))).astype(np.uint8)
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    h = media.cosine_hash(image)
    assert bits(h, media.cosine_hash(near)) <= 4 < 12 < bits(h, media.cosine_hash(far))


@pytest.mark.parametrize("height", [1, 3, 31, 32, 50])
def test_hash_is_that_of_a_plain_transform(height):
    samples = np.random.default_rng(height).integers(0, 256, (height, 576)).astype(np.uint8)
    cell = lambda size, k: range(k * size // 32, max((k + 1) * size // 32, k * size // 32 + 1))
    small = [[np.mean([float(samples[y, x]) for y in cell(height, i) for x in cell(576, j)]) for j in range(32)] for i in range(32)]
    wave = lambda f, at: np.cos(np.pi / 32 * (at + 0.5) * f)
    low = [round(sum(small[i][j] * wave(f, i) * wave(g, j) for i in range(32) for j in range(32)), 6) for f in range(8) for g in range(8)]
    middle = float(np.median(low[1:]))
    assert media.cosine_hash(samples) == f"{int(''.join(str(int(x > middle)) for x in low), 2):016x}"


def test_a_table(spark):
    got = media.media_columns(cases.frame(spark)).collect()
    want = sorted((r[0] if r[0] is not None else -1, hashlib.sha256(media.padded((r[1] or "").encode())).hexdigest()) for r in cases.rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.payload_sha256) for r in got) == want
    for r in got:
        samples, _ = media.read_png(bytes(r.media))
        assert r.media_bytes == len(r.media) and r.tail_crc32 == zlib.crc32(samples.tobytes()[-32:]) and hashlib.sha256(r.media).hexdigest() == r.media_sha256
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media.media_columns(cases.empty(spark)).count() == 0
