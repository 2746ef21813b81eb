"""Binary media columns: payloads stored as PNG images, read back with checksum tests, and hashed by low frequencies.

A payload becomes an 8-bit greyscale image of `WIDTH` columns: rows are filtered (none, sub or up, whichever leaves the
smaller residue), deflated and framed in chunks with CRC-32. The reader tests the signature, every chunk's CRC and the
stream's own checksum, and undoes all five filters with numpy. It reads the table that the images were written to. The feature is a 64-bit hash of the signs of the image's
8 x 8 lowest cosine-transform frequencies against their median. All work is within a row, so nothing is shuffled.

Null text is an empty payload, padded like any other to one row of 255s; equal texts give equal values; an empty table
gives an empty result; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import slices, written

#: Samples in an image row; payloads are padded to whole rows.
WIDTH = 576
PAD = 255
LEVEL = 4

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, RGB, GREY_ALPHA, RGBA = 0, 2, 4, 6
CHANNELS = {GREY: 1, RGB: 3, GREY_ALPHA: 2, RGBA: 4}
NONE, SUB, UP, AVERAGE, PAETH = range(5)

_SIDE, _LOW = 32, 8
_COSINE = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5)[None, :] * np.arange(_LOW)[:, None]).astype(np.float64)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(payload: bytes, width: int = WIDTH) -> bytes:
    """`payload` with bytes 255 up to a positive multiple of `width`."""
    return payload + bytes([PAD]) * (-len(payload) % width if payload else width)


def write_png(samples: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """A greyscale image of whole rows of 8-bit samples."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    residue = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (rows, sub, up)])
    kind = residue.argmin(0).astype(np.uint8)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.where((kind == SUB)[:, None], sub, np.where((kind == UP)[:, None], up, rows))
    header = struct.pack(">IIBBBBB", width, len(rows), 8, GREY, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at = 8
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", image, at)
        kind, data, end = image[at + 4 : at + 8], image[at + 8 : at + 8 + size], at + 12 + size
        if end > len(image) or zlib.crc32(image[at + 4 : at + 8 + size]) != struct.unpack_from(">I", image, end - 4)[0]:
            raise ValueError(f"chunk {kind!r}: checksum failed")
        yield kind, data
        at = end


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters; `step` is the bytes of a pixel. Runs of rows with one filter are undone together."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    height, width = rows.shape
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if height else np.array([], np.int64)
    above = np.zeros(width, np.uint8)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), height], strict=True):
        kind, part = kinds[a], rows[a:b]
        if kind == SUB:
            part[:] = np.cumsum(part.reshape(b - a, -1, step), axis=1, dtype=np.uint8).reshape(b - a, width)
        elif kind == UP:
            part[0] += above
            part[:] = np.cumsum(part, axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for row in part:
                _sequential(row, above, step, kind == PAETH)
                above = row
        elif kind != NONE:
            raise ValueError(f"unknown row filter {kind}")
        above = part[-1]
    return rows


def _sequential(row: np.ndarray, above: np.ndarray, step: int, paeth: bool) -> None:
    """The two filters whose bytes need the byte before them, in place."""
    line, over = row.tolist(), above.tolist()
    for i in range(len(line)):
        left, up = (line[i - step] if i >= step else 0), over[i]
        if paeth:
            corner = over[i - step] if i >= step else 0
            near = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
        else:
            near = (left + up) // 2
        line[i] = (line[i] + near) & 255
    row[:] = line


def read_png(image: bytes) -> tuple[np.ndarray, int]:
    """The samples, a row of the array for each of the image, and the channels. Raises ValueError if a test fails."""
    header, data, ended = None, [], False
    for kind, part in chunks(image):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
        ended = kind == b"IEND"
    if header is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, colour, _, _, interlaced = header
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError("only 8-bit images without palette or interlacing are read")
    channels = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if len(raw) != height * (width * channels + 1):
        raise ValueError("image data has another size than the header says")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, -1), channels), channels


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits; the image is first averaged down (or its rows repeated) to 32 x 32."""
    height, width = samples.shape
    columns = np.add.reduceat(samples, np.arange(_SIDE) * width // _SIDE, axis=1, dtype=np.float64) / np.diff(np.r_[np.arange(_SIDE) * width // _SIDE, width])
    if height >= _SIDE:
        edges = np.arange(_SIDE) * height // _SIDE
        square = np.add.reduceat(columns, edges, axis=0) / np.diff(np.r_[edges, height])[:, None]
    else:
        square = columns[np.arange(_SIDE) * height // _SIDE]
    low = np.round(_COSINE @ square @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def stored(docs: DataFrame, width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes of the text, and the PNG in the binary column `media`."""
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = batch.column(1).to_pylist()
            images = [write_png(padded(x, width), width, level) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(images, pa.binary())], [k for k, _ in kinds])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return narrow.mapInArrow(drawn, "doc_id long, n_bytes long, media binary")


def read_back(images: DataFrame) -> DataFrame:
    """Per row of `images` (doc_id, n_bytes, media): what its PNG says once its chunks are tested and its filters undone."""
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in kinds]
            for doc_id, n, image in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                samples, _ = read_png(image)
                back = samples.tobytes()
                row = (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, (_, t) in zip(out, kinds, strict=True)), batch.column(2)], [*(k for k, _ in kinds), "media"])

    return images.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")


def media_columns(docs: DataFrame, width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """Texts are stored as PNG in a table with a binary column; what is returned is read back from that table."""
    return read_back(written(stored(docs, width, level), "media"))
