"""Pixels of png files from their bytes: whether a file is whole, its ink and colours, and parts cut out of it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a file begins; samples of a pixel by colour type; what is dark; the side of the sample for colours.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DARK, SIDE = 200, 32


def chunks(content: bytes) -> list[tuple[bytes, bytes]] | None:
    """The chunks of a file; None unless all their checksums hold and the end chunk is there."""
    if not content.startswith(SIGNATURE):
        return None
    found, at = [], len(SIGNATURE)
    while at + 12 <= len(content):
        (size,), kind = struct.unpack_from(">I", content, at), content[at + 4 : at + 8]
        data, end = content[at + 8 : at + 8 + size], at + 12 + size
        if end > len(content) or zlib.crc32(kind + data) != struct.unpack_from(">I", content, end - 4)[0]:
            return None
        found.append((kind, data))
        if kind == b"IEND":
            return found
        at = end
    return None


def unfiltered(data: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """``rows`` lines of ``width`` bytes from lines that say how they differ from their left and upper neighbours, ``step`` bytes apart."""
    lines, above = np.empty((rows, width), dtype=np.uint8), np.zeros(width, dtype=np.uint8)
    for i, line in enumerate(data.reshape(rows, width + 1)):
        kind, own = line[0], line[1:]
        if kind == 1:
            pixels = np.zeros(-(-width // step) * step, dtype=np.uint8)
            pixels[:width] = own
            own = np.cumsum(pixels.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            own = own + above
        elif kind in (3, 4):  # the left neighbour has to be known first
            out, up = own.tolist(), above.tolist()
            for x in range(width):
                a, b = out[x - step] if x >= step else 0, up[x]
                c = up[x - step] if x >= step else 0
                if kind == 3:
                    near = (a + b) >> 1
                else:
                    far = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                    near = (a, b, c)[far.index(min(far))]
                out[x] = (out[x] + near) & 255
            own = np.array(out, dtype=np.uint8)
        elif kind != 0:
            raise ValueError("unknown filter")
        lines[i] = above = own
    return lines


def decoded(content: bytes | None) -> np.ndarray | None:
    """Rows, columns, red-green-blue of a file; None if it is damaged, interlaced or no png. What is see-through counts as it is coloured."""
    found = chunks(content or b"")
    if not found or found[0][0] != b"IHDR" or len(found[0][1]) != 13:
        return None
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", found[0][1])
    if interlaced or colour not in SAMPLES or depth not in (1, 2, 4, 8, 16) or not width or not height:
        return None
    samples = SAMPLES[colour]
    line = -(-width * samples * depth // 8)
    try:
        data = np.frombuffer(zlib.decompress(b"".join(d for k, d in found if k == b"IDAT")), dtype=np.uint8)[: height * (line + 1)]
        lines = unfiltered(data, height, line, max(1, samples * depth // 8))
    except (zlib.error, ValueError):
        return None
    if depth == 16:
        lines = lines.reshape(height, -1, 2)[:, :, 0]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        lines = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        if colour == 0:
            lines = lines * (255 // ((1 << depth) - 1))
    values = lines[:, : width * samples].reshape(height, width, samples)
    if colour == 3:
        table = np.zeros((256, 3), dtype=np.uint8)
        own = np.frombuffer(next((d for k, d in found if k == b"PLTE"), b""), dtype=np.uint8).reshape(-1, 3)
        table[: len(own)] = own
        return table[values[:, :, 0]]
    return np.repeat(values[:, :, :1], 3, axis=2) if samples < 3 else values[:, :, :3]


def encoded(pixels: np.ndarray) -> bytes:
    """Red-green-blue pixels as a file."""
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), dtype=np.uint8), pixels.reshape(height, width * 3)], axis=1)
    made = ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in made)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Brightness by the usual weights of red, green and blue."""
    r, g, b = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 0x8000) >> 16


def sample(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """``side`` times ``side`` pixels: those in the middle of as many equal fields."""
    rows, columns = (((2 * np.arange(side) + 1) * n // (2 * side)) for n in pixels.shape[:2])
    return pixels[rows][:, columns].reshape(-1, 3)


def measured(images: DataFrame, content: str = "content") -> DataFrame:
    """``images`` with ``whole``, ``px_wide``, ``px_high``, ``ink`` and ``colours`` in place of their ``content``.

    whole is false for what is damaged or no png, and the others are null then. ink is the share of pixels darker than
    DARK, colours how many different ones a sample of SIDE times SIDE has. One picture at a time is unpacked.
    """
    names = [c for c in images.columns if c != content]
    inner = images.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{content}`").cast("binary").alias("_png"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.drop("_png").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(len(names)):
                pixels = decoded(value.as_py())
                if pixels is None:
                    found.append((False, None, None, None, None))
                else:
                    high, wide, _ = pixels.shape
                    found.append((True, wide, high, float((grey(pixels) < DARK).sum() / (high * wide)), len(np.unique(sample(pixels), axis=0))))
            own = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *own], names=[*names, "whole", "px_wide", "px_high", "ink", "colours"])

    return inner.mapInArrow(run, f"{schema}, whole boolean, px_wide int, px_high int, ink double, colours bigint")


def cropped(images: DataFrame) -> DataFrame:
    """``images(..., content, left, top, right, bottom)`` with ``content`` cut to the box, within the picture; null where that leaves nothing."""
    names = images.columns
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'content' else f.dataType.simpleString()}" for f in images.schema)

    def one(content: bytes | None, left: int | None, top: int | None, right: int | None, bottom: int | None) -> bytes | None:
        pixels = decoded(content) if None not in (left, top, right, bottom) else None
        if pixels is None:
            return None
        part = pixels[max(0, top) : max(0, bottom), max(0, left) : max(0, right)]
        return encoded(part) if part.size else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [names.index(c) for c in ("content", "left", "top", "right", "bottom")]
        for batch in batches:
            made = pa.array([one(*(v.as_py() for v in row)) for row in zip(*(batch.column(i) for i in at))], pa.binary())
            yield batch.set_column(at[0], "content", made)

    return images.mapInArrow(run, schema)
