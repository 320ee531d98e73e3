"""Operator 5, media columns: texts as PNG images in binary columns, read back and hashed.

A payload (UTF-8 bytes, filled with 255 to a positive multiple of WIDTH) becomes an 8-bit grey
PNG of WIDTH columns: signature, IHDR, IDAT chunks of zlib data, IEND, each with its CRC-32.
Reading tests the signature, the order, lengths and checksums of the chunks, inflates, and undoes
the row filters with numpy (whole runs of rows at once for none, sub and up; average and Paeth
row by row). The feature is a 64-bit hash of the signs of low-frequency cosine-transform terms
of the image, scaled to SIDE x SIDE by area means.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.common import fields, tidy, utf8

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 576
#: Bytes of compressed data in one IDAT chunk.
CHUNK = 1 << 16
SIDE, LOW = 32, 8


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A grey PNG of rows of WIDTH bytes; each row has the filter of least absolute residue."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    forms = np.stack([image, sub, up])
    cost = np.minimum(forms, 256 - forms.astype(np.uint16)).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    rows = np.empty((len(image), WIDTH + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = forms[best, np.arange(len(image))]
    packed = zlib.compress(rows.tobytes(), level)
    header = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return SIGNATURE + _chunk(b"IHDR", header) + b"".join(parts) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The image of an 8-bit grey, not interlaced PNG; ValueError where a test fails."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, size, ended = 8, [], None, False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise ValueError("bytes outside chunks")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(body) != n or len(crc) != 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum or length in {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, method, filters, interlace) != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit grey without interlace")
            size = height, width
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if size is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != size[0] * (size[1] + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(size[0], size[1] + 1))


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the filters (first byte of each row) of one-byte samples."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown filter")
    edges = np.flatnonzero(np.diff(kinds, prepend=255, append=255))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        kind = kinds[low]
        if kind == SUB:
            np.cumsum(out[low:high], axis=1, dtype=np.uint8, out=out[low:high])
        elif kind == UP:
            first = max(low - 1, 0)
            np.cumsum(out[first:high], axis=0, dtype=np.uint8, out=out[first:high])
        elif kind in (AVERAGE, PAETH):
            for y in range(low, high):
                above = out[y - 1].tolist() if y else [0] * out.shape[1]
                out[y] = _row(out[y].tolist(), above, kind == PAETH)
    return out


def _row(row: list[int], above: list[int], paeth: bool) -> list[int]:
    left = corner = 0
    for x, up in enumerate(above):
        if paeth:
            guess = left + up - corner
            near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
        else:
            near = (left + up) // 2
        left, corner = (row[x] + near) & 255, up
        row[x] = left
    return row


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


COSINES = _cosines()


def cosine_hash(image: np.ndarray) -> bytes:
    """8 bytes: which of the LOW x LOW low-frequency terms exceed their median (the mean term aside)."""
    across = image.reshape(len(image), SIDE, -1).mean(2)
    n = len(across)
    if n >= SIDE:
        edges = np.arange(SIDE + 1) * n // SIDE
        small = np.add.reduceat(across, edges[:-1]) / np.diff(edges)[:, None]
    else:
        small = across[np.arange(SIDE) * n // SIDE]
    terms = (COSINES @ small @ COSINES.T).round(6).ravel()
    return np.packbits(terms > np.median(terms[1:])).tobytes()


SCHEMA = "n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, cosine_hash binary"


def media_columns(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """For each row its `keys` and, from the text: media (PNG), what is read back from it, and its hash.

    payload_sha256 and tail_crc32 (of the last 32 bytes) are of the payload that decoding the PNG
    gave. Null text counts as empty: a payload of WIDTH bytes 255. Equal texts give equal values.
    Rows are independent: no shuffle, one row in memory beyond the Arrow batch. Only `keys` and
    the text are read, so other columns cannot clash.
    """
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                data, offsets = utf8(part.column(len(keys)))
                data = data.tobytes()
                rows = [one(data[offsets[i] : offsets[i + 1]]) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *map(pa.array, zip(*rows, strict=True))], names=names)

    names = [*keys, *(x.split()[0] for x in SCHEMA.split(", "))]
    return df.select(*keys, df[text]).mapInArrow(tidy(convert), fields(df, keys, SCHEMA))


def one(text: bytes) -> tuple:
    media = encode_png(payload_of(text))
    image = decode_png(media)
    back = image.tobytes()
    return len(text), media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), cosine_hash(image)
