"""Operator 8: texts as PNG images in binary columns, with cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean_batches
from .kernels import pieces

#: A payload is padded to a positive multiple of this: the rows of the image.
ROW = 576
#: Fixed value: the first bytes of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = ROW, level: int = 1) -> bytes:
    """An 8-bit grey PNG of the payload's bytes, ``width`` a row, each row filtered by None or Sub, whichever is smaller."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub = image.copy()
    sub[:, 1:] -= image[:, :-1]
    cost = np.abs(sub.view(np.int8).astype(np.int16)).sum(axis=1)
    use = cost < np.abs(image.view(np.int8).astype(np.int16)).sum(axis=1)
    lines = np.empty((len(image), width + 1), np.uint8)
    lines[:, 0] = use
    lines[:, 1:] = np.where(use[:, None], sub, image)
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes):
    """(kind, body) of the chunks; a wrong signature, length or checksum raises ValueError."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("the file ends within a chunk")
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(png):
            raise ValueError("the file ends within a chunk")
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("no end chunk")


def unfilter(lines: np.ndarray, pixel: int = 1) -> np.ndarray:
    """The samples of filtered rows (filter number, then bytes); ``pixel`` bytes a pixel.

    Rows of the filters None, Sub and Up are undone whole; Average and Paeth
    depend on the pixel before and go pixel by pixel.
    """
    height, width = lines.shape[0], lines.shape[1] - 1
    out = np.empty((height, width), np.uint8)
    kinds = lines[:, 0]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    simple = kinds <= 1
    out[simple] = lines[simple, 1:]
    sub = kinds == 1
    if sub.any():
        out[sub] = np.cumsum(out[sub].reshape(int(sub.sum()), -1, pixel), axis=1, dtype=np.uint8).reshape(int(sub.sum()), width)
    before = np.zeros(width, np.uint8)
    for y in np.flatnonzero(~simple).tolist():
        above = out[y - 1] if y else before
        row = lines[y, 1:]
        if kinds[y] == 2:
            out[y] = row + above
            continue
        now = [0] * width
        up = above.tolist()
        for x, value in enumerate(row.tolist()):
            a = now[x - pixel] if x >= pixel else 0
            if kinds[y] == 3:
                guess = (a + up[x]) // 2
            else:
                c = up[x - pixel] if x >= pixel else 0
                p = a + up[x] - c
                pa_, pb, pc = abs(p - a), abs(p - up[x]), abs(p - c)
                guess = a if pa_ <= pb and pa_ <= pc else up[x] if pb <= pc else c
            now[x] = (value + guess) & 255
        out[y] = now
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG that isn't interlaced, by row; anything else raises ValueError."""
    data, head = [], None
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    raw = zlib.decompress(b"".join(data))
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def cosine_basis(n: int, k: int) -> np.ndarray:
    """The first k rows of the cosine transform of n values."""
    return np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


_BASIS = cosine_basis(32, 8)


def image_hash(image: np.ndarray) -> str:
    """64 bits in hex: the image shrunk to 32 x 32 means, the 8 x 8 lowest frequencies, each against their median."""
    h, w = image.shape
    rows = np.minimum(np.arange(32) * h // 32, h - 1)
    columns = np.arange(32) * w // 32
    sums = np.add.reduceat(np.add.reduceat(image, columns, axis=1, dtype=np.int64), np.unique(rows), axis=0)
    counts = np.diff(np.append(np.unique(rows), h))[:, None] * np.diff(np.append(columns, w))
    small = (sums / counts)[np.searchsorted(np.unique(rows), rows)]
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, media (PNG, binary) and n_bytes of every row of docs.

    A null text is an empty one, texts may be of any length that an array of
    bytes can have, repeated rows give equal media, and other columns aren't read.
    """
    lean_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def store(batches):
        for batch in pieces(batches, 1):
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            media = [encode_png(padded(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=["doc_id", "media", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(store, f"doc_id {id_type}, media binary, n_bytes long")


def padded(raw: bytes, row: int = ROW) -> bytes:
    """raw and bytes 255 up to a positive multiple of row."""
    return raw + b"\xff" * (max(row, -(-len(raw) // row) * row) - len(raw))


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and, read back from ``media``: its payload's size, hash and tail checksum, its own size and hash, its feature.

    Media that aren't whole 8-bit grey PNG files, null included, raise. Other columns aren't read.
    """
    lean_batches(media.sparkSession)
    id_type = media.schema["doc_id"].dataType.simpleString()
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches):
        for batch in pieces(batches, 1):
            rows = []
            for png in batch.column(1):
                png = png.as_py() or b""
                image = decode_png(png)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), image_hash(image)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in fields.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "media", "n_bytes").mapInArrow(read, f"doc_id {id_type}, n_bytes long, {fields}")


def media_digest(docs: DataFrame) -> DataFrame:
    return read_media(store_media(docs))
