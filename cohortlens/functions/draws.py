"""Hashed draws in numpy, by the numbers that Spark's and SQL's own functions give."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws that are counted together, and slots that are hashed at once.
BLOCK, SLOTS = 4, 1 << 20
#: Places that a task counts at once; of more customers than this each window of places hashes all slots again.
WINDOW = 1 << 23
_TILE, _LOW = 1 << 15, 0xFFFFFFFF
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINE = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_word(words: list, size: int) -> np.ndarray:
    """The first four bytes of the md5 of one-block messages, as a number; words are numbers, or arrays where the messages differ."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):  # the last three rounds don't touch the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((_SINE[i] + words[g]) & _LOW)
        else:
            f += np.uint32(_SINE[i])
            f += words[g]
        np.left_shift(f, np.uint32(_TURN[i]), out=t)
        f >>= np.uint32(32 - _TURN[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(_START[0])
    return b.byteswap()


def md5_heads(draws: range, low: int, high: int, seed: int) -> np.ndarray:
    """(draw, slot): the first eight hex digits of md5("draw|slot|seed") as a number, for slots low to high - 1."""
    out = np.empty((len(draws), high - low), np.uint32)
    while low < high:
        digits = len(str(low))
        stop = min(high, 10**digits)
        number = np.arange(low, stop)
        text = np.stack([(number // 10 ** (digits - 1 - k) % 10 + 48).astype(np.uint8) for k in range(digits)])
        start = out.shape[1] - (high - low)
        for length in {len(str(b)) for b in draws}:
            size = length + 1 + digits
            tail = f"|{seed}".encode()
            first, last = (length + 1) // 4, (size - 1) // 4
            block = np.zeros((stop - low, 4 * (last - first + 1)), np.uint8)
            block[:, length + 1 - 4 * first : size - 4 * first] = text.T
            slots = {first + k: np.ascontiguousarray(w) for k, w in enumerate(block.view("<u4").T)}
            for row, b in enumerate(draws):
                if len(str(b)) != length:
                    continue
                fixed = f"{b}|".encode() + bytes(digits) + tail + b"\x80"
                if len(fixed) > 56:
                    raise ValueError("a key of an md5 draw has 55 bytes at most")
                fixed = np.frombuffer(fixed.ljust(56, b"\0") + (8 * (size + len(tail))).to_bytes(8, "little"), "<u4").tolist()
                for k in range(0, stop - low, _TILE):
                    n = min(_TILE, stop - low - k)
                    words = [slots[w][k : k + n] + np.uint32(fixed[w]) if w in slots else fixed[w] for w in range(16)]
                    out[row, start + k : start + k + n] = _first_word(words, n)
        low = stop
    return out


class _Heads:
    """The hashes of one block of draws; groups of the block one after another share those of the first slots."""

    def __init__(self, b: int, seed: int):
        self.b, self.seed, self.block, self.first = b, seed, None, None

    def of(self, block: int, low: int, high: int) -> np.ndarray:
        draws = range(block * BLOCK, min(self.b, (block + 1) * BLOCK))
        if low:
            return md5_heads(draws, low, high, self.seed)
        if self.block != block or self.first.shape[1] < high:
            step = max(256, 1 << max(0, high.bit_length() - 4))  # the next group may be a little larger
            self.block, self.first = block, md5_heads(draws, 0, min(SLOTS, -(-high // step) * step), self.seed)
        return self.first[:, :high]


def draw_counts(groups: DataFrame, b: int, seed: int, chunk: int, total: int) -> DataFrame:
    """(g, chunk, block, w): how often each of ``BLOCK`` draws takes each of ``chunk`` places, as bytes, or shorts beyond 255, draw by draw.

    Each draw of a group (g, n) fills n slots, and a slot takes the place that
    an md5 of (draw, slot, seed) gives modulo n. A task hashes some draws,
    the same slots once for all groups; what leaves it is a byte a place and draw. total, about the slots of a draw, only sets the number of tasks.
    """
    blocks = -(-b // BLOCK)
    tasks = min(blocks, max(groups.sparkSession.sparkContext.defaultParallelism, b * total // 20_000_000))
    windows = F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {WINDOW} as int)")))
    work = groups.sparkSession.range(0, blocks, 1, tasks).withColumnRenamed("id", "block").crossJoin(F.broadcast(groups.where("n > 0").select("g", "n", windows.alias("window"))))

    def count(batches):
        heads = _Heads(b, seed)
        for batch in batches:
            for block, g, n, window in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                start, places = window * WINDOW, min(WINDOW, n - window * WINDOW)
                chunks = -(-places // chunk)
                taken = None
                for low in range(0, n, SLOTS):
                    head = heads.of(block, low, min(n, low + SLOTS))
                    taken = np.zeros((len(head), chunks * chunk), np.uint16) if taken is None else taken
                    for row, h in enumerate(head):
                        # a whole division is several times faster than the remainder
                        at = h - h // np.uint32(n) * np.uint32(n) if n < 1 << 32 else h
                        if n > WINDOW:
                            at = at[(at >= start) & (at < start + places)] - np.uint32(start)
                        taken[row] += np.bincount(at, minlength=chunks * chunk).astype(np.uint16)
                kind = np.uint8 if taken.max() < 256 else np.uint16
                dealt = taken.astype(kind).reshape(len(taken), chunks, chunk).transpose(1, 0, 2)
                for k in range(0, chunks, 256):
                    part = np.ascontiguousarray(dealt[k : k + 256])
                    at = np.arange(len(part) + 1, dtype=np.int32) * part[0].nbytes
                    w = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at), pa.py_buffer(part)])
                    numbers = [np.full(len(part), g, np.int64), start // chunk + k + np.arange(len(part)), np.full(len(part), block, np.int64)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in numbers], w], names=["g", "chunk", "block", "w"])

    return work.select("block", "g", "n", "window").mapInArrow(count, "g long, chunk long, block long, w binary")


def weights_of(block: int, w: bytes, b: int, chunk: int) -> tuple[int, np.ndarray]:
    """The first draw of a row of ``draw_counts`` and its weights (draw, place of the chunk)."""
    draws = min(BLOCK, b - block * BLOCK)
    return block * BLOCK, np.frombuffer(w, np.uint8 if len(w) == draws * chunk else np.uint16).reshape(draws, chunk)


def _hash_int(value, seed) -> np.ndarray:
    """Spark's xxhash64 of 32-bit numbers, seeded by those before."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(4)) ^ (value * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def flipped_sums(values: np.ndarray, first: int, draws: int, seed: int) -> np.ndarray:
    """By pattern: the sum of values, numbered from first on, with signs from the lowest bit of xxhash64(pattern, number, seed): 1 is minus."""
    numbers = (first + np.arange(len(values))).astype(np.uint64)
    out = np.empty(draws)
    step = max(1, _TILE // max(1, len(values)))
    for k in range(0, draws, step):
        pattern = _hash_int(np.arange(k, min(draws, k + step), dtype=np.uint64), np.uint64(42))[:, None]  # 42 is where Spark starts
        bit = _hash_int(np.array([seed & _LOW], np.uint64), _hash_int(numbers, pattern)) & np.uint64(1)
        out[k : k + step] = values.sum() - 2 * (bit.astype(float) @ values)
    return out
