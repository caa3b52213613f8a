"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel works on a whole Arrow batch: the UTF-8 bytes of all texts lie in
one buffer, so words and lines of thousands of documents are found and hashed
by a handful of numpy passes, with memory proportional to the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
WORD = np.zeros(256, bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[128:] = True
#: White space ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: bytes.translate table: lower-case A-Z, anything that is no word byte becomes a space.
WORD_TABLE = bytes(int(LOWER[b]) if WORD[LOWER[b]] else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of the texts in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


#: Spans up to this many bytes are hashed eight bytes at a time for all spans together, longer ones one by one.
CHUNKED = 512


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the spans data[starts:ends]; equal bytes, equal hash, wherever they lie.

    Each eight bytes pass through a non-linear mix together with the state so
    far, so no algebraic relation of bytes and places cancels out.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) * _P + np.uint64(seed))
    # eight bytes from every place on, as one number; a copy with room at the end
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= CHUNKED))
    for k in range(0, CHUNKED, 8):
        if not len(left):
            break
        rest = size[left] - k
        word = eight[starts[left] + k]
        short = rest < 8
        word[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[left] = mix((h[left] ^ word) * _P + np.uint64(k + 1))
        left = left[rest > 8]
    for i in np.flatnonzero(size > CHUNKED).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross an offset: starts, ends, and the text each lies in."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(inside)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    back = offsets[1:-1]
    back = back[back > 0] - 1
    last[back] = inside[back]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def space_words(column, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of all texts, and each word's text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, owner = spans_of(~SPACE[data], offsets)
    return span_hashes(data, starts, ends, seed), owner


def shingle_sets(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every text: sorted 64-bit hashes, text after text, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    n_texts = len(column)
    h, owner = space_words(column)
    count = np.bincount(owner, minlength=n_texts)
    out, out_owner = [], []
    if len(h) >= k:
        acc = mix(h[: len(h) - k + 1] + np.uint64(k))
        for i in range(1, k):
            acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + h[i : len(h) - k + 1 + i])
        same = owner[: len(h) - k + 1] == owner[k - 1 :]
        out.append(acc[same])
        out_owner.append(owner[: len(h) - k + 1][same])
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if n_texts else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            there = count[short] > i
            at = first[short[there]] + i
            acc[there] = mix(acc[there] * np.uint64(0x2545F4914F6CDD1D) + h[at] + count[short[there]].astype(np.uint64))
        out.append(acc)
        out_owner.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    s, o = np.concatenate(out), np.concatenate(out_owner)
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    s, o = s[keep], o[keep]
    return s, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=n_texts))])


def pieces(batches, at: int, most_bytes: int = 1 << 18, most_rows: int = 2000):
    """The batches cut so that a piece has about most_bytes of text in column ``at``, or one longer text.

    The kernels take some 60 bytes of memory a byte of text.
    """
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = total[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(total, base + most_bytes, side="right"))), start + most_rows)
            yield batch.slice(start, stop - start)
            start = stop
