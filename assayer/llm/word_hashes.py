"""Vectorised hashing of the words in an Arrow text column: one pass of numpy over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
#: Bytes of text hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold_case:
        codes[65:91] += np.uint64(32)
    return spread(codes + np.uint64(1)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class WordHasher:
    """Words are maximal runs of the bytes marked in ``word_bytes``; hashes are never zero."""

    def __init__(self, word_bytes: np.ndarray, fold_case: bool = True):
        self.mask, self.values = word_bytes, byte_values(fold_case)
        self.up, self.down = powers(1 << 16)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, byte start and byte end of every word, and the first word of every text plus the word count."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        bounds = offsets - low
        n = len(raw)
        if n == 0:
            empty = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), empty, empty, np.zeros(len(bounds), np.int64)
        inside = self.mask[raw]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
        ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
        if len(self.up) <= n:
            self.up, self.down = powers(n + n // 8 + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[:n], out=total[1:])
        found = spread((total[ends] - total[starts]) * self.down[starts])
        found[found == 0] = 1
        return found, starts, ends, np.searchsorted(starts, bounds)


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(from, to) row ranges of at most ``limit`` bytes, or of a single longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def ascii_space_words() -> np.ndarray:
    """Words are whatever stands between ASCII white space."""
    mask = np.ones(256, bool)
    mask[[0x20, *range(0x09, 0x0E)]] = False
    return mask


def letter_digit_words() -> np.ndarray:
    """Words are ASCII letters, digits and every code point beyond ASCII."""
    mask = np.zeros(256, bool)
    mask[0x30:0x3A] = mask[0x41:0x5B] = mask[0x61:0x7B] = mask[0x80:] = True
    return mask
