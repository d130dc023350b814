"""Words of whole Arrow text columns, found and hashed in numpy.

A word is a maximal run of bytes outside a set of ASCII separators. All separators are single bytes, so working
on UTF-8 bytes gives the same words as working on characters. A word's hash is a polynomial over its bytes modulo
2**64 with a mixing step; windows of words are hashed by the same prefix sums over word hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Everything in ASCII that is neither a digit nor a letter.
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())

_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SLICE = 1 << 20


try:
    _LIBC = ctypes.CDLL(None)
    _LIBC.mallopt(-3, 4 << 20)  # arrays from 4 MiB on are mapped, so that freed ones go back to the system
except (OSError, AttributeError):  # another C library
    _LIBC = None


def keep_freed(most: int = 64 << 20) -> None:
    """Keep up to `most` bytes of freed memory for the arrays to come, until `give_back`. A loop over steps that make and free the same
    arrays spends a quarter of its time on getting pages anew otherwise."""
    if _LIBC is not None and hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(-1, most)


def give_back() -> None:
    """Return freed memory to the system. A Python worker lives on after its task, with what its largest task needed."""
    pa.default_memory_pool().release_unused()
    keep_freed(128 << 10)  # the C library's own bound
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(separators: bytes, lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64))
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    table[list(separators)] = 0
    return table


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, computed as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._run(b, n) for b in (_BASE, _BASE_INV))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = Powers()


class Words:
    """The words of the texts of one batch.

    counts: words of each text; starts, ends: byte positions in `buf`; hashes: one 64-bit value per word.
    """

    def __init__(self, texts: pa.Array, separators: bytes = SPACES, lower: bool = False, hashed: bool = True):
        texts = pc.fill_null(texts, "")
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        data = texts.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low if len(texts) else np.zeros(1, np.int64)
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        is_word = inside[self.buf]
        edge = np.zeros(len(is_word) + 1, bool)  # a text begins or ends here
        edge[self.offsets] = True
        before = np.concatenate(([False], is_word))
        after = np.concatenate((is_word, [False]))
        self.starts = np.flatnonzero(after & (~before | edge))
        self.ends = np.flatnonzero(before & (~after | edge))
        first = np.searchsorted(self.starts, self.offsets)
        self.first, self.counts = first[:-1], np.diff(first)
        self.hashes = self._hash(separators, lower) if hashed else None

    def _hash(self, separators: bytes, lower: bool) -> np.ndarray:
        values, out = _byte_values(separators, lower), np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):  # pieces of about _SLICE bytes, or one longer word
            low = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, low + _SLICE, side="right")))
            high = int(self.ends[to - 1])
            up, down = _POWERS.of(max(high - low, _SLICE))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(values[self.buf[low:high]] * up[: high - low], out=sums[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * down[s])
            at = to
        return out

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window of `width` words inside one text, in order, and the windows of each text."""
        counts = np.maximum(self.counts - width + 1, 0)
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, np.uint64), counts
        out, starts = np.empty(n - width + 1, np.uint64), np.arange(0, n - width + 1, _SLICE)
        for low in starts.tolist():
            high = min(low + _SLICE, n - width + 1)
            span = high - low + width - 1
            up, down = _POWERS.of(_SLICE + width)
            sums = np.zeros(span + 1, np.uint64)
            np.cumsum(self.hashes[low : low + span] * up[:span], out=sums[1:])
            out[low:high] = mix((sums[width:] - sums[:-width]) * down[: high - low])
        keep = np.repeat(self.first, counts) + ranges(counts)
        return out[keep], counts


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of `counts`, joined."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(counts) - counts, counts)


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most_bytes` of text at most; a longer text comes alone."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()
