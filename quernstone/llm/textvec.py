"""Words, lines and their hashes for batches of texts, as numpy arrays.

A batch is encoded as one UTF-8 buffer in which every text is followed by a
space, so that byte-level operations run once over all texts. Working memory
is bounded by :data:`CHUNK_BYTES` besides eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Texts are grouped into buffers of about this size; a longer text stands alone.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    return _powers(1 << max(16, int(size).bit_length()))


class Spans:
    """Polynomial hashes of any span of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * _M2)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each byte span; spans are ascending and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        at = starts[i]
        part = data[at : ends[j - 1]]
        out[i:j] = Spans(BYTE_CODES[LOWER[part] if lower else part]).hash(starts[i:j] - at, ends[i:j] - at)
        i = j
    return out


@dataclass
class Words:
    """Words of a batch: byte spans, and for text ``i`` words ``ptr[i]:ptr[i+1]``."""

    data: np.ndarray
    base: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)

    @property
    def doc(self) -> np.ndarray:
        """Text index of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts and where each begins (and the end)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    return np.frombuffer(b" ".join([*raw, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def words(texts: list[str | None]) -> Words:
    data, base = encode(texts)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(data, base, starts, ends, np.searchsorted(starts, base))


def slices(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches in pieces of a few hundred rows, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def groups(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; at least one text each."""
    start = size = i = 0
    for i, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= limit:
            yield start, i
            start, size = i, 0
    if start < i:
        yield start, i
