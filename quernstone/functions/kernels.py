"""Content-defined chunking of one payload: numpy finds the candidate cuts, a loop over chunks chooses.

The algorithms are the published ones; tables, masks and seeds are this
library's own, so cuts differ from other implementations. A kernel's cut
depends only on bytes of its chunk as long as ``min`` is at least 64, so a
payload may be cut off and continued at any chunk's start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from quernstone.errors import InvalidInput

_RNG = np.random.default_rng(64)
_GEAR = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256, dtype=np.uint64)
_LEAP = _RNG.integers(0, 1 << 32, (5, 256), dtype=np.uint64).astype(np.uint32)
#: An irreducible polynomial of degree 53 over GF(2), and the window of the rolling fingerprint.
_POLYNOMIAL, _RABIN_WINDOW = 0x3DA3358B4DC173, 48
#: Fixed values of the published low-entropy chunker: the byte of its pattern, the masks before and after the wished size,
#: and how many equal windows in a row end a chunk.
_ULTRA_PATTERN, _ULTRA_STRICT, _ULTRA_LOOSE, _ULTRA_REPEATS = 0xAA, 0x2F, 0x2C, 64


@dataclass(frozen=True)
class Sizes:
    """Least, wished and greatest chunk size in bytes."""

    min: int
    avg: int
    max: int

    def __post_init__(self):
        if not 0 < self.min <= self.avg <= self.max:
            raise InvalidInput("sizes must be 0 < min <= avg <= max")

    def __str__(self):
        return f"{self.min}-{self.avg}-{self.max}"


DEFAULT = Sizes(8 << 10, 16 << 10, 64 << 10)


@dataclass(frozen=True)
class SeqConfig:
    """How many steps in a row end a chunk, how many opposite steps lead to a skip, and its bytes."""

    run: int = 5
    trigger: int = 50
    skip: int = 256

    def __post_init__(self):
        if min(self.run, self.trigger, self.skip) < 1:
            raise InvalidInput("run, trigger and skip must be at least 1")


def _gear(b: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: it remembers 64 bytes, built by doubling."""
    h = _GEAR[b]
    for w in (1, 2, 4, 8, 16, 32):
        if len(h) > w:
            more = h.copy()
            more[w:] += h[:-w] << np.uint64(w)
            h = more
    return h


def _low_bits(avg: int, shift: int) -> np.uint64:
    bits = max(1, avg.bit_length() - 1 + shift)
    return np.uint64(((1 << bits) - 1) << (63 - bits))


def _ends(hit: np.ndarray) -> np.ndarray:
    return np.flatnonzero(hit) + 1


def _first(cuts: np.ndarray, low: int, high: int) -> int:
    """The first cut in [low, high), or -1."""
    i = int(np.searchsorted(cuts, low))
    return int(cuts[i]) if i < len(cuts) and cuts[i] < high else -1


def _choose(n: int, sizes: Sizes, strict: np.ndarray, loose: np.ndarray) -> list[int]:
    """Ends of chunks: a strict cut before the wished size, else a loose one, else the greatest size."""
    ends, at = [], 0
    while at < n:
        cut = _first(strict, at + sizes.min, min(n, at + sizes.avg))
        if cut < 0:
            cut = _first(loose, at + max(sizes.min, sizes.avg), min(n, at + sizes.max))
        at = cut if cut > 0 else min(n, at + sizes.max)
        ends.append(at)
    return ends


def fast(b: np.ndarray, s: Sizes) -> list[int]:
    """FastCDC with normalized chunking: a stricter mask before the wished size, a looser one after."""
    h = _gear(b)
    return _choose(len(b), s, _ends((h & _low_bits(s.avg, 2)) == 0), _ends((h & _low_bits(s.avg, -2)) == 0))


@lru_cache(1)
def _rabin_tables() -> np.ndarray:
    """For each place in the window, the residue that a byte there adds."""
    degree = _POLYNOMIAL.bit_length() - 1

    def times_x8(v: int) -> int:
        for _ in range(8):
            v <<= 1
            if v >> degree & 1:
                v ^= _POLYNOMIAL
        return v

    rows = [list(range(256))]
    for _ in range(_RABIN_WINDOW - 1):
        rows.append([times_x8(v) for v in rows[-1]])
    return np.array(rows, np.uint64)


def rabin(b: np.ndarray, s: Sizes) -> list[int]:
    """Rabin fingerprints of a sliding window; they are linear, so each byte adds a table value."""
    f, tables = np.zeros(len(b), np.uint64), _rabin_tables()
    for k in range(min(_RABIN_WINDOW, len(b))):
        f[k:] ^= tables[k][b[: len(b) - k]]
    mask = np.uint64((1 << max(1, s.avg.bit_length() - 1)) - 1)
    cuts = _ends((f & mask) == mask)
    return _choose(len(b), s, cuts, cuts)


def leap(b: np.ndarray, s: Sizes) -> list[int]:
    """A cut wants a row of qualified windows; a window of five bytes qualifies three times in four."""
    v = np.zeros(len(b), np.uint32)
    for k in range(min(5, len(b))):
        v[k:] += _LEAP[k][b[: len(b) - k]]
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x2C1B3C6D)
    fine = (v >> np.uint32(28)) % np.uint32(4) != 0
    # A row of length m of chance 3/4 each starts once in about 4 (4/3)^m places.
    row = max(1, min(59, round(np.log(max(s.avg - s.min, 8) / 4) / np.log(4 / 3))))
    cuts = _run_ends(fine, row)
    return _choose(len(b), s, cuts, cuts)


def _run_ends(hit: np.ndarray, length: int) -> np.ndarray:
    """Ends of the places where the last ``length`` values hold, first of each row only."""
    at = np.arange(len(hit))
    last_miss = np.maximum.accumulate(np.where(hit, -1, at)) if len(hit) else at
    return _ends(at - last_miss == length)


def ultra(b: np.ndarray, s: Sizes) -> list[int]:
    """Hamming distance of the last eight bytes to a pattern, under a stricter mask before the wished size.

    Windows of eight bytes follow each other from the least size on. A window that
    repeats the one before is not searched, and many of them in a row end the chunk.
    """
    n = len(b)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(b ^ np.uint8(_ULTRA_PATTERN)), dtype=np.int64)])
    distance = ones[8:] - ones[:-8]  # of the eight bytes before place 8, 9, ...
    strict, loose = (np.flatnonzero((distance & mask) == 0) + 8 for mask in (_ULTRA_STRICT, _ULTRA_LOOSE))
    differ = np.concatenate([[0], np.cumsum(b[8:] != b[:-8])]) if n > 8 else np.zeros(1, np.int64)
    ends, at = [], 0
    while at < n:
        end, first = min(n, at + s.max), at + s.min + 8
        at = end
        if first < end:
            starts = np.arange(first, end, 8)
            full = starts + 8 <= n
            again = full.copy()
            again[full] = differ[starts[full]] == differ[starts[full] - 8]  # the window equals the one before
            row = _run_ends(again, _ULTRA_REPEATS)
            low = int(starts[row[0] - 1]) + 8 if len(row) else end
            wished = max(first, end if end - first + s.min + 8 <= s.avg else first - s.min - 8 + s.avg)
            for cuts, lo, hi in ((strict, first, min(low, wished, end)), (loose, wished, min(low, end))):
                c = cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, hi)]
                c = c[~again[(c - first) // 8]]
                if len(c):
                    low = min(low, int(c[0]))
                    break
            at = min(low, end)
        ends.append(at)
    return ends


def super_(b: np.ndarray, s: Sizes, state: dict | None = None, last: bool = True) -> list[int]:
    """Gear cuts with a record of what followed each cut's fingerprint; a guess must be a cut itself.

    ``state`` carries the record and the last fingerprint from one piece of a
    payload to the next; of a piece that is not the last, only chunks are cut that
    no further byte can change.
    """
    state = {} if state is None else state
    h = _gear(b)
    hit = (h & _low_bits(s.avg, -1)) == 0
    cuts = _ends(hit)
    strict = _ends((h & _low_bits(s.avg, 1)) == 0)
    ends, at, record = [], 0, state.setdefault("record", {})
    while at < len(b) and (last or at + s.max <= len(b)):
        key = int(h[at - 1]) if at else state.get("key")
        guess = record.get(key)
        if guess and at + guess < len(b) and hit[at + guess - 1]:
            end = at + guess
        else:
            end = _choose(min(len(b) - at, s.max), s, strict[np.searchsorted(strict, at + 1) :] - at, cuts[np.searchsorted(cuts, at + 1) :] - at)[0] + at
        if key is not None:
            record[key] = end - at
        ends.append(end)
        at = end
    if at:
        state["key"] = int(h[at - 1])
    return ends


def _seq(sign: int) -> Callable[..., list[int]]:
    def run(b: np.ndarray, s: Sizes, config: SeqConfig = SeqConfig()) -> list[int]:
        step = np.concatenate([[0], np.sign(np.diff(b.astype(np.int16)))]) * sign
        steps = np.concatenate([[0], np.cumsum(step > 0)])
        full = np.flatnonzero(steps[config.run :] - steps[: -config.run] == config.run) + config.run  # ends of full runs
        against = np.flatnonzero(step < 0)
        ends, at, n = [], 0, len(b)
        while at < n:
            end, p = min(n, at + s.max), at + s.min
            at = end
            while p < end:
                i, j = np.searchsorted(full, p + config.run), np.searchsorted(against, p)
                cut = int(full[i]) if i < len(full) else n
                turn = int(against[j + config.trigger - 1]) if j + config.trigger <= len(against) else n
                if cut <= turn:
                    at = min(cut, end)
                    break
                p = turn + config.skip
            ends.append(at)
        return ends

    run.__doc__ = """A cut after a run of bytes that all rise (or all fall); after many steps the other way some bytes are skipped."""
    return run


KERNELS: dict[str, Callable[[np.ndarray, Sizes], list[int]]] = {
    "fast": fast,
    "rabin": rabin,
    "leap": leap,
    "ultra": ultra,
    "super": super_,
    "seq": _seq(1),
    "seq-decreasing": _seq(-1),
}


def ends_of(b: np.ndarray, kernel: str, sizes: Sizes, config: SeqConfig | None = None) -> list[int]:
    return KERNELS[kernel](b, sizes) if config is None else KERNELS[kernel](b, sizes, config)


def chunk(payload: bytes, kernel: str, sizes: Sizes, config: SeqConfig | None = None) -> list[tuple[int, int]]:
    """Offsets and lengths of the chunks of ``payload``, in order and without gaps."""
    b = np.frombuffer(payload, np.uint8)
    if not len(b):
        return []
    ends = ends_of(b, kernel, sizes, config)
    return list(zip([0, *ends[:-1]], np.diff([0, *ends]).tolist(), strict=True))


class Carry:
    """Chunks of a payload that arrives in pieces; they equal those of the whole payload.

    What no further byte can change is given out, the rest (less than the greatest
    size) waits for the next piece. The least size must be :data:`MEMORY` or more,
    so that no cut depends on bytes before its chunk (fixed sizes may be less).
    """

    def __init__(self, kernel: str, sizes: Sizes, config: SeqConfig | None = None):
        if kernel != "fixed-size" and sizes.min < MEMORY:
            raise InvalidInput(f"pieces need a least size of {MEMORY} bytes")
        self.kernel, self.sizes, self.config = kernel, sizes, config
        self.rest, self.state = b"", {}

    def feed(self, piece: bytes, last: bool = False) -> list[bytes]:
        data = self.rest + piece
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return []
        if self.kernel == "fixed-size":
            ends = [*range(self.sizes.min, len(b) + 1, self.sizes.min)]
            if last and (not ends or ends[-1] < len(b)):
                ends.append(len(b))
        elif self.kernel == "super":
            ends = super_(b, self.sizes, self.state, last)
        else:
            ends = ends_of(b, self.kernel, self.sizes, self.config)
            if not last:
                ends = [e for a, e in zip([0, *ends[:-1]], ends, strict=True) if a + self.sizes.max <= len(b)]
        self.rest = data[ends[-1] :] if ends else data
        return [data[a:e] for a, e in zip([0, *ends], ends, strict=False)]


#: The greatest number of bytes that a kernel remembers; chunks at least as long make it forget what came before them.
MEMORY = 64
