import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.errors import InvalidInput
from quernstone.functions import kernels
from quernstone.functions.kernels import Sizes, chunk

S = Sizes(64, 128, 512)
NAMES = ["fast", "rabin", "leap", "ultra", "super", "seq", "seq-decreasing"]


def check(data, name, s=S):
    got = chunk(data, name, s)
    assert [o for o, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1].tolist()] if got else not data
    assert sum(n for _, n in got) == len(data)
    assert all(s.min <= n <= s.max for _, n in got[:-1]) and all(n <= s.max for _, n in got[-1:])
    return got


@pytest.mark.parametrize("name", NAMES)
def test_contract(name):
    @settings(max_examples=60, deadline=None)
    @given(st.integers(0, 2**32), st.integers(0, 6000), st.sampled_from([2, 5, 256]))
    def run(seed, n, values):
        data = np.random.default_rng(seed).integers(0, values, n, dtype=np.uint8).tobytes()
        got = check(data, name)
        if name != "super" and len(got) > 2:  # its records reset at a file's start
            cut = got[len(got) // 2][0]
            assert [(o + cut, k) for o, k in chunk(data[cut:], name, S)] == got[len(got) // 2 :]
        head = chunk(data[: n * 2 // 3], name, S)
        assert head[:-1] == got[: max(0, len(head) - 1)]

    run()
    for odd in (b"", b"a", b"\0" * 5000, bytes(range(256)) * 20):
        check(odd, name)


@pytest.mark.parametrize("name", NAMES)
def test_cuts_survive_a_shift(name):
    # Masks and run lengths of these are fixed by their publications, for sizes of kilobytes.
    s = Sizes(1 << 10, 4 << 10, 16 << 10) if name in ("ultra", "seq", "seq-decreasing") else S
    data = np.random.default_rng(8).integers(0, 256, 470 * s.avg, dtype=np.uint8).tobytes()
    of = lambda d: {d[o : o + n] for o, n in chunk(d, name, s)}
    old, new = of(data), of(b"!" + data)
    assert len(old & new) > 0.8 * len(old)
    assert abs(np.mean([n for _, n in chunk(data, name, s)]) - s.avg) < 1.5 * s.avg


def ultra_by_bytes(b, s):
    """The published rule, byte by byte."""
    bits = lambda w: sum((x ^ 0xAA).bit_count() for x in w)
    ends, at = [], 0
    while at < len(b):
        end, i, equal, cut = min(len(b), at + s.max), at + s.min + 8, 0, None
        before = b[i - 8 : i]
        while cut is None and i < end:
            now = b[i : i + 8]
            if now == before:
                equal += 1
                if equal == 64:
                    cut = i + 8
            else:
                equal = 0
                for j in range(i, min(i + 8, end)):
                    if bits(b[j - 8 : j]) & (0x2F if j < at + s.avg else 0x2C) == 0:
                        cut = j
                        break
                before = now
            i += 8
        at = min(end, cut or end)
        ends.append(at)
    return ends


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 4000), st.sampled_from([1, 2, 256]), st.booleans())
def test_ultra_is_the_published_rule(seed, n, values, still):
    rng = np.random.default_rng(seed)
    data = (rng.integers(0, values, n, dtype=np.uint8) * (255 // values)).tobytes()
    if still:
        data += bytes(rng.integers(0, 256, 8, dtype=np.uint8)) * 150 + data
    for s in (S, Sizes(64, 256, 1024), Sizes(64, 1000, 2000)):
        assert kernels.ultra(np.frombuffer(data, np.uint8), s) == ultra_by_bytes(data, s)


def seq_by_bytes(b, s, c, sign):
    ends, at = [], 0
    while at < len(b):
        end, i, run, against, cut = min(len(b), at + s.max), at + s.min, 0, 0, None
        while i < end and cut is None:
            d = (b[i] - b[i - 1]) * sign
            run = run + 1 if d > 0 else 0
            against += d < 0
            if run == c.run:
                cut = i + 1
            elif against == c.trigger:
                i, run, against = i + c.skip - 1, 0, 0
            i += 1
        at = cut if cut is not None else end
        ends.append(at)
    return ends


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 5000), st.integers(1, 6), st.integers(1, 60), st.integers(1, 300))
def test_seq_skips_by_content(seed, n, run, trigger, skip):
    data = np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()
    c = kernels.SeqConfig(run, trigger, skip)
    for sign, name in ((1, "seq"), (-1, "seq-decreasing")):
        ends = kernels.KERNELS[name](np.frombuffer(data, np.uint8), S, c)
        assert ends and ends[-1] == n or n == 0
        assert all(b - a <= S.max for a, b in zip([0, *ends], ends, strict=False))
        assert all(b - a >= S.min for a, b in zip([0, *ends[:-1]], ends[:-1], strict=False))
        assert ends == seq_by_bytes(data, S, c, sign)


@pytest.mark.parametrize("name", ["fixed-size", *NAMES])
def test_pieces_are_cut_like_the_whole(name):
    @settings(max_examples=50, deadline=None)
    @given(st.integers(0, 2**32), st.integers(0, 9000), st.sampled_from([2, 256]), st.lists(st.integers(0, 2500), max_size=9))
    def run(seed, n, values, cuts):
        data = np.random.default_rng(seed).integers(0, values, n, dtype=np.uint8).tobytes()
        places = sorted({0, n, *(min(c, n) for c in np.cumsum(cuts).tolist())})
        carry, got = kernels.Carry(name, S), []
        for a, b in zip(places, places[1:], strict=False):
            got += carry.feed(data[a:b])
        got += carry.feed(b"", True)
        want = [data[o : o + k] for o, k in (chunk(data, name, S) if name != "fixed-size" else [(o, 64) for o in range(0, n, 64)])]
        assert got == want

    run()
    if name != "fixed-size":
        with pytest.raises(InvalidInput):
            kernels.Carry(name, Sizes(8, 16, 32))


def test_sizes():
    for bad in ((0, 1, 2), (3, 2, 4), (1, 5, 4)):
        with pytest.raises(InvalidInput):
            Sizes(*bad)


def test_rabin_is_the_remainder():
    b = np.random.default_rng(2).integers(0, 256, 100, dtype=np.uint8)
    f = np.zeros(100, np.uint64)
    for k in range(48):
        f[k:] ^= kernels._rabin_tables()[k][b[: 100 - k]]
    v = int.from_bytes(b[52:].tobytes(), "big")
    p = kernels._POLYNOMIAL
    while v.bit_length() >= p.bit_length():
        v ^= p << (v.bit_length() - p.bit_length())
    assert int(f[-1]) == v
