import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import packing
from quernstone.llm.tokens import encoder


def check_slots(counts, slots, capacity):
    bins, ranks = defaultdict(list), defaultdict(list)
    for s in slots:
        for j in range(s.times * s.count):
            bins[s.sequence + j // s.times].append((s.offset + j % s.times * s.length, s.length))
            ranks[s.length].append(s.first + j)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_every_piece_has_its_own_place(lengths):
    counts = Counter(lengths)
    bins = check_slots(counts, packing.pack_counts(counts, 24), 24)
    assert len(bins) <= math.ceil(11 / 9 * math.ceil(sum(lengths) / 24)) + len([n for n in lengths if 3 * n > 24])
    assert all(sum(3 * n > 24 for _, n in items) <= 2 for items in bins.values())


def test_near_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6, 1, 20_000).astype(int) + 1, 1, 4096)
    slots = packing.pack_counts(Counter(lengths.tolist()))
    assert len(check_slots(Counter(lengths.tolist()), slots, 4096)) <= math.ceil(lengths.sum() / 4096) * 1.002 + 1


def test_documents(spark):
    long = "the quick brown fox " * 3000
    rows = [(i, "some words here" * (i % 7), "x") for i in range(200)] + [(500, long, "x"), (500, long, "x"), (501, None, None), (None, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    packed = packing.pack_documents(df, with_ids=True).cache()
    out = packed.collect()
    enc = encoder(packing.VOCABULARY)
    want = Counter()
    for doc_id, text, _ in rows:
        ids = np.append(enc.encode([text])[0], 1).astype("<u4")
        for k in range(0, len(ids), 4096):
            want[doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for items in seqs.values():
        ends = [0]
        for o, n in sorted(items):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 4096
    assert len(seqs) == math.ceil(sum(r.length for r in out) / 4096)
    whole = {r.sequence_id: r.ids for r in packing.assemble(packed).collect()}
    assert all(len(whole[s]) == sum(n for _, n in items) for s, items in seqs.items())
    assert packing.pack_documents(df.limit(0)).count() == 0
