import random
import re

import numpy as np
import pytest

from quernstone.llm import neardup

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = W.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width=3, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    ids = [-(1 << 63) if d is None else d for d, _ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= percent * len(s | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    null = lambda x: None if x == -(1 << 63) else x
    return sorted(((null(ids[i]), len(sets[i]), null(least[find(i)]), ids[i] == least[find(i)]) for i in range(len(rows))), key=str)


def got(df, **k):
    return sorted((tuple(r) for r in neardup.digest_rows(df, **k).collect()), key=str)


def test_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(df) == brute(rows)


def test_edits_copies_and_odd_rows(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(260):
        w = list(base[i % 4])
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(900)}"
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    rows += [(1000 + i, rows[3][1].upper()) for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one TWO"), (None, "a b"), (2005, "a b c"), (2005, "q r s t"), (2006, "É x y"), (2007, "é x y"), (2008, "z " * 50_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, _doc int")
    assert got(df) == brute(rows)
    assert got(df, width=5, percent=80) == brute(rows, 5, 80)
    assert neardup.digest_rows(df.limit(0)).count() == 0
    first = [r for r in brute(rows, 5, 80) if r[3]]
    assert sorted(str(r.doc_id) for r in neardup.keep_first(df).collect()) == sorted(str(r[0]) for r in first)


def variants(n, seed, rate=0.02, words=80):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    return [(i, " ".join(w if rng.random() > rate else f"y{rng.randrange(50)}" for w in base)) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"MOST_BLOCKED": 40}, {"MOST_BLOCKED": 40, "LARGEST_BLOCK": 1, "WINDOW": 32}, {"LARGEST_BLOCK": 1, "WINDOW": 64, "PIECE": 128}])
def test_crowded_regions_every_way(spark, monkeypatch, limits):
    """One group of different near copies, most pairs of it near the threshold, through blocks, pairs and windows."""
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    rows = variants(260, 9) + [(1000 + i, t) for i, t in variants(40, 3, 0.05)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_large_group_of_different_near_copies(spark):
    rows = variants(2200, 1, 0.03, 40) + [(9000 + i, f"clean document number {i} of its own with words {i * 7} {i * 11} and {i * 13}") for i in range(100)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_every_value_begins_one_tree_in_eight_turns():
    first = {neardup.LEVELS * (t % neardup.TREES) + turn % neardup.LEVELS for turn in range(neardup.LEVELS) for t in range(neardup.TREES)}
    assert len(first) == neardup.TREES * neardup.LEVELS
    for turn in range(neardup.LEVELS):
        for t in range(neardup.TREES):
            own = [neardup.LEVELS * ((t + k * turn) % neardup.TREES) + (turn + k) % neardup.LEVELS for k in range(neardup.LEVELS)]
            assert len(set(own)) == neardup.LEVELS


def test_ways_to_confirm_agree(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 40, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 1 << 40, 60), base)) for _ in range(30)]
    rows = [(i, len(s), s.tolist()) for i, s in enumerate(sets)]
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30)]
    out = neardup.by_pair(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "node long, n long, shingles array<long>"), 85)
    want = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert {(r.a, r.b) for r in out.collect()} == want and 0 < len(want) < len(pairs)


def test_confirmed_ways_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(4)] * 3
    pairs = {(i, j) for i in range(12) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))}
    links = list(neardup.confirmed(sets, np.zeros(12), 70))
    assert all((max(p), min(p)) in pairs for p in links) and links
