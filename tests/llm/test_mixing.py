import random
import re
from collections import defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import mixing


def one_by_one(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(seats):
        free = [i for i in range(len(votes)) if votes[i] > 0 and out[i] < caps[i]]
        if not free:
            break
        best = max(free, key=lambda i: (Fraction(votes[i], 2 * out[i] + 1), -i))
        out[best] += 1
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=7), st.integers(0, 120))
def test_highest_quotients(parties, seats):
    votes, caps = zip(*parties, strict=True)
    assert mixing.sainte_lague(votes, seats, caps) == one_by_one(votes, seats, caps)
    assert mixing.sainte_lague(votes, seats) == one_by_one(votes, seats, [seats] * len(votes))


def test_targets_share_the_excess():
    assert mixing.targets([10, 100, 100], [3, 1, 2]) == [20, Fraction(295, 3), Fraction(590, 3)]
    assert mixing.targets([0, 0], [3, 1]) == [0, 0] and mixing.targets([], []) == []
    assert sum(mixing.targets([5, 7, 900], [3, 1, 2])) == Fraction(3, 2) * 912


def check(rows):
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.whole * r.size + sum(x["end"] - x["start"] for x in r.ranges)
        by[r.source_size, r.target].append(r)
    for (size, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(2, min(mixing.BLOCK_WORDS, target / mixing.LEAST_BLOCKS)) * (1 + size // mixing.SHARD_WORDS)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(df).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in df.select("doc_id").collect())
    check(got)
    assert got == mixing.mix(df.repartition(3)).orderBy("doc_id").collect()
    words = {r.doc_id: len(re.findall(mixing.WORD, r.text)) for r in df.collect()}
    assert all(words[r.doc_id] == r.size for r in got)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    out = defaultdict(int)
    for r in mixed.collect():
        out[r.doc_id] += len(re.findall(mixing.WORD, r.text))
    assert all(out[r.doc_id] == r.taken for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "b", 9), (2, "", None, 9), (3, "a b c", None, 1), (3, "a b c", None, 1), (None, "x " * 300, "b", 2), (4, "y " * 9000, "b", 2), (5, "é z", "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int").withColumn("_order", F.lit("o")).withColumn("whole", F.lit(None))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    check(got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    out = mixing.mixed_documents(df)
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in got)


def test_small_sources_meet_their_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 3}
    rows = [(1000 * k + i, " ".join(["w"] * min(7, n - at)), s) for k, (s, n) in enumerate(sizes.items()) for i, at in enumerate(range(0, n, 7))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        s = rows[[x[0] for x in rows].index(r.doc_id)][2]
        taken[s] += r.taken
        target[s] = r.target
        assert r.source_size == sizes[s] and r.taken <= 2 * r.size
    # By hand: 1,549.5 words at weights 3, 1, 2, 3; a, c and d stop at twice their size, b takes the rest.
    assert target == {"a": 20, "b": 1483.5, "c": 40, "d": 6}
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_taken_rebuilt_from_the_plan(spark):
    """Every word is numbered in the seeded order of its shard, and dealt out one at a time."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice(["x", "y", "z", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    order = {r.doc_id: r.o for r in df.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("o")).collect()}
    totals = defaultdict(int)
    for _, t, s in rows:
        totals[s] += len(t.split())
    block, planned = mixing.plan(dict(totals))
    for key, size, target, blocks, shards in planned:
        assert shards == 1
        own = sorted((r[0] for r in rows if mixing._key(r[2]) == key), key=lambda d: (order[d], d))
        words = [d for d in own for _ in range(got[d].size)]
        seeded = spark.range(1).select(F.xxhash64(F.lit(mixing.SEED + 2), F.lit(key), F.lit(0).cast("long"))).first()[0]
        at, count = seeded % -(-size // block) * block, defaultdict(int)
        for k in range(min(blocks * block, 2 * size)):
            count[words[(at + k) % size]] += 1
        assert {d: got[d].taken for d in own} == {d: count[d] for d in own}
        assert {(got[d].source_size, got[d].target) for d in own} == {(size, target)}
