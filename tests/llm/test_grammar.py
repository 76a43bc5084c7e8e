import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import grammar
from quernstone.llm.tokens import encoder


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=60), max_size=12))
def test_round_trip_and_random_access(docs):
    docs = [np.array([*d, 0], np.uint16) for d in docs]
    payload = grammar.encode_shard(list(range(len(docs))), docs)
    shard = grammar.Shard.read(payload)
    assert [d.tolist() for d in shard.all()] == [d.tolist() for d in docs]
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d.tolist()


def test_expansion_lengths_and_gain():
    docs = [np.array([5, 6, 7, 8] * 500 + [0], np.uint16)] * 3
    shard = grammar.Shard.read(grammar.encode_shard([1, None, 3], docs))
    assert shard.doc_ids == [1, None, 3] and len(shard.symbols) < 60
    for k, n in enumerate(shard.sizes):
        assert len(shard.expand(np.array([k]))) == n
    with pytest.raises(ValueError):
        grammar.Shard.read(b"none")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=80), min_size=1, max_size=8), st.data())
def test_any_range_of_ids(docs, data):
    docs = [np.array([*d, 0], np.uint16) for d in docs]
    whole = np.concatenate(docs)
    shard = grammar.Shard.read(grammar.encode_shard(list(range(len(docs))), docs))
    a, z = data.draw(st.integers(0, len(whole))), data.draw(st.integers(0, len(whole)))
    assert shard.ids(a, z).tolist() == whole[a:z].tolist()


def left_over(shard):
    """The highest count of a pair in the symbols, without overlaps, none across a document's end."""
    count, last = Counter(), {}
    for i, pair in enumerate(zip(shard.symbols.tolist(), shard.symbols.tolist()[1:], strict=False)):
        if shard.expand(np.array([pair[0]]))[-1] != 0 and last.get(pair) != i - 1:
            count[pair] += 1
            last[pair] = i
    return max(count.values(), default=0)


@pytest.mark.parametrize("ids", [[7] * 65_536, [3, 9, 4, 2] * 4096, list(range(1, 300)) * 40, [1, 2, 1, 1, 2, 2, 1] * 999])
def test_no_pair_is_left_that_saves_space(ids):
    shard = grammar.Shard.read(grammar.encode_shard([1], [np.array([*ids, 0], np.uint16)]))
    assert shard.document(0).tolist() == [*ids, 0]
    assert left_over(shard) < grammar.LEAST_COUNT
    assert len(shard.symbols) + 4 * len(shard.rules) <= 1700


def test_more_symbols_than_sixteen_bits(monkeypatch):
    monkeypatch.setattr(grammar, "LEAST_COUNT", 2)
    rng = np.random.default_rng(4)
    ids = rng.integers(1, 60_000, 30_000).astype(np.uint16)
    docs = [np.append(np.repeat(ids[i : i + 3000].reshape(-1, 2), 2, axis=0).ravel(), np.uint16(0)) for i in range(0, 30_000, 3000)]
    shard = grammar.Shard.read(grammar.encode_shard(list(range(10)), docs))
    assert len(shard.letters) + len(shard.rules) > 1 << 15
    assert [d.tolist() for d in shard.all()] == [d.tolist() for d in docs]
    seq = np.concatenate([np.arange(70_000), np.arange(70_000)]).astype(np.uint32)
    rules, sizes, symbols = grammar.compress(seq, 70_000, -1)
    big = grammar.Shard([0], np.array([0]), np.arange(70_000), rules, np.concatenate([np.ones(70_000, np.int64), sizes]), np.array([0]), symbols, len(seq))
    assert len(symbols) < 10 and big.ids(0, len(seq)).tolist() == seq.tolist()


def rounds_everywhere(seq, letters, end):
    """The rules and what is left, by rounds that count all pairs anew."""
    rules, least, last = [], len(seq), [x == end for x in range(letters)]
    while True:
        places = {}
        for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
            if not last[pair[0]] and places.get(pair, [-9])[-1] != i - 1 + (pair[0] != pair[1]) * len(seq):
                places.setdefault(pair, []).append(i)
        least = max(grammar.LEAST_COUNT, least // grammar.STEP)
        order = sorted((p for p in places if len(places[p]) >= least), key=lambda p: (-len(places[p]), p))
        seen, pairs = set(), []
        for p in order:
            h = int(grammar._place(np.array([p[0] << 16 | p[1]], np.uint32))[0])
            pairs += [] if h in seen else [p]
            seen.add(h)
        if not pairs:
            if least > grammar.LEAST_COUNT:
                continue
            return rules, seq
        rank = {i: k for k, p in enumerate(pairs) for i in places[p]}
        wins = [i for i, k in sorted(rank.items()) if rank.get(i - 1, 1 << 30) > k and rank.get(i + 1, 1 << 30) > k]
        uses = Counter(rank[i] for i in wins)
        names = {k: n for n, k in enumerate((k for k in range(len(pairs)) if uses[k] >= grammar.LEAST_COUNT), letters + len(rules))}
        at = {i: names[rank[i]] for i in wins if rank[i] in names}
        rules += [pairs[k] for k in names]
        last += [last[pairs[k][1]] for k in names]
        seq = [at.get(i, x) for i, x in enumerate(seq) if i - 1 not in at]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 6)), max_size=250), st.sampled_from([2, 5]), st.sampled_from([3, 18]))
def test_rules_equal_those_of_counting_everywhere(runs, least, bits):
    seq = [x for x, n in runs for _ in range(n)] * 2
    with pytest.MonkeyPatch.context() as m:
        m.setattr(grammar, "LEAST_COUNT", least)
        m.setattr(grammar, "_HASH_BITS", bits)
        rules, _, left = grammar.compress(np.array(seq, np.int64), 6, 0)
        assert (list(map(tuple, rules.tolist())), left.tolist()) == rounds_everywhere(seq, 6, 0)


def test_late_rounds_look_at_few_places(monkeypatch):
    looked, place = [], grammar._place
    monkeypatch.setattr(grammar, "_place", lambda codes: looked.append(len(codes)) or place(codes))
    rng = np.random.default_rng(8)
    words = [rng.integers(1, 400, rng.integers(2, 7)) for _ in range(3000)]
    seq = np.concatenate([words[min(int(k), 2999)] for k in rng.zipf(1.3, 40_000)])
    grammar.compress(seq, 400, -1)
    assert sum(looked) < 6 * len(seq), sum(looked) / len(seq)


def test_documents(spark, tmp_path):
    rows = [(i * 3 % 101, f"the same words again and again {i % 5} " * (i % 9)) for i in range(101)]
    rows += [(None, "no id"), (200, None), (201, ""), (202, "twice"), (202, "twice"), (203, "long text " * 60_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, payload string")
    got = grammar.digest_rows(df).collect()
    enc, at = encoder(grammar.VOCABULARY), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_start = sorted(got, key=lambda r: r.start)
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(ordered, by_start, strict=True):
        ids = np.append(enc.encode([text])[0], 0).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert grammar.digest_rows(df.limit(0)).count() == 0
    grammar.write(df, str(tmp_path / "s"), shard_ids=50)
    assert grammar.read(spark, str(tmp_path / "s")).count() == len(rows)


def test_rows_of_one_id_have_one_order(spark):
    rows = [(5, f"text {i % 7} " * i) for i in range(40)] + [(None, None), (None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, grammar.digest_rows(df).collect()), key=str)
    assert one == sorted(map(tuple, grammar.digest_rows(df.repartition(7)).collect()), key=str)
