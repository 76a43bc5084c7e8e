import re
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quernstone.llm import mixing, packing, pii, quality  # noqa: E402
from quernstone.llm.shared import Work  # noqa: E402
from quernstone.llm.tokens import encoder  # noqa: E402
from tests.llm.test_neardup import brute  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, work, out = spark.read.parquet(f"{SF}/documents.parquet"), Work(spark, "t"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append((docs, work.save(stage(spark, docs, SF), f"s{k}")))
        docs = out[-1][1]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quality(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = sorted((tuple(r) for r in before.collect() if model.score([r.text])[0] >= 0.5), key=str)
    assert rows(after) == want
    kept = {r.doc_id for r in after.collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.97 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.05 * len(labels)


def test_near_copies(stages):
    before, after = stages[1]
    first = {r[0] for r in brute([(r.doc_id, r.text) for r in before.collect()], 5, 80) if r[3]}
    assert rows(after) == [r for r in rows(before) if r[0] in first]


def test_personal_data(stages):
    before, after = stages[2]
    new = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        text = pii.redact(r.text, pii.find(r.text))
        assert new[r.doc_id] == (r.doc_id, text, r.lang, r.source, len(text))
        assert not [s for s in pii.find(text) if s.kind in pii.BASE]


def test_mix(stages):
    before, after = stages[3]
    assert after.columns == before.columns
    size, source = defaultdict(int), {r.doc_id: r.source for r in before.collect()}
    for r in before.collect():
        size[r.source] += len(re.findall(mixing.WORD, r.text))
    target = {k: t for k, _, t, _, _ in mixing.plan(dict(size))[1]}
    taken, original = defaultdict(int), {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        taken[source[r.doc_id]] += len(re.findall(mixing.WORD, r.text))
        assert r.text in original[r.doc_id]
    assert all(abs(taken[s] - target[f"={s}"]) <= 2 * mixing.BLOCK_WORDS for s in size)


def test_pack(stages):
    before, after = stages[4]
    enc, want = encoder(packing.VOCABULARY), Counter()
    for r in before.collect():
        n = len(enc.encode([r.text])[0]) + 1
        want.update((r.doc_id, k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096)))
    assert Counter((r.doc_id, r.piece, r.length) for r in after.collect()) == want
    used = defaultdict(int)
    for r in after.collect():
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


def test_run(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF).drop("sequence_id", "offset")) == rows(stages[-1][1].drop("sequence_id", "offset"))


def test_sequences_can_be_rebuilt(stages):
    before, after = stages[4]
    enc, want = encoder(packing.VOCABULARY), Counter()
    for r in before.collect():
        ids = [*enc.encode([r.text])[0].tolist(), packing.END_ID]
        want.update(tuple(ids[k : k + 4096]) for k in range(0, len(ids), 4096))
    whole = {r.sequence_id: r.ids for r in packing.assemble(after).collect()}
    got = Counter(tuple(whole[r.sequence_id][r.offset : r.offset + r.length]) for r in after.select("sequence_id", "offset", "length").collect())
    assert got == want and sum(map(len, whole.values())) == sum(len(k) * n for k, n in want.items())


def test_odd_rows_and_clashing_columns(spark):
    long = "A sentence of some words stands here, as in any text, and it goes on for a while. " * 3
    rows = [(1, long + "mail a@b.org", "s"), (1, long + "mail a@b.org", "s"), (2, long + "mail a@b.org", "s"), (3, None, None), (4, "", "t"), (4, " \n", "t"), (None, long + "of nobody", None), (5, "word " * 30_000, "t")]
    clash = "pii_spans string, _doc int, _th int, size int, whole int, ranges int, score int, comp int, cluster int"
    df = spark.createDataFrame([(*r, "p", 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], f"doc_id long, text string, source string, {clash}")
    for docs in (df, df.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = Work(spark, "t").save(stage(spark, docs, SF), f"odd{k}")
            if k < 4:
                assert out.columns == df.columns, name
            if k == 1:
                # The second document is a copy of the first, both rows of which stay.
                assert [r.doc_id for r in out.collect() if r.text and "a@b.org" in r.text] in ([1, 1], [])
            docs = out
        assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(docs.columns)
