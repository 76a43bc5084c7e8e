import itertools
import zlib

import numpy as np

from quernstone.llm import quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        unary, pair = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        ptr = np.array([0, n])
        m, pairs = quality.marginals(unary, pair, *quality._padded(ptr))
        want, want_pairs, total = np.zeros((n, 2)), np.zeros((2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pair[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            for i in range(n):
                want[i, y[i]] += p
            for i in range(n - 1):
                want_pairs[y[i], y[i + 1]] += p
        assert np.allclose(m[0], want / total) and np.allclose(pairs, want_pairs / total)


def test_features_do_not_depend_on_the_batch():
    texts = ["One line.\nONE!! LINE!!\n\nx | y | z", None, "", "é à\r\nb", "same same same same same same\nsame same same same same same"]
    together = quality.features(texts)
    for i, t in enumerate(texts):
        alone = quality.features([t])
        assert np.array_equal(alone.x, together.x[together.ptr[i] : together.ptr[i + 1]])
        assert np.array_equal(alone.weight, together.weight[together.ptr[i] : together.ptr[i + 1]])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    held = [(rows[x.doc_id].score, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.95
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, "", 3), (None, "a\nb", 3), (2, "w " * 90_000, 4), (2, "\n" * 9, 4)], "doc_id long, text string, score int")
    none = quality.train(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    got = quality.score(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    one = quality.train(docs, spark.createDataFrame([(2, 1), (2, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.score(docs, one).collect())
    assert quality.keep_good(docs, none).count() == 5
    assert quality.score(docs.limit(0), none).count() == 0


def test_fit_uses_all_lines_of_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda lines, labels: seen.append((np.diff(lines.ptr).tolist(), labels.tolist())))
    long = {i: "\n".join(f"line {i} {k}" for k in range(n)) for i, n in ((1, 3), (7, 250), (8, 40), (2, 7))}
    docs = spark.createDataFrame(list(long.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in long], "doc_id long, quality int").filter(~quality.held_out())
    own = {r.doc_id for r in labels.collect()}
    quality.train(docs, labels)
    assert own == {1, 7, 8} and sorted(seen[0][0]) == sorted(t.count("\n") + 1 for i, t in long.items() if i in own)
    monkeypatch.setattr(quality, "FIT_LINES", 1)
    quality.train(docs, labels)
    assert len(seen[1][0]) == 1 and seen[1][0][0] in seen[0][0]


def test_long_documents_pad_no_others():
    rng = np.random.default_rng(1)
    ptr = np.cumsum([0, 3, 0, 700, 1, 2, 9])
    unary, pair = rng.normal(size=(ptr[-1], 2)), rng.normal(size=(2, 2))
    at, real = quality._padded(ptr)
    want, want_pairs = quality.marginals(unary, pair, at, real)
    got, pairs = np.zeros((ptr[-1], 2)), np.zeros((2, 2))
    for at2, real2 in quality._padded_blocks(ptr):
        m, own = quality.marginals(unary, pair, at2, real2)
        got[at2[real2]] = m[real2]
        pairs += own
    assert np.allclose(got[at[real]], want[real]) and np.allclose(pairs, want_pairs)


def test_scores_equal_enumeration():
    rng = np.random.default_rng(8)
    n = quality.N_FEATURES
    model = quality.Model(rng.normal(size=n), rng.uniform(0.5, 2, n), rng.normal(size=(n, 2)) / 4, rng.normal(size=(2, 2)), 1.7, -0.4)
    texts = ["One line.\nONE!! LINE!!\n\nx | y | z", None, "", "a b c.\n\n\t\nd e f 1 2 3\n$$ ## g\nd e f 1 2 3\nlast", "single"]
    for text, got in zip(texts, model.score(texts), strict=True):
        kept = [x for x in (text or "").split("\n") if x.split()]
        sizes = np.array([sum(len(w.encode()) for w in x.split()) for x in kept], float)
        share = 0.5
        if kept:
            unary = np.clip((quality.features([text]).x - model.mean) / model.scale, -6, 6) @ model.unary
            total, good = 0.0, np.zeros(len(kept))
            for y in itertools.product((0, 1), repeat=len(kept)):
                p = np.exp(sum(unary[i, y[i]] for i in range(len(y))) + sum(model.pair[y[i], y[i + 1]] for i in range(len(y) - 1)))
                total += p
                good += p * np.array(y)
            share = (good / total * sizes).sum() / sizes.sum()
        share = min(max(share, 1e-4), 1 - 1e-4)
        assert np.isclose(got, 1 / (1 + np.exp(-(1.7 * np.log(share / (1 - share)) - 0.4))))
