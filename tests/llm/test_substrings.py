import hashlib
import random
import re

from quernstone.llm import substrings

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    docs = [(-(1 << 63) if d is None else d, W.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (doc_id, _), (d, w) in zip(rows, docs, strict=True):
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone.update(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in substrings.digest_rows(df).collect()), key=str)


def test_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(df) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "é", "dd"]) + str(rng.randrange(40))
    common = [[word() for _ in range(n)] for n in (19, 20, 21, 35, 60)]
    rows = []
    for i in range(120):
        parts = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(common)
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", "\t \r"]).join(parts)))
    rows += [(5000, "x " * 400), (5001, "x y " * 30), (None, " ".join(common[4])), (None, None), (7, ""), (8, " \n ")]
    rows += [(9000, " ".join(common[4] * 2))] * 3 + [(9000, " ".join(common[3] * 2))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, marks int").repartition(5)
    assert got(df) == brute(rows)
    assert substrings.digest_rows(df.limit(0)).count() == 0
    check_factors([r for r in rows if r[0] != 9000], spark)


def check_factors(rows, spark):
    """Factors equal their earlier source, cover what is repeated, and go on as long as the reference does."""
    docs = {d: W.findall(t or "") for d, t in rows}
    rows = [(d, t) for d, t in {d: t for d, t in rows}.items()]
    found = substrings.factors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    low = lambda d: -(1 << 63) if d is None else d
    covered = {d: set() for d in docs}
    by_doc = {}
    for r in found:
        assert r.length >= 20 and (low(r.source_id), r.source_start) < (low(r.doc_id), r.start)
        assert docs[r.doc_id][r.start : r.start + r.length] == docs[r.source_id][r.source_start : r.source_start + r.length]
        covered[r.doc_id].update(range(r.start, r.start + r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    assert {(d, len(c)) for d, c in covered.items()} == {(r[0], r[2]) for r in brute(rows)}
    for own in by_doc.values():
        own.sort(key=lambda r: r.start)
        for a, b in zip(own, own[1:], strict=False):
            # The next factor takes up where this one's windows end, or later; it doesn't just go on.
            step = a.length - 19
            assert b.start >= a.start + step
            assert (b.start, b.source_id, b.source_start) != (a.start + step, a.source_id, a.source_start + step)


def test_factors_of_a_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_factors([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], spark)


def test_a_factor_goes_on_over_many_blocks(spark):
    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(w)), (2, " ".join(["a", "b", *w[30:380], "c"])), (3, " ".join([*w[100:200], "x", *w[300:350]]))]
    found = {tuple(r) for r in substrings.factors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(2, 2, 350, 1, 30), (3, 0, 100, 1, 100), (3, 101, 50, 1, 300)}


def test_small_local_groups_give_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    monkeypatch.setattr(substrings, "LOCAL_BLOCKS", 50)
    assert got(df) == brute(rows)
