import numpy as np
import pytest

from quernstone.llm import graph, vectors
from quernstone.llm.graph import components
from quernstone.llm.shared import Work


def brute(rows, least=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(np.array(v, "f4")).all() and any(v)]
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], "f4").astype(float), np.array(rows[b][1], "f4").astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    up[find(b)] = find(a)
    group = {}
    for i, (v, _) in enumerate(rows):
        group.setdefault(find(i), []).append(v)
    return sorted((v, links[i], min(group[find(i)])) for i, (v, _) in enumerate(rows))


def test_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * (0.12 + 0.01 * (i % 7))).astype("f4").tolist()) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(9)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] + [1.0] * 15), (603, [None] + [1.0] * 15), (604, [1.0, 2.0]), (605, [2.0, 4.0]), (606, []), (607, [float("inf")] * 16)]
    clash = [f"{c} int" for c in ("id", "raw", "component", "_ok", "n_links")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], f"vec_id long, embedding array<float>, {', '.join(clash)}")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect())
    assert got == brute(rows)
    small = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df, window=8).collect())
    assert len(small) == len(rows) and sum(r[1] for r in small) >= 0.9 * sum(r[1] for r in got)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids_and_doubles(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, a), (7, a), (7, b), (8, b), (3, [0.0, 0.9, 0.1]), (None, None), (9, [0.0, 0.0, 1.0])]
    for kind in ("float", "double"):
        out = vectors.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=str)
        want = [(None, 1, None, True), (7, 1, None, False), (7, 2, 3, False), (8, 2, 3, False), (3, 2, 3, True), (None, 0, None, True), (9, 0, 9, True)]
        assert got == sorted(want, key=str)
    # Just below the threshold as doubles, at it as 32-bit floats.
    y = [0.9 - 1e-12, float(np.sqrt(1 - (0.9 - 1e-12) ** 2))]
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, y)], "vec_id long, embedding array<double>")
    assert [r.n_links for r in vectors.near_duplicates(df).collect()] == [0, 0]


def test_partitions_do_not_change_the_result(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1600, 24))
    y = x[:500] + rng.normal(size=(500, 24)) * 0.45
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]).astype("f4"))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "48"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            # Few rows a task, so that windows go over many range partitions.
            vectors.LEAST_TASK, before = 16, vectors.LEAST_TASK
            seen.append(sorted(map(tuple, vectors.near_duplicates(df, window=64).collect())))
            vectors.LEAST_TASK = before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1]
    z = vectors.unit(np.array([v for _, v in rows]))
    want = int((z @ z.T >= 0.9).sum()) - len(z)
    assert sum(r[1] for r in seen[0]) >= 0.99 * want > 300


def cone(n, pairs, mean=0.7, dims=64, seed=3):
    """``n`` vectors, a third in one cone; the last ``2 * pairs`` of the cone are pairs at cosine 0.905."""
    rng = np.random.default_rng(seed)
    one = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = one(rng.normal(size=dims))

    def around(count):
        u = rng.normal(size=(count, dims))
        return np.sqrt(mean) * axis + np.sqrt(1 - mean) * one(u - (u @ axis)[:, None] * axis)

    first = around(pairs)
    z = rng.normal(size=first.shape)
    second = 0.905 * first + np.sqrt(1 - 0.905**2) * one(z - (z * first).sum(1, keepdims=True) * first)
    return np.concatenate([one(rng.normal(size=(n - n // 3, dims))), around(n // 3 - 2 * pairs), first, second]).astype("f4")


@pytest.mark.parametrize("most", [16, vectors.LARGEST_BLOCK])
def test_a_third_of_the_vectors_in_one_cone(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "LARGEST_BLOCK", most)  # few places a block: passes go on instead of blocks
    n, pairs = 18_000, 2_000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cone(n, pairs))], "vec_id long, embedding array<float>")
    found = {r.vec_id: r.component_id for r in vectors.near_duplicates(df, window=64).select("vec_id", "component_id").collect()}
    lost = sum(found[i] != found[i + pairs] for i in range(n - 2 * pairs, n - pairs))
    assert lost <= 0.01 * pairs and len(set(found.values())) >= n - pairs - 100


@pytest.mark.parametrize(("further", "mean"), [(vectors.MOST_FURTHER, 0.7), (0, 0.7), (vectors.MOST_FURTHER, 0.0)])
def test_a_small_input_goes_through_the_passes_too(spark, monkeypatch, further, mean):
    """Blocks get only what the passes leave, never the input because it is small."""
    blocks, n, pairs = [], 3000, 300
    whole = vectors.block_edges
    monkeypatch.setattr(vectors, "block_edges", lambda left, *a, **k: blocks.append(left.count()) or whole(left, *a, **k))
    monkeypatch.setattr(vectors, "MOST_FURTHER", further)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cone(n, pairs, mean))], "vec_id long, embedding array<float>")
    found = {r.vec_id: r.component_id for r in vectors.near_duplicates(df, window=32).select("vec_id", "component_id").collect()}
    lost = sum(found[i] != found[i + pairs] for i in range(n - 2 * pairs, n - pairs))
    assert lost <= 0.01 * pairs and len(found) == n
    assert len(blocks) == (further == 0) and all(0 < b <= n // 2 for b in blocks)


@pytest.mark.parametrize("few", [0, 8, graph.FEW_EDGES])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (None, 4)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 300: 200, 200: 200}
