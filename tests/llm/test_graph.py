from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quernstone.llm.graph import block_pairs, places
from quernstone.llm.shared import Work, cleanup


def test_places_fill_the_group(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") % 4 + 1).alias("n"))
    by = defaultdict(list)
    for r in places(df, "g", ["id"], F.col("n")).collect():
        by[r.g].append((r._place, r.n, r._size))
    for rows in by.values():
        at = 0
        for place, n, size in sorted(rows):
            assert place == at and size == sum(x[1] for x in rows)
            at += n


@pytest.mark.parametrize(("n", "least", "most"), [(23, 5, 5), (40, 2, 7), (64, 1, 100), (3, 5, 9)])
def test_every_two_rows_meet_once(spark, n, least, most):
    df = spark.range(n).select("id", F.lit(1).alias("g"))
    rows = block_pairs(places(df, "g", ["id"]), "g", least, most).select("_pair", "_block", "id").collect()
    met = defaultdict(int)
    for a in rows:
        for b in rows:
            same = a._pair == b._pair and (a._block != b._block or a._pair.i == a._pair.j)
            met[a.id, b.id] += same and a.id < b.id
    assert all(n == 1 for (a, b), n in met.items() if a < b)


def test_cleanup(spark, tmp_path):
    w = Work(spark, "x")
    w.save(spark.range(3), "t")
    cleanup()
    import os

    assert not os.path.exists(w.path.removeprefix("file://"))
