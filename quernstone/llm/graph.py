"""Connected components of an edge table, by contraction.

Every round joins each node to its least neighbour (by id, then by a round's
hash, so that no ordering of ids makes long chains) and keeps only edges between
different groups. No neighbour list is ever collected: hubs are pre-aggregated,
and joins are plain equi-joins that adaptive execution can split. Once at most
:data:`FEW_EDGES` edges are left, one task unites what they join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.shared import Work, salt_count


#: A bound for one task: so many edges are 4 MB of ids.
FEW_EDGES = 1 << 18


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node that each node of a small edge table is joined to."""
    held = [np.stack([b.column(c).to_numpy() for c in ("a", "b")]) for b in batches]
    nodes, pairs = np.unique(np.concatenate([np.empty((2, 0), np.int64), *held], 1), return_inverse=True)
    forest = Forest(len(nodes))
    for i, j in pairs.reshape(2, -1).T.tolist():
        forest.join(i, j)
    up = np.array([forest.find(i) for i in range(len(nodes))], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["node", "parent"])


def components(edges: DataFrame, work: Work) -> DataFrame:
    """``id, component`` (the least id of its component) of every node of ``edges(a, b)``.

    Loops and repeated edges count once; nulls are no nodes. Without edges: no rows.
    """
    e = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = work.save(e.distinct(), "edges0")
    label = work.save(e.select(F.col("a").alias("id")).union(e.select("b")).distinct().select("id", F.col("id").alias("label")), "labels0")
    e = e.filter("a <> b")
    k = 0
    while (n := e.count()) > FEW_EDGES:
        both = e.union(e.select("b", "a"))
        if k % 2 == 0:
            parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("parent"))
        else:
            rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
            parent = both.groupBy("a").agg(F.min(rank("b")).alias("other")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("other"))["v"].alias("parent"))
        parent = work.save(parent, f"parents{k}")
        up = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        e2 = e.join(parent.withColumnsRenamed({"node": "a", "parent": "pa"}), "a").join(up, "b").filter("pa <> pb")
        e2 = work.save(e2.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"edges{k + 1}")
        moved = label.join(parent.withColumnRenamed("node", "label"), "label", "left").select("id", F.coalesce("parent", "label").alias("label"))
        label = work.save(moved, f"labels{k + 1}")
        work.drop(f"edges{k}", f"labels{k}", f"parents{k}")
        e, k = e2, k + 1
    if n:
        parent = work.save(e.repartition(1).mapInArrow(_unite, "node long, parent long"), f"parents{k}")
        label = label.join(parent.withColumnRenamed("node", "label"), "label", "left").select("id", F.coalesce("parent", "label").alias("label"))
    if k == 0:  # no round has run, so each label is the least id of its component
        return work.save(label.select("id", F.col("label").alias("component")), "components")
    least = label.groupBy("label").agg(F.min("id").alias("component"))
    return work.save(label.join(least, "label").select("id", "component"), "components")


class Forest:
    """Union-find over small integers, for the rows of one block."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def places(members: DataFrame, group: str, order: list[str], room: Column | None = None) -> DataFrame:
    """Adds ``_place``, where each row begins in its group, and ``_size`` of the group.

    A row takes ``room`` places (1 if not given). Rows of a group are summed in
    salted parts, whose totals, a few rows a group, are summed after; so a group
    that holds a third of all rows is no single task.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salt_count(members.sparkSession)))
    keyed = members.withColumn("_salt", salt).withColumn("_room", (F.lit(1) if room is None else room).cast("long"))
    here = Window.partitionBy(group, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = keyed.withColumn("_upto", F.sum("_room").over(here))
    totals = keyed.groupBy(group, "_salt").agg(F.sum("_room").alias("_part"))
    before = F.sum("_part").over(Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(group, "_salt", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_part").over(Window.partitionBy(group)).alias("_size"))
    placed = local.join(totals, [group, "_salt"])
    return placed.select(*members.columns, (F.col("_before") + F.col("_upto") - F.col("_room")).alias("_place"), "_size")


#: A large group is cut into about so many blocks before its blocks grow.
BLOCKS = 16


def block_pairs(members: DataFrame, group: str, least: int, most: int) -> DataFrame:
    """Rows of ``members`` dealt to tasks that see two blocks of a group at a time.

    ``members`` has ``group`` and a dense ``_place`` in it and ``_size``. A block
    holds ``least`` places, in large groups more, up to ``most``, so that a row is
    copied to about ``_size / most`` tasks at worst. A row of block ``i`` of ``n``
    goes to the ``n`` pairs that hold it: every two rows of a group meet in
    exactly one pair of different blocks, or in ``(i, i)``.
    """
    own = members.withColumn("_wide", F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.col("_size") / BLOCKS))).cast("int"))
    own = own.withColumn("_block", F.expr("cast(_place div _wide as int)"))
    own = own.withColumn("_with", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_size") / F.col("_wide")) - 1).cast("int"))))
    return own.withColumn("_pair", F.struct(F.col(group), F.least("_block", "_with").alias("i"), F.greatest("_block", "_with").alias("j"))).drop("_wide")
