"""Near-duplicate vectors by sorted projection passes.

A pass gives each vector a code of concatenated random sign bits, sorts ids by the
code, numbers them, and compares every vector with the :data:`WINDOW` before it in
that order; a window depends on the numbers only, not on how rows are partitioned.
Verified pairs of all passes are united. How well a pass thins the order around a
vector is measured there, and vectors in regions too dense for the passes so far
go on through further passes; where those measures say that too many would be
needed, the vectors left are compared with each other block by block. Neither
step is chosen by the size of the input. The links of a vector all lie in its component, so its number of
links is counted there, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.graph import Forest, block_pairs, components, places
from quernstone.llm.shared import Work, salt_count

LEAST_COSINE = 0.9
WINDOW = 512
BITS = 40
#: A pair just at the threshold is missed by all passes with about this probability.
MISS = 0.005
BLOCK, LARGEST_BLOCK = 128, 1024
SEED = 91
#: Windows in a stretch of the order, which one task compares and measures at once; and about the fewest rows of a task.
STRETCH, LEAST_TASK = 16, 1 << 13
#: Passes of one further round; and beyond how many further passes what is left is compared all with all.
ROUND, MOST_FURTHER = 64, 512
_NULL_ID = -(1 << 63)
_GRID = np.linspace(0, 5, 2048)
_PHI = np.array([0.5 * (1 + math.erf(t / math.sqrt(2))) for t in _GRID])


def passes(n: int, window: int = WINDOW, miss: float = MISS, cosine: float = LEAST_COSINE) -> int:
    """How many passes keep the chance of a miss below ``miss`` among ``n`` vectors of even directions."""
    same = 1 - math.acos(cosine) / math.pi
    hit = same ** max(0.0, math.log2(max(n, 1) / window))
    return max(4, math.ceil(math.log(miss) / math.log(1 - min(hit, 0.9))))


def planes(k: int, dims: int) -> np.ndarray:
    """The random directions of a pass."""
    return np.random.default_rng((SEED, k, dims)).normal(size=(dims, BITS))


def usable(c: str = "embedding") -> Column:
    """Neither null nor zero, all components present and finite."""
    v = F.col(c)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def log_miss(codes: np.ndarray, margins: np.ndarray, window: int, least: float, first: bool, last: bool) -> np.ndarray:
    """Log of the chance that a pass misses a pair at cosine ``least``, for each row of a piece of its order.

    ``margins`` are the rows' distances from the planes in standard deviations of
    a random direction across the row; the chance that a partner in such a
    direction is on the same side follows from them. Where it first is on the other side, it lies among the rows that
    leave the row's run with that bit, and is met if the window reaches it.
    ``first`` and ``last`` tell whether the order begins and ends with the piece;
    rows that leave towards an open end are not counted as met.
    """
    n = len(codes)
    at = np.arange(n)
    hit, reached = np.zeros(n), np.ones(n)
    lo, hi = np.zeros(n, np.int64), np.full(n, n)
    slope = least / math.sqrt(1 - least * least) if least < 1 else np.inf

    def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The share of the places from ``a`` to ``b`` that the window reaches; of none, whether it reaches there."""
        size = b - a
        inside = np.minimum(b, at + window + 1) - np.maximum(a, at - window)
        share = np.where(size > 0, np.maximum(inside, 0) / np.maximum(size, 1), inside >= 0)
        return np.where(((a == 0) & (not first)) | ((b == n) & (not last)), 0.0, share)

    for k in range(BITS):
        same = np.interp(np.abs(margins[:, k]) * slope, _GRID, _PHI)
        bounds = np.append(np.flatnonzero(np.diff(codes >> (BITS - 1 - k), prepend=-1)), n)
        run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        lo2, hi2 = bounds[run], bounds[run + 1]
        up = (codes >> (BITS - 1 - k)) & 1 == 1
        hit += reached * (1 - same) * np.where(up, met(lo, lo2), met(hi2, hi))
        reached, lo, hi = reached * same, lo2, hi2
        if np.diff(bounds).max(initial=0) <= window and k % 4 == 3:
            break
    return np.log1p(-np.minimum(hit + reached * met(lo, hi), 0.999))


def near_edges(vectors: DataFrame, n: int, window: int = WINDOW, least: float = LEAST_COSINE, kind: str = "<f4") -> DataFrame:
    """A spanning forest ``a, b`` of verified pairs; one at cosine ``least`` is missed with a chance of about :data:`MISS`.

    ``vectors(id, dims, raw)``: distinct vectors as little-endian floats of numpy type ``kind``.
    After the passes that vectors of even directions need, at every size of the
    input, each vector has a measured chance that a pair of it was missed. Those
    above :data:`MISS` meet each other in further passes; a pair of theirs is
    settled when either is. All pairs of them are compared once a tenth of them
    would need more than :data:`MOST_FURTHER` further passes, as the measures go.
    """
    work = Work(vectors.sparkSession, "windows")
    first = passes(n, window, cosine=least)
    left, missed, edges, done, count = vectors, None, [], 0, first
    while True:
        found, chance = window_edges(left, n, done, count, work, window, least, kind)
        edges.append(found)
        chance = chance if missed is None else chance.union(missed)
        chance = chance.groupBy("id").agg(F.sum("miss").alias("miss")).filter(F.col("miss") > math.log(MISS))
        done += count
        missed = work.save(chance, f"missed{done}")
        # A vector without any hit so far counts as one with a hit in a thousand.
        need = F.ceil(done * (math.log(MISS) / F.least("miss", F.lit(-0.001 * done)) - 1))
        n, need = missed.agg(F.count(F.lit(1)), F.percentile_approx(need, 0.9)).first()
        if not n:
            return _union(edges)
        left, count = work.save(vectors.join(missed.select("id"), "id", "left_semi"), f"left{done}"), min(max(need, 1), ROUND)
        if done - first + need > MOST_FURTHER:
            return _union([*edges, block_edges(left, least, kind=kind)])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def block_edges(vectors: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK, kind: str = "<f4") -> DataFrame:
    """A spanning forest ``a, b`` of all linked pairs of ``vectors(id, dims, raw)``."""
    placed = places(vectors.select("id", "dims", "raw"), "dims", ["id"])
    dealt = block_pairs(placed, "dims", block, LARGEST_BLOCK).select("_pair", "_block", "id", "raw")
    dealt = dealt.repartition(salt_count(vectors.sparkSession), "_pair").sortWithinPartitions("_pair", "_block")

    def spanning(rows: list[tuple]) -> list[tuple[int, int]]:
        x = unit(_matrix([r[1] for r in rows], kind))
        hit = x @ x.T >= least
        np.fill_diagonal(hit, False)
        apart, out = np.ones(len(rows), bool), []
        for root in np.flatnonzero(hit.any(axis=1)).tolist():
            todo = [root] if apart[root] else []
            apart[root] = False
            while todo:
                i = todo.pop()
                new = np.flatnonzero(hit[i] & apart).tolist()
                apart[new] = False
                out += [(rows[i][0], rows[j][0]) for j in new]
                todo += new
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = spanning(rows)
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        pair, rows = None, []
        for b in batches:
            for p, *row in zip(*(b.column(c).to_pylist() for c in ("_pair", "id", "raw")), strict=True):
                if p != pair and rows:
                    yield flush()
                    rows = []
                pair = p
                rows.append(tuple(row))
        if rows:
            yield flush()

    return dealt.mapInArrow(run, "a long, b long")


def window_edges(vectors: DataFrame, n: int, done: int, count: int, work: Work, window: int = WINDOW, least: float = LEAST_COSINE, kind: str = "<f4") -> tuple[DataFrame, DataFrame]:
    """``a, b`` of every window of ``count`` passes after the first ``done``, and ``id, miss`` of every vector and pass.

    Only ids and codes are sorted. The numbered order is cut into stretches; a
    stretch fetches its vectors, and those within a window of its ends, by id.
    """
    parts = max(1, min(salt_count(vectors.sparkSession), n * count // LEAST_TASK))
    wide = STRETCH * window

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                x = _matrix(own.column("raw").to_pylist(), kind)
                x /= np.abs(x).max(axis=1, keepdims=True)
                for k in range(done, done + count):
                    codes = (x @ planes(k, int(d)) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), own.column("dims"), own.column("id"), pa.array(codes)], names=["pass", "dims", "id", "code"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), pa.array(np.arange(at, at + len(b)))], names=[*b.schema.names, "part", "place"])
            at += len(b)

    def pairs(x: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """A forest of the pairs of rows ``lo`` to ``hi`` with up to ``window`` rows before each."""
        forest = Forest(len(x))
        for i in range(lo, hi, 256):
            j = min(i + 256, hi)
            first = max(0, i - window)
            r, c = np.nonzero(x[i:j] @ x[first:j].T >= least)
            r, c = r + i, c + first
            ok = (c < r) & (r - c <= window)
            for a, b in zip(r[ok].tolist(), c[ok].tolist(), strict=True):
                if forest.join(a, b):
                    yield b, a

    def stretch(own: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rank, ids, codes = (rows.column(c).to_numpy() for c in ("rank", "id", "code"))
        key = np.stack([rows.column(c).to_numpy() for c in ("pass", "dims")], 1)
        raw = rows.column("raw").to_pylist()
        cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
            lo, hi = (int(k) for k in np.searchsorted(rank[i:j], [own * wide, (own + 1) * wide]))
            if lo == hi:
                continue  # only rows near a neighbouring stretch
            x = unit(_matrix(raw[i:j], kind))
            found = np.array(list(pairs(x, lo, hi)), np.int64).reshape(-1, 2)
            yield made(ids[i:j][found[:, 0]], ids[i:j][found[:, 1]], None)
            g = planes(int(key[i][0]), int(key[i][1]))
            along = x @ g
            across = np.sqrt(np.maximum((g * g).sum(0) - along * along, 1e-12) / max(1, len(g) - 1))
            chance = log_miss(codes[i:j], along / across, window, least, i > 0 or rank[0] == 0, j < len(rows) or rank[-1] == n * count - 1)
            yield made(ids[i + lo : i + hi], None, chance[lo:hi])

    def made(a: np.ndarray, b: np.ndarray | None, miss: np.ndarray | None) -> pa.RecordBatch:
        cols = [pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.nulls(len(a), pa.float64()) if miss is None else pa.array(miss)]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "miss"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        own = -1
        for b in batches:
            keys = b.column("stretch").to_numpy()
            cuts = (np.flatnonzero(np.diff(keys)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if i == j:
                    continue
                if held and keys[i] != own:
                    yield from stretch(own, pa.Table.from_batches(held))
                    held = []
                own = int(keys[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from stretch(own, pa.Table.from_batches(held))

    coded = vectors.mapInArrow(code, "pass int, dims int, id long, code long")
    ordered = coded.repartitionByRange(parts, "pass", "dims", "code", "id").sortWithinPartitions("pass", "dims", "code", "id")
    numbered = work.save(ordered.mapInArrow(number, "pass int, dims int, id long, code long, part int, place long"), f"numbered{done}")
    before = _starts(numbered, parts)
    rank = numbered.join(F.broadcast(before), "part").withColumn("rank", F.col("place") + F.col("before"))
    near = F.array_distinct(F.array(F.expr(f"greatest(rank - {window}, 0L) div {wide}"), F.expr(f"rank div {wide}"), F.expr(f"(rank + {window}) div {wide}")))
    dealt = rank.select("pass", "dims", "id", "code", "rank", F.explode(near).alias("stretch")).join(vectors.select("id", "raw"), "id")
    dealt = dealt.select("stretch", "rank", "pass", "dims", "id", "code", "raw").repartition(parts, "stretch").sortWithinPartitions("stretch", "rank")
    swept = work.save(dealt.mapInArrow(sweep, "a long, b long, miss double"), f"swept{done}")
    return swept.filter("b is not null").select("a", "b"), swept.filter("b is null").select(F.col("a").alias("id"), "miss")


def _starts(numbered: DataFrame, parts: int) -> DataFrame:
    """``part, before``: how many rows come before each of the ``parts`` range partitions; one row each."""
    size = dict(numbered.groupBy("part").agg(F.max("place") + 1).collect())
    rows, total = [], 0
    for part in range(parts):
        rows.append((part, total))
        total += size.get(part, 0)
    return numbered.sparkSession.createDataFrame(rows, "part int, before long")


def link_counts(members: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK, kind: str = "<f4") -> DataFrame:
    """``id, links``: rows that each distinct vector of ``members(id, n, raw, component)`` links to, its copies left out."""
    placed = places(members.select("id", "n", "raw", "component"), "component", ["id"])
    dealt = block_pairs(placed, "component", block, max(block, LARGEST_BLOCK)).select("_pair", "_block", "id", "n", "raw")
    parts = salt_count(members.sparkSession)
    dealt = dealt.repartition(parts, "_pair").sortWithinPartitions("_pair", "_block")

    def count(rows: list[tuple]) -> tuple[list[int], np.ndarray]:
        ids = [r[1] for r in rows]
        x = unit(_matrix([r[3] for r in rows], kind))
        n, blk = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
        hit = (x @ x.T >= least) & ((blk[:, None] != blk[None, :]) | (blk[0] == blk[-1]))
        np.fill_diagonal(hit, False)
        return ids, hit @ n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            ids, links = count(rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["id", "links"])

        pair, rows = None, []
        for b in batches:
            for p, *row in zip(*(b.column(c).to_pylist() for c in ("_pair", "_block", "id", "n", "raw")), strict=True):
                if p != pair and rows:
                    yield flush()
                    rows = []
                pair = p
                rows.append(tuple(row))
        if rows:
            yield flush()

    return dealt.mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, window: int = WINDOW, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``df(vec_id, embedding)``.

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different length. Equal vectors are united before
    any comparison, so copies cost nothing. Rows of one id are separate vectors;
    a null id is the least. Other columns are left out, and no name is in the way.
    Components are read as doubles if the input has doubles, else as 32-bit
    floats, and always compared in double precision.
    """
    work = Work(df.sparkSession, "vectors")
    double = df.select("embedding").schema[0].dataType.elementType == T.DoubleType()
    kind, name = ("<f8", "double") if double else ("<f4", "float")
    keyed = df.select(F.coalesce("vec_id", F.lit(_NULL_ID)).alias("vec"), F.col("embedding").cast(f"array<{name}>").alias("embedding")).withColumn("_ok", usable())
    fine = keyed.filter("_ok").select("vec", F.xxhash64("embedding").alias("id"), F.xxhash64(F.lit(SEED), "embedding").alias("k2"), "embedding")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(x.values, kind) for x in b.column("embedding")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec", "id", "k2")), pa.array(map(len, rows), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec", "id", "k2", "dims", "raw"])

    fine = work.save(fine.mapInArrow(packed, "vec long, id long, k2 long, dims int, raw binary"), "fine")
    distinct = fine.groupBy("id", "k2").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.first("dims").alias("dims"), F.first("raw").alias("raw"))
    distinct = work.save(distinct, "distinct")
    edges = near_edges(distinct.select("id", "dims", "raw"), distinct.count(), window, least, kind)
    found = components(edges, work)
    grouped = work.save(distinct.join(found, "id"), "grouped")
    counts = link_counts(grouped, least, kind=kind)
    first = grouped.groupBy("component").agg(F.min("vec").alias("least"))
    classes = distinct.select("id", "k2", "n", "vec").join(grouped.select("id", "component").join(first, "component").select("id", "least"), "id", "left").join(counts, "id", "left")
    classes = classes.select("id", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "vec").alias("component"))
    linked = fine.select("vec", "id", "k2").join(classes, ["id", "k2"]).select("vec", "n_links", "component")
    alone = keyed.filter(~F.col("_ok")).select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    null = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return linked.union(alone).select(null("vec").alias("vec_id"), "n_links", null("component").alias("component_id"), (F.col("vec") == F.col("component")).alias("kept"))
