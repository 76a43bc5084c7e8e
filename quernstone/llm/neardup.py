"""Near-duplicate documents by an LSH forest over MinHash signatures.

Equal shingle sets are united first. Every tree sorts the distinct sets by a
label, its own eight values of the signature. Neighbours in that order with a
longest common prefix are candidates: the prefix of a row is as short as leaves
at most :data:`NEAR` rows that share it, so it is one value where the order is
sparse and up to eight where it is dense. What depth a row came to in each tree
gives the chance that a partner at the threshold was missed. Rows above
:data:`MISS` are searched again among themselves, in wider windows and more
orders, and what is left then in blocks of all pairs.

Candidates agree enough in their sketches and form clusters; links are confirmed
on the full sets. All pairs of a cluster meet in blocks, which copies a set
sixteen times at most. In a cluster beyond :data:`MOST_BLOCKED` that would grow
with its size, so there candidates are confirmed pair by pair: a forest of them
first, then those that the links so far leave in different components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textvec
from quernstone.llm.graph import BLOCKS, Forest, block_pairs, components, places
from quernstone.llm.shared import Work, fresh, salt_count

TREES, LEVELS = 16, 8
#: Rows of a neighbourhood, all of whose pairs are candidates in the first search; and of a window of the later ones.
NEAR, WINDOW = 16, 512
#: A pair at the threshold may be missed by the first search with this chance; then it is searched again.
MISS = 1e-4
#: Trees in which crowded places give a forest of candidates to begin with.
FOREST_TREES = 4
#: Values of eight bits in a sketch, and by how many standard deviations a pair at the
#: threshold may agree less and still be a candidate (about 3 in a million agree even less).
SKETCH = 64
SLACK = 4.5
#: Rows of an order that are handled at once.
PIECE = 8192
#: Sets in a block of exact comparison, and in one of a large cluster; a set of many shingles counts as several.
BLOCK, LARGEST_BLOCK = 128, 1024
BLOCK_SHINGLES = 1 << 18
#: Places of the largest cluster whose pairs are all compared.
MOST_BLOCKED = BLOCKS * LARGEST_BLOCK
_NULL_ID = -(1 << 63)
_RNG = np.random.default_rng(85)
_A = _RNG.integers(0, 1 << 31, TREES * LEVELS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TREES * LEVELS, dtype=np.uint32)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII capitals count as small letters."""
    w = textvec.words(texts)
    h = w.hashes(lower=True)
    spans = textvec.Spans(h)
    at = np.arange(max(0, len(h) - width + 1))
    grams = spans.hash(at, at + width)
    out = []
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(spans.hash(np.array([a]), np.array([b])) if b > a else grams[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * LEVELS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(out, ((short[i : i + 2048, None] ^ _B) * _A).min(axis=0), out=out)
    return out


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc")


def _keyed(df: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select(_id(), F.xxhash64(text).alias("th"), text.alias("text"))


def sketches(df: DataFrame, width: int) -> DataFrame:
    """``doc, th, n_shingles, node, s2, sig`` of every row; equal sets have equal ``node`` and ``s2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textvec.slices(batches):
            texts = b.column("text").to_pylist()
            for i, j in textvec.groups(texts):
                sets = shingle_sets(texts[i:j], width)
                one = [int(s.sum(dtype=np.uint64)) ^ len(s) for s in sets]
                two = [int(textvec.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) for s in sets]
                cols = [b.column("doc").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(map(len, sets), pa.int64())]
                cols += [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
                cols.append(pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "th", "n_shingles", "node", "s2", "sig"])

    return _keyed(df).mapInArrow(run, "doc long, th long, n_shingles long, node long, s2 long, sig binary")


def _sketch(sig: np.ndarray) -> np.ndarray:
    return (sig[:, : 2 * SKETCH : 2] & np.uint32(0xFF)).astype(np.uint8)


def _grow(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
    """A row per tree and set: its label in big-endian order (32 bits of the first value, 16 of the others), and the sketch.

    In each of :data:`LEVELS` turns every value of the signature begins one tree once.
    """
    for b in batches:
        sig = np.frombuffer(b"".join(x.as_py() for x in b.column("sig")), np.uint32).reshape(len(b), -1)
        sketch = pa.array([x.tobytes() for x in _sketch(sig)], pa.binary())
        for t in range(TREES):
            own = sig[:, [LEVELS * ((t + k * turn) % TREES) + (turn + k) % LEVELS for k in range(LEVELS)]]
            first, rest = own[:, :1].astype(">u4", order="C").view(np.uint8), (own[:, 1:] & np.uint32(0xFFFF)).astype(">u2", order="C").view(np.uint8)
            label = pa.array([x.tobytes() for x in np.concatenate([first, rest], 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), t, np.int32)), label, b.column("node"), b.column("comp"), sketch], names=["tree", "label", "node", "comp", "sketch"])


class _Piece:
    """Some rows of a sorted order; the first ``seen`` of them were in the piece before."""

    def __init__(self, rows: pa.Table, seen: int, open_start: bool, open_end: bool):
        n = len(rows)
        label = np.frombuffer(b"".join(rows.column("label").to_pylist()), np.uint8).reshape(n, -1)
        self.tree, self.node, self.comp = (rows.column(c).to_numpy() for c in ("tree", "node", "comp"))
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
        self.seen = seen
        new = np.ones(n, bool)
        new[1:] = self.tree[1:] != self.tree[:-1]
        #: By depth: where the run of each row with one prefix begins and ends, and whether it may go on beyond the piece.
        self.start, self.end, self.open = [], [], []
        for k in range(LEVELS):
            part = label[:, :4] if k == 0 else label[:, 2 * k + 2 : 2 * k + 4]
            new[1:] |= (part[1:] != part[:-1]).any(1)
            first = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            last = np.append(first[1:], n)
            self.start.append(first[run])
            self.end.append(last[run])
            self.open.append(((first[run] == 0) & open_start) | ((last[run] == n) & open_end))

    def depth(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The least depth at which a row's run is closed and holds at most ``most`` rows (0: none), and that run's end."""
        depth, end = np.zeros(len(self.node), np.int64), np.arange(len(self.node)) + 1
        for k in range(LEVELS - 1, -1, -1):
            fine = ~self.open[k] & (self.end[k] - self.start[k] <= most)
            depth[fine], end[fine] = k + 1, self.end[k][fine]
        return depth, end

    def miss(self, depth: np.ndarray, most: int, p: float) -> pa.RecordBatch:
        """By how much the log chance of a miss is above that of depth one; only rows where it is."""
        size = self.end[-1] - self.start[-1]
        hit = np.where(depth > 0, p ** depth, np.where(self.open[-1], 0, p**LEVELS * most / np.maximum(size, most)))
        rows = np.flatnonzero((depth != 1) & (np.arange(len(depth)) >= self.seen))
        return _found(self.node[rows], None, np.log1p(-hit[rows]) - math.log1p(-p))


def _found(a: np.ndarray, b: np.ndarray | None = None, miss: np.ndarray | None = None) -> pa.RecordBatch:
    """Candidate pairs ``a, b``; or rows ``a`` with their ``miss``; or, with neither, rows whose pairs were not all given."""
    cols = [pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.nulls(len(a), pa.float64()) if miss is None else pa.array(miss)]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "miss"])


_FOUND = "a long, b long, miss double"


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[_Piece]:
    """A sorted partition in pieces, cut between first values where that is possible."""
    held: pa.Table | None = None
    seen, open_start = 0, True
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        while len(held) - seen >= PIECE:
            tree = held.column("tree").to_numpy()
            first = np.frombuffer(b"".join(x[:4] for x in held.column("label").to_pylist()), ">u4")
            cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (first[1:] != first[:-1])) + 1
            cut = int(cuts[-1]) if len(cuts) else 0
            if cut >= max(seen + 1, len(held) // 2):
                yield _Piece(held.slice(0, cut).combine_chunks(), seen, open_start, False)
                held, seen, open_start = held.slice(cut), 0, False
            else:
                yield _Piece(held.combine_chunks(), seen, open_start, True)
                held, seen, open_start = held.slice(max(0, len(held) - window)), min(window, len(held)), True
    if held is not None and len(held) > seen:
        yield _Piece(held.combine_chunks(), seen, open_start, True)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal values of every two sketches."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for k in range(SKETCH):
        out += x[:, k, None] == y[None, :, k]
    return out


def _lagged(piece: _Piece, end: np.ndarray, lags: int, need: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Agreeing pairs of rows of different components, up to ``lags`` apart, the second below the ``end`` of the first."""
    out, n, x, comp = [], len(piece.node), piece.sketch, piece.comp
    for lag in range(1, lags + 1):
        i = np.flatnonzero(end[: n - lag] > np.arange(lag, n))
        if not len(i):
            break
        i = i[(i + lag >= piece.seen) & (comp[i] != comp[i + lag])]
        i = i[(x[i] == x[i + lag]).sum(1) >= need]
        out.append((i, i + lag))
    return out


def _spanning(a: np.ndarray, b: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which of the pairs join the components ``comp`` of their rows into the same groups as all of them do."""
    labels, pair = np.unique(np.stack([comp[a], comp[b]]), return_inverse=True)
    pair = np.sort(pair.reshape(2, -1), 0)
    _, first = np.unique(pair[0] * len(labels) + pair[1], return_index=True)
    forest = Forest(len(labels))
    return np.array([k for k in first.tolist() if forest.join(int(pair[0, k]), int(pair[1, k]))], np.int64)


def _given(node: np.ndarray, comp: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], every: bool) -> Iterator[pa.RecordBatch]:
    """All pairs if asked for or few; else a forest of them, and the rows that they are of."""
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    rows = np.unique(np.concatenate([a, b]))
    if not every and len(a) > 4 * len(rows):
        k = _spanning(a, b, comp)
        yield _found(node[rows])
        a, b = a[k], b[k]
    yield _found(node[a], node[b])


def _near(batches: Iterator[pa.RecordBatch], need: int, p: float) -> Iterator[pa.RecordBatch]:
    """The first search: all agreeing pairs of each row's neighbourhood, and a forest beyond it in some trees."""
    for piece in _pieces(batches, NEAR):
        depth, end = piece.depth(NEAR)
        yield piece.miss(depth, NEAR, p)
        pairs = _lagged(piece, end, NEAR - 1, need)
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield _found(piece.node[a], piece.node[b])
        crowd = np.where((depth != 1) & (piece.tree < FOREST_TREES), piece.end[0], 0)
        wide = _lagged(piece, crowd, NEAR, need)
        if wide:
            a, b = (np.concatenate(x) for x in zip(*wide, strict=True))
            k = _spanning(a, b, piece.comp)
            yield _found(piece.node[a[k]], piece.node[b[k]])


def _wide(batches: Iterator[pa.RecordBatch], need: int, p: float, every: bool) -> Iterator[pa.RecordBatch]:
    """A later search: agreeing pairs of different components in windows of the rows that share a first value."""
    for piece in _pieces(batches, WINDOW):
        yield piece.miss(piece.depth(WINDOW)[0], WINDOW, p)
        start, end = piece.start[0], piece.end[0]
        small = end - start <= NEAR
        pairs = _lagged(piece, np.where(small, end, 0), NEAR - 1, need)
        for s in np.unique(start[~small]).tolist():
            e = int(end[s])
            for i in range(max(s, piece.seen), e, 256):
                j, lo = min(i + 256, e), max(s, i - WINDOW)
                other = piece.comp[lo:j, None] != piece.comp[None, i:j]
                if not other.any():
                    continue
                a, b = np.nonzero((_agree(piece.sketch[lo:j], piece.sketch[i:j]) >= need) & other)
                a, b = a + lo, b + i
                ok = (a < b) & (b - a <= WINDOW)
                pairs.append((a[ok], b[ok]))
        yield from _given(piece.node, piece.comp, pairs, every)


def _blocks(batches: Iterator[pa.RecordBatch], need: int, every: bool) -> Iterator[pa.RecordBatch]:
    """All agreeing pairs of different components of two blocks at a time; sorted by pair of blocks."""
    held: list[pa.RecordBatch] = []
    own = None

    def settle() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        node, comp, block = (rows.column(c).to_numpy() for c in ("node", "comp", "_block"))
        x = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(node), SKETCH)
        pairs = []
        for i in range(0, len(node), 256):
            fine = (comp[i : i + 256, None] != comp[None, :]) & ((block[i : i + 256, None] != block[None, :]) | (block[0] == block[-1]))
            if fine.any():
                a, b = np.nonzero((_agree(x[i : i + 256], x) >= need) & fine)
                a += i
                pairs.append((a[a < b], b[a < b]))
        return _given(node, comp, pairs, every)

    for b in batches:
        keys = b.column("_pair").to_pylist()
        cuts = [k for k in range(1, len(b)) if keys[k] != keys[k - 1]]
        for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True):
            if i == j:
                continue
            if held and keys[i] != own:
                yield from settle()
                held = []
            own = keys[i]
            held.append(b.slice(i, j - i))
    if held:
        yield from settle()


def agreeing(percent: int) -> int:
    """Equal sketch values that a candidate needs."""
    p = percent / 100
    return max(1, int(SKETCH * p - SLACK * np.sqrt(SKETCH * p * (1 - p))))


def _sorted_trees(rows: DataFrame, turn: int, search: Callable, parts: int) -> DataFrame:
    trees = rows.select("node", "comp", "sig").mapInArrow(partial(_grow, turn=turn), "tree int, label binary, node long, comp long, sketch binary")
    ordered = trees.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return ordered.mapInArrow(search, _FOUND)


def _missed(found: DataFrame, turns: int, p: float) -> DataFrame:
    """Nodes that may lack a partner with more than the chance allowed, after ``turns`` turns of the trees."""
    sums = found.filter("miss is not null").groupBy(F.col("a").alias("node")).agg(F.sum("miss").alias("miss"))
    return sums.filter(F.col("miss") + turns * TREES * math.log1p(-p) > math.log(MISS)).select("node")


def _search_again(rows: DataFrame, percent: int, every: bool, work: Work, name: str) -> DataFrame:
    """Found pairs of different components among ``rows(node, comp, sig)``: by turns of the trees while these cost less than blocks, then by blocks."""
    parts, p, need = salt_count(rows.sparkSession), percent / 100, agreeing(percent)
    out, turn, left = [], 0, rows
    while left.count() > 2 * LARGEST_BLOCK * TREES and turn < LEVELS:
        found = _sorted_trees(left, turn, partial(_wide, need=need, p=p, every=every), parts)
        out.append(work.save(found, f"{name}-found{turn}"))
        turn += 1
        all_ = out[0]
        for o in out[1:]:
            all_ = all_.union(o)
        left = work.save(rows.join(_missed(all_, turn, p), "node", "left_semi"), f"{name}-left{turn}")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(x.as_py() for x in b.column("sig")), np.uint32).reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int32)), b.column("node"), b.column("comp"), pa.array([x.tobytes() for x in _sketch(sig)], pa.binary())], names=["all", "node", "comp", "sketch"])

    placed = places(left.select("node", "comp", "sig").mapInArrow(sketched, "all int, node long, comp long, sketch binary"), "all", ["node"])
    dealt = block_pairs(placed, "all", BLOCK, LARGEST_BLOCK).select("_pair", "_block", "node", "comp", "sketch")
    dealt = dealt.repartition(parts, "_pair").sortWithinPartitions("_pair", "_block", "node")
    out.append(work.save(dealt.mapInArrow(partial(_blocks, need=need, every=every), _FOUND), f"{name}-blocks"))
    found = out[0]
    for o in out[1:]:
        found = found.union(o)
    return found


def confirmed(sets: list[np.ndarray], block: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs with ``100 * common >= percent * union``; of two blocks, the pairs across."""
    n = np.array([len(s) for s in sets])
    across = block[0] != block[-1]
    forest = Forest(len(sets))
    if len(sets) <= 4:
        for i in range(len(sets)):
            for j in range(i):
                if not across or block[i] != block[j]:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (n[i] + n[j] - common) and forest.join(i, j):
                        yield j, i
        return
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    name = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(len(sets)), n)
    use = counts[column] > 1  # the others are in no intersection
    row, column = row[use], name[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, total, width):
        i, j = np.searchsorted(column, [c, c + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[i:j], column[i:j] - c] = 1
        common += part @ part.T  # whole numbers below 2**24 stay exact
    common = common.astype(np.int64)
    hit = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    if across:
        hit &= block[:, None] != block[None, :]
    for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        if forest.join(int(i), int(j)):
            yield int(i), int(j)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = [(nodes[i], nodes[j]) for i, j in confirmed(sets, np.array(blocks), percent)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        pair, nodes, blocks, sets = None, [], [], []
        for b in batches:
            keys, lists = b.column("_pair").to_pylist(), b.column("shingles")
            for p, block, node, raw in zip(keys, b.column("_block"), b.column("node"), lists, strict=True):
                if p != pair:
                    if len(nodes) > 1:
                        yield flush()
                    pair, nodes, blocks, sets = p, [], [], []
                nodes.append(node.as_py())
                blocks.append(block.as_py())
                sets.append(raw.values.to_numpy().view(np.uint64))
        if len(nodes) > 1:
            yield flush()

    return run


def _in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A forest of the links in each cluster of ``members(cluster, node, _place, _size)``."""
    dealt = block_pairs(members.join(sets, "node"), "cluster", BLOCK, LARGEST_BLOCK).select("_pair", "_block", "node", "shingles")
    dealt = dealt.repartition(salt_count(members.sparkSession), "_pair").sortWithinPartitions("_pair", "_block", "node")
    return dealt.mapInArrow(_confirm(percent), "a long, b long")


def by_pair(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets of ``sets(node, n, shingles)`` have ``100 * common >= percent * union``."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    # Sizes alone rule out many pairs before their sets meet.
    sized = pairs.join(one.drop("sa"), "a").join(two.drop("sb"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = sized.join(one, "a").join(two, "b")
    return both.filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def groups(df: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc, th, n_shingles, component`` of every row; ``component`` is the least ``doc`` that links reach.

    ``doc`` is ``doc_id`` with null as the least value. Texts without words have
    no shingles, link with nothing and are their own component. Rows of one
    ``doc_id`` whose texts differ stay separate documents.
    """
    spark, work = df.sparkSession, Work(df.sparkSession, "neardup")
    parts, p, need = salt_count(spark), percent / 100, agreeing(percent)
    known = work.save(sketches(df, width), "sketches")
    some = known.filter("n_shingles > 0")
    reps = some.groupBy("node", "s2").agg(F.min(F.struct("doc", "th")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    reps = work.save(reps, "reps")
    found = work.save(_sorted_trees(reps.withColumn("comp", F.col("node")), 0, partial(_near, need=need, p=p), parts), "found")
    pairs = work.save(_pairs(found), "pairs")
    again = work.save(_missed(found, 1, p), "again")
    clusters = components(pairs, Work(spark, "neardup-clusters"))
    if not again.isEmpty():
        # Pairs that join clusters are enough, as every cluster is looked at whole.
        rows = work.save(_labelled(reps.join(again, "node"), clusters), "rows-again")
        more = work.save(_pairs(_search_again(rows, percent, False, work, "again")), "pairs-again")
        if not more.isEmpty():
            pairs = pairs.union(more)
            clusters = components(pairs, Work(spark, "neardup-clusters"))
    # A set of many shingles takes the room of several in its block.
    room = F.greatest(F.lit(1), F.expr(f"cast(ceil(n * {BLOCK} / {BLOCK_SHINGLES}) as long)"))
    members = reps.join(clusters.withColumnsRenamed({"id": "node", "component": "cluster"}), "node").select("cluster", "node", "n", "rep.doc", "rep.th")
    members = work.save(places(members, "cluster", ["node"], room), "members")
    sets = _sets(df, members.select("node", "n", "doc", "th"), width, work)
    links = work.save(_in_blocks(members.filter(F.col("_size") <= MOST_BLOCKED).select("cluster", "node", "_place", "_size"), sets, percent), "links")
    large = members.filter(F.col("_size") > MOST_BLOCKED).select("node")
    if not large.isEmpty():
        links = links.union(work.save(by_pair(pairs.join(large.withColumnRenamed("node", "a"), "a", "left_semi"), sets, percent), "links-large"))
    linked = components(links.filter("a <> b"), Work(spark, "neardup-links"))
    for every in (False, True):
        if large.isEmpty():
            break
        rows = work.save(_labelled(reps.join(large, "node"), linked), f"rows-{every}")
        found = _search_again(rows, percent, every, work, f"large-{every}")
        more = work.save(by_pair(_pairs(found), sets, percent), f"links-{every}")
        large = work.save(found.filter("b is null and miss is null").select(F.col("a").alias("node")).distinct(), f"left-{every}")
        if not more.isEmpty():
            links = links.union(more)
            linked = components(links.filter("a <> b"), Work(spark, "neardup-links"))
    # The least document is found among the distinct sets; documents then join once, by their set.
    labelled = reps.select("node", "rep.doc").join(linked.withColumnRenamed("id", "node"), "node")
    least = labelled.groupBy("component").agg(F.min("doc").alias("least"))
    linked = labelled.join(least, "component").select("node", "least")
    classes = reps.select("node", "s2", "rep.doc").join(linked, "node", "left").select("node", "s2", F.coalesce("least", "doc").alias("component"))
    own = known.select("doc", "th", "n_shingles", "node", "s2").filter("n_shingles > 0").join(classes, ["node", "s2"])
    none = known.filter("n_shingles = 0").select("doc", "th", "n_shingles", F.col("doc").alias("component"))
    return own.select("doc", "th", "n_shingles", "component").union(none)


def _labelled(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``node, sig, comp`` of ``rows``; a node in no component is its own."""
    return rows.join(components.withColumnRenamed("id", "node"), "node", "left").select("node", "sig", F.coalesce("component", "node").alias("comp"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _sets(df: DataFrame, nodes: DataFrame, width: int, work: Work) -> DataFrame:
    """``node, n, shingles`` of ``nodes(node, n, doc, th)``, from their whole texts."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textvec.slices(batches):
            rows = b.column("text").to_pylist()
            for i, j in textvec.groups(rows):
                sets = shingle_sets(rows[i:j], width)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), b.column("n").slice(i, j - i), lists], names=["node", "n", "shingles"])

    # A row for each node, also where rows of one id and text are repeated; no shuffle besides the join's.
    # The nodes grow with the input, so the join is the same at every size.
    texts = _keyed(df).join(nodes.hint("merge"), ["doc", "th"]).dropDuplicates(["doc", "th"]).select("node", "n", "text")
    return work.save(texts.mapInArrow(full, "node long, n long, shingles array<long>"), "sets")


def _original(c: str) -> Column:
    return F.when(F.col(c) != _NULL_ID, F.col(c))


def digest_rows(df: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``df(doc_id, text)``."""
    out = groups(df, width, percent)
    return out.select(_original("doc").alias("doc_id"), "n_shingles", _original("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def keep_first(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` (all columns) that are the first of their group of near copies.

    Texts without words stay. Equal rows of the first document stay once each.
    No column name of ``df`` is in the way.
    """
    doc, th = fresh(df.columns, "_doc", "_th")
    gone = groups(df, width, percent).filter("doc <> component").select(F.col("doc").alias(doc), F.col("th").alias(th)).distinct()
    own = df.withColumn(doc, F.coalesce("doc_id", F.lit(_NULL_ID))).withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(gone, [doc, th], "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
