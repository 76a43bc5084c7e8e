"""Best-fit packing of token pieces by large-item matching, from length counts.

Lengths lie between 1 and the capacity, so the histogram of lengths is the
whole packing problem: its size is bounded by the capacity, not by the data.
The driver packs the histogram; executors then give each piece the slot of its
rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.shared import Work, salt_count
from quernstone.llm.tokens import encoder

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1


@dataclass(frozen=True)
class Bins:
    """``count`` equal bins holding runs ``(length, times)`` in order."""

    runs: tuple[tuple[int, int], ...]
    count: int


@dataclass(frozen=True)
class Slot:
    """Pieces of a length with ranks from ``first`` on: ``times`` in each of ``count`` sequences."""

    length: int
    first: int
    times: int
    count: int
    sequence: int
    offset: int


def match_large(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Bins of one or two pieces above a third of the capacity: the longest with the longest that fits beside it."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left)
    out = []
    while order:
        a = order[-1]
        i = bisect_left(order, capacity - a + 1) - 1
        if i < 0 or order[i] == a and left[a] == 1:
            i -= 1 if i >= 0 else 0
        if i < 0:
            out.append(Bins(((a, 1),), left[a]))
            left[a] = 0
        elif (b := order[i]) == a:
            out.append(Bins(((a, 2),), left[a] // 2))
            left[a] %= 2
        else:
            n = min(left[a], left[b])
            out.append(Bins(((a, 1), (b, 1)), n))
            left[a] -= n
            left[b] -= n
        order = [n for n in order if left[n]] if not left[a] else [n for n in order if n == a or left[n]]
    return out


def fit_small(bins: list[Bins], counts: dict[int, int], capacity: int) -> list[Bins]:
    """Adds the small pieces, longest first, each to the smallest gap that holds it."""
    by_gap: dict[int, list[Bins]] = defaultdict(list)
    gaps: list[int] = []

    def put(b: Bins) -> None:
        gap = capacity - sum(n * k for n, k in b.runs)
        if not by_gap[gap]:
            insort(gaps, gap)
        by_gap[gap].append(b)

    for b in bins:
        put(b)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                b = Bins((), -(-left // (capacity // length)))
                gap = capacity
            else:
                gap = gaps[i]
                b = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps.pop(i)
            # No smaller gap holds this length, so a bin takes as many as fit before the next one does.
            times = gap // length
            full = min(b.count, left // times)
            if full:
                put(Bins((*b.runs, (length, times)), full))
                left -= full * times
            rest = b.count - full
            if rest and 0 < left < times:
                put(Bins((*b.runs, (length, left)), 1))
                rest, left = rest - 1, 0
            if rest and b.runs:
                put(Bins(b.runs, rest))
    return [b for group in by_gap.values() for b in group]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Slots for all pieces of a length histogram."""
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    large = {n: c for n, c in counts.items() if 3 * n > capacity}
    bins = fit_small(match_large(large, capacity), {n: c for n, c in counts.items() if n not in large}, capacity)
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for b in sorted(bins, key=lambda b: b.runs, reverse=True):
        offset = 0
        for length, times in b.runs:
            slots.append(Slot(length, used[length], times, b.count, sequence, offset))
            used[length] += times * b.count
            offset += length * times
        sequence += b.count
    return slots


def pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of ``df(doc_id, text)``; null text has the end id alone.

    A document of at most ``capacity`` ids is one piece; a longer one is cut
    every ``capacity`` ids. ``with_ids`` adds them as little-endian 32-bit bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(b), 512):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
                for doc_id, own in zip(ids.slice(at, 512).to_pylist(), enc.encode(texts.slice(at, 512).to_pylist()), strict=True):
                    raw = np.append(own.astype("<u4"), np.uint32(end_id)).tobytes()
                    for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[start : start + 4 * capacity]
                        for name, v in zip(out, (doc_id, k, start // 4, len(cut) // 4, zlib.crc32(cut), cut), strict=False):
                            out[name].append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=False)], names=list(out))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select("doc_id", "text").mapInArrow(run, schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a re-readable table of pieces with ``doc_id, piece, length``.

    Ranks within a length are counted per shard of ``doc_id`` and shifted by the
    shards before, so that a length which many pieces share is no hot key. Equal
    rows get different slots. An empty table gives no rows.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = sorted(pack_counts(counts, capacity), key=lambda s: (s.length, s.first))
    table = np.array([[s.length, s.first, s.times, s.sequence, s.offset] for s in slots], np.int64).reshape(-1, 5).T.copy()
    keyed = found.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salt_count(spark))))
    key = ["length", "_shard"]
    before = keyed.groupBy(*key).count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before.select(*key, F.coalesce("_before", F.lit(0)).alias("_before")), key).select(*found.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    out = [f for f in ranked.schema.fieldNames() if f != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, times, sequence, offset = table
        low = np.searchsorted(lengths, np.arange(capacity + 2))
        # Slots of a length are found by rank: one sorted key of length and first rank.
        for b in batches:
            n, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("_rank").to_numpy(zero_copy_only=False)
            at = np.empty(len(n), np.int64)
            for v in np.unique(n):
                own = n == v
                at[own] = low[v] + np.searchsorted(first[low[v] : low[v + 1]], rank[own], "right") - 1
            k = rank - first[at]
            made = [pa.array(sequence[at] + k // times[at]), pa.array(offset[at] + k % times[at] * n)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in out], *made], names=[*out, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def pack_documents(df: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; ids are written once and not tokenized again."""
    work = Work(df.sparkSession, "pack")
    return pack(work.save(pieces(df, capacity, with_ids=with_ids), "pieces"), capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """Sequences as id arrays; a group holds at most ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.concatenate([np.frombuffer(p["ids"], "<u4") for p in row]) for row in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_pydict({"sequence_id": b.column("sequence_id"), "ids": pa.array(rows, pa.list_(pa.int32()))})

    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInArrow(run, "sequence_id long, ids array<int>")
