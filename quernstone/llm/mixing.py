"""Mixing sources to target weights by Sainte-Laguë apportionment of word blocks.

A source's words, in a seeded order of its documents, form streams (shards) cut
into blocks of equal size, small enough for the source of the least target.
Blocks are apportioned to sources by highest quotients, then a source's blocks
to its shards. A shard gives the words of its quota: its whole stream as often as
that goes, then, from the seeded start of a block on, as many neighbouring blocks
as are left, round the end of the stream. What a document gives follows from its
place in the stream, so no row per block is ever made.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.shared import WORD, Work, fresh, n_words
from quernstone.llm.textvec import slices

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often a word may be taken.
SHARE = Fraction(3, 2)
MOST_REPEATS = 2
#: Most words in a block, and in how many blocks at least the least target is counted out.
BLOCK_WORDS, LEAST_BLOCKS = 64, 32
#: A shard holds about so many words until a source has the most shards; then its shards grow.
SHARD_WORDS = 1 << 18
MOST_SHARDS = 4096
SEED = 20_240_229
#: Up to so many sources (about 10 MB) their plan is broadcast; more are joined by a shuffle.
FEW_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction = SHARE, most: int = MOST_REPEATS) -> list[Fraction]:
    """Words for each source: by weight, none above ``most`` times its size, the excess shared again."""
    out = [Fraction(0)] * len(sizes)
    left, active = share * sum(sizes), list(range(len(sizes)))
    while active and left > 0:
        unit = left / sum(weights[i] for i in active)
        over = [i for i in active if unit * weights[i] > most * sizes[i]]
        for i in over or active:
            out[i] = Fraction(most * sizes[i]) if over else unit * weights[i]
            left -= out[i]
        active = [i for i in active if i not in set(over)] if over else []
    return out


def sainte_lague(votes: Sequence[Fraction | int], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients ``votes / (2 k + 1)``, the first party at ties; none above its cap."""
    caps = [seats] * len(votes) if caps is None else list(caps)
    out = [0] * len(votes)
    active = [i for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    seats = min(seats, sum(caps[i] for i in active))
    while active and seats > 0:
        total, n = sum(votes[i] for i in active), len(active)
        # Every party surely has this many; at most about two a party remain for the heap.
        won = {i: max(0, int(Fraction(votes[i]) * (2 * seats - n) / (2 * total) - Fraction(1, 2))) for i in active}
        heap = [(-Fraction(votes[i]) / (2 * won[i] + 1), i) for i in active]
        heapq.heapify(heap)
        for _ in range(seats - sum(won.values())):
            i = heap[0][1]
            won[i] += 1
            heapq.heapreplace(heap, (-Fraction(votes[i]) / (2 * won[i] + 1), i))
        full = [i for i in active if won[i] >= caps[i]]
        if not any(won[i] > caps[i] for i in active):
            full = active
        for i in full:
            out[i] = min(won[i], caps[i])
            seats -= out[i]
        active = [i for i in active if i not in set(full)]
    return out


def _key(source: str | None) -> str:
    return "" if source is None else f"={source}"


def block_words(wanted: Sequence[Fraction]) -> int:
    """Words in a block: :data:`BLOCK_WORDS`, or fewer where a target is small, down to one."""
    return max(1, min([BLOCK_WORDS, *(int(t / LEAST_BLOCKS) for t in wanted if t > 0)]))


def plan(totals: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_REPEATS) -> tuple[int, list[tuple[str, int, float, int, int]]]:
    """The block's words, and ``(key, size, target, blocks, shards)`` of every source, by code point, null last."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    sizes = [totals[s] for s in order]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], share, most)
    block = block_words(wanted)
    blocks = sainte_lague(wanted, round(sum(wanted) / block), [-(-most * n // block) for n in sizes])
    return block, [(_key(s), n, float(t), q, min(MOST_SHARDS, max(1, -(-n // SHARD_WORDS)))) for s, n, t, q in zip(order, sizes, wanted, blocks, strict=True)]


def mix(df: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Every row of ``df(doc_id, text, source)`` with what the mix takes of it.

    Adds ``size``, ``source_size`` (long), ``target`` (double, its source's),
    ``taken`` (long), ``whole`` (int: times the whole text is taken) and
    ``ranges`` (word ranges taken once more); columns of these names are
    replaced. Null text has size 0; a null source is a source of its own. Equal
    rows are separate documents. The driver holds one row a source. The hash
    order spreads a large source over up to :data:`MOST_SHARDS` streams, and
    only ids, sizes and a hash go through the shuffle of the running sum.
    """
    spark, work = df.sparkSession, Work(df.sparkSession, "mix")
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    sized = df.select("doc_id", key.alias("_key"), n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_order"))
    sized = work.save(sized, "sizes")
    totals = {None if k == "" else k[1:]: n for k, n in sized.groupBy("_key").agg(F.sum("size")).collect()}
    block, rows = plan(totals, weights, share, most)
    sources = spark.createDataFrame(rows, "_key string, source_size long, target double, _blocks long, _shards long")
    few = len(rows) <= FEW_SOURCES
    placed = sized.join(F.broadcast(sources) if few else sources, "_key").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("_shards")))

    def quotas(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_shard")
        n = [int(x) for x in group["_words"]]
        q = sainte_lague(n, int(group["_blocks"].iloc[0]), [-(-most * x // block) for x in n])
        return group.assign(_quota=q)[["_key", "_shard", "_words", "_quota"]]

    shards = placed.groupBy("_key", "_shard", "_blocks").agg(F.sum("size").alias("_words"))
    shards = shards.groupBy("_key").applyInPandas(quotas, "_key string, _shard long, _words long, _quota long")
    shards = work.save(shards, "quotas")
    here = Window.partitionBy("_key", "_shard").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("_to", F.sum("size").over(here)).withColumn("_from", F.col("_to") - F.col("size"))
    run = run.join(shards, ["_key", "_shard"])
    # The quota in words; a last block that is short counts for the words it has.
    run = run.withColumn("_quota", F.least(F.col("_quota") * block, F.col("_words") * most)).withColumn("_n", F.greatest("_words", F.lit(1).cast("long")))
    run = run.withColumn("whole", F.expr("cast(_quota div _n as int)"))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "_key", "_shard"), F.ceil(F.col("_n") / block)) * block
    run = run.withColumn("_first", start).withColumn("_last", F.col("_first") + F.expr("_quota % _n"))

    def cut(a: Column, b: Column) -> Column:
        """The document's part of the stream's words from a to b, in its own words."""
        lo, hi = F.greatest(a, F.col("_from")), F.least(b, F.col("_to"))
        return F.when(lo < hi, F.struct((lo - F.col("_from")).alias("start"), (hi - F.col("_from")).alias("end")))

    wrapped = cut(F.lit(0).cast("long"), F.greatest(F.col("_last") - F.col("_n"), F.lit(0)))
    run = run.withColumn("ranges", F.array_compact(F.array(wrapped, cut(F.col("_first"), F.least("_last", "_n")))))
    extra = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return run.withColumn("taken", F.col("size") * F.col("whole") + extra).select("doc_id", "_order", "size", "source_size", "target", "taken", "whole", "ranges")


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """The mix itself: a row of ``df``'s columns for every taken copy or part of a document.

    A part keeps the text from its first to its last word. Rows that nothing is
    taken of, such as empty texts, give none. No column name of ``df`` is in the way.
    """
    seed = how.get("seed", SEED)
    ident = F.coalesce("doc_id", F.lit(-(1 << 63)))
    order, id_, n, k, size, whole, ranges = fresh(df.columns, "_order", "_id", "_n", "_k", "_size", "_whole", "_ranges")
    renamed = {"_order": order, "size": size, "whole": whole, "ranges": ranges}
    taken = mix(df, **how).select(ident.alias(id_), *[F.col(a).alias(b) for a, b in renamed.items()])
    # Rows of equal id and text are told apart by number only; both sides are dealt once, by the windows' key.
    taken = taken.withColumn(n, F.row_number().over(Window.partitionBy(order, id_).orderBy(whole, ranges)))
    own = df.withColumn(order, F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn(id_, ident)
    own = own.withColumn(k, F.row_number().over(Window.partitionBy(order, id_).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))))
    both = own.join(taken, [order, id_]).filter(F.col(k) - F.col(n) == 0)
    both = both.filter((F.col(size) > 0) & ((F.col(whole) > 0) | (F.size(ranges) > 0)))
    both = both.select(*[f"`{c}`" for c in df.columns], size, whole, ranges)
    columns, at, schema = df.columns, df.columns.index("text"), df.schema
    word = re.compile(WORD)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in slices(batches):
            take, texts = [], []
            for i, (text, size, whole, ranges) in enumerate(zip(*(b.column(c).to_pylist() for c in (at, len(columns), len(columns) + 1, len(columns) + 2)), strict=True)):
                take += [i] * whole
                texts += [text] * whole
                for r in ranges:
                    take.append(i)
                    if (r["start"], r["end"]) == (0, size):
                        texts.append(text)
                    else:
                        spans = [m.span() for m in word.finditer(text)]
                        texts.append(text[spans[r["start"]][0] : spans[r["end"] - 1][1]])
            got = b.take(pa.array(take, pa.int64()))
            cols = [pa.array(texts, arrow.field(at).type) if k == at else got.column(k).cast(arrow.field(k).type) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return both.mapInArrow(rows, schema)
