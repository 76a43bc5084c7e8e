"""Token-id shards compressed by Re-Pair grammars, in a binary format with random access.

Documents in ascending ``doc_id`` order (null first) are cut into shards. In a
shard the most frequent id pairs are replaced by nonterminals, again and again
until no pair is left that saves space; a round replaces the pairs of the
highest counts together, where matches overlap the more frequent one. No rule
goes across the end of a document. A shard is a row of a Parquet table, so that
Spark's committer and retries keep it whole; its payload is the format below.

Payload, little endian: ``RPG2``, then ``docs, ids, letters, rules, symbols,
width`` as six unsigned 64-bit integers; the letters (token ids that occur, u16,
ascending); per rule its two symbols (``width`` bytes each) and its expansion
length (u32); per document its id (i64), a null flag (u8), its ids before it in
the shard and the place of its first symbol (u64 each); the symbols (``width``
bytes). Symbols below ``letters`` are letters by rank, the others rules in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.shared import Work, salt_count
from quernstone.llm.tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
MAGIC = b"RPG2"
#: A shard is closed once it holds this many ids; a longer document stands alone.
SHARD_IDS = 1 << 20
#: A rule takes eight bytes and each use saves two, so a pair must occur so often to save space.
LEAST_COUNT = 5
#: The counts that a round takes go down by this factor from round to round.
STEP = 8
_HASH_BITS = 18


def _place(codes: np.ndarray) -> np.ndarray:
    if codes.dtype == np.uint32:
        return (codes * np.uint32(2654435761)) >> np.uint32(32 - _HASH_BITS)
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and how often each occurs."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def _pick(codes: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Codes that occur ``least`` times, the most frequent first; one whose hash place is taken waits for the next round."""
    often = np.flatnonzero(counts >= least)
    pairs = codes[often[np.argsort(-counts[often], kind="stable")]]
    _, free = np.unique(_place(pairs), return_index=True)
    return pairs[np.sort(free)]


def _twins(twin: np.ndarray) -> np.ndarray:
    """Which of the ascending places of pairs of one symbol overlap the pair before: every other one in a run."""
    if not len(twin):
        return np.zeros(0, bool)
    new = np.concatenate([[True], np.diff(twin) > 1])
    run = twin[np.flatnonzero(new)][np.cumsum(new) - 1]
    return (twin - run) % 2 == 1


def compress(seq: np.ndarray, letters: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), their expansion lengths, and the symbols that are left.

    ``seq`` has symbols below ``letters``. No rule holds ``end`` before its last
    place. In the end no pair is left that occurs :data:`LEAST_COUNT` times.

    A pair that was too rare for the last round stays too rare unless it holds a
    symbol of that round. So once the rounds take all pairs that save space, the
    next looks only at the places of new symbols and of what the round had found
    and left; all places of a pair are looked at or none.
    """
    seq = seq.astype(np.uint32)
    names, least = letters, len(seq)
    rules: list[np.ndarray] = []
    size, last = np.ones(letters, np.int64), seq == end  # last: of a document
    look = None  # everywhere
    while len(seq) > 1 if look is None else len(look):
        kind, bits = (np.uint32, 16) if names <= 1 << 16 else (np.uint64, 32)
        left, right = (seq[:-1], seq[1:]) if look is None else (seq[look], seq[look + 1])
        codes = left.astype(kind)
        codes <<= kind(bits)
        codes |= right
        free = ~last[:-1] if look is None else ~last[look]
        twin = np.flatnonzero(left == right)
        free[twin[_twins(twin if look is None else look[twin])]] = False
        pairs, counts = _counted(codes[free])
        least = max(LEAST_COUNT, least // STEP)
        while least > max(LEAST_COUNT, counts.max(initial=0)):  # a round without pairs
            least = max(LEAST_COUNT, least // STEP)
        pairs = _pick(pairs, counts, least)
        if not len(pairs):
            break
        table, taken = np.zeros(1 << _HASH_BITS, np.int32), np.zeros(1 << _HASH_BITS, bool)
        place = _place(pairs)
        table[place], taken[place] = np.arange(len(pairs)), True
        found = np.flatnonzero(taken[_place(codes)])
        own = found[free[found]]
        rank = table[_place(codes[own])]
        same = pairs[rank] == codes[own]
        at, rank = own[same], rank[same]
        if look is not None:
            at, found = look[at], look[found]
        # Of overlapping matches the more frequent pair; the other may be taken in a later round.
        close = np.diff(at) == 1
        lead = np.ones(len(at), bool)
        lead[1:] &= ~close | (rank[1:] < rank[:-1])
        lead[:-1] &= ~close | (rank[:-1] < rank[1:])
        at, rank = at[lead], rank[lead]
        use = np.bincount(rank, minlength=len(pairs)) >= LEAST_COUNT  # true of the first
        at, rank = at[use[rank]], rank[use[rank]]
        two = np.stack([pairs[use] >> kind(bits), pairs[use] & kind((1 << bits) - 1)], 1).astype(np.uint32)
        seq[at] = (names + np.cumsum(use) - 1)[rank]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        if least == LEAST_COUNT:
            new = at - np.arange(len(at))  # each pair before it has lost a place
            again = np.zeros(len(keep), bool)
            again[found] = True
            again = again[keep]
            again[new] = again[np.maximum(new - 1, 0)] = True
            look = np.flatnonzero(again[:-1])
        size = np.concatenate([size, size[two].sum(1)])
        names += len(two)
        rules.append(two)
    return np.concatenate([np.empty((0, 2), np.uint32), *rules]), size[letters:], seq


def encode_shard(doc_ids: list[int | None], docs: list[np.ndarray], end_id: int = END_ID) -> bytes:
    """The payload of some documents, whose ids end with the end id."""
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint16)
    letters = np.flatnonzero(np.bincount(ids, minlength=1 << 16))
    rank = np.zeros(1 << 16, np.uint32)
    rank[letters] = np.arange(len(letters))
    end = int(np.searchsorted(letters, end_id))  # of no letter if the end id does not occur
    rules, sizes, symbols = compress(rank[ids], len(letters), end if end < len(letters) and letters[end] == end_id else -1)
    wide = np.concatenate([np.ones(len(letters), np.int64), sizes])[symbols]
    starts = np.cumsum([0, *map(len, docs)])[:-1]
    places = np.searchsorted(np.cumsum(wide), starts, "right")
    width = 2 if len(letters) + len(rules) <= 1 << 16 else 4
    head = np.array([len(docs), len(ids), len(letters), len(rules), len(symbols), width], "<u8")
    parts = [head, letters.astype("<u2"), rules.astype(f"<u{width}"), sizes.astype("<u4"), np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), starts.astype("<u8"), places.astype("<u8"), symbols.astype(f"<u{width}")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


@dataclass
class Shard:
    """A payload read back; documents, or any range of their ids, are decoded alone."""

    doc_ids: list[int | None]
    starts: np.ndarray
    letters: np.ndarray
    rules: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    symbols: np.ndarray
    n_ids: int

    @classmethod
    def read(cls, payload: bytes) -> Shard:
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        at = 4

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        docs, n_ids, n_letters, n_rules, n_symbols, width = map(int, take("<u8", 6))
        letters, rules = take("<u2", n_letters), take(f"<u{width}", 2 * n_rules).reshape(-1, 2)
        sizes = np.concatenate([np.ones(n_letters, np.int64), take("<u4", n_rules)])
        ids, null = take("<i8", docs).tolist(), take("u1", docs).tolist()
        starts, places = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        return cls([None if x else d for d, x in zip(ids, null, strict=True)], starts, letters, rules, sizes, places, take(f"<u{width}", n_symbols), n_ids)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a symbol sequence: of each distinct symbol once, and from there to its places."""
        here = np.zeros(len(self.sizes), bool)
        here[symbols] = True
        distinct = np.flatnonzero(here)
        wide = self.sizes[distinct]
        first = np.zeros(len(here), np.int64)
        first[distinct] = np.cumsum(wide) - wide
        ids, wide = self._undo(distinct), self.sizes[symbols]
        upto = np.cumsum(wide)
        return ids[np.repeat(first[symbols] - upto + wide, wide) + np.arange(upto[-1] if len(upto) else 0)]

    def _undo(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a symbol sequence. Expansion lengths tell where each half of a rule begins, so every rule is undone in its place."""
        wide = self.sizes[symbols]
        at = np.cumsum(wide) - wide
        out = np.empty(int(wide.sum()), np.uint32)
        out[at] = symbols
        first = len(self.letters)
        at = at[symbols >= first]
        while len(at):
            two = self.rules[out[at] - first]
            left, right = two[:, 0], two[:, 1]
            there = at + self.sizes[left]
            out[at], out[there] = left, right
            at = np.concatenate([at[left >= first], there[right >= first]])
        return self.letters[out]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the shard: only the symbols that reach into the range are read, and of those at its ends only the halves that do."""
        start, end = max(0, start), min(end, self.n_ids)
        if start >= end:
            return self.letters[:0]
        k = int(np.searchsorted(self.starts, start, "right")) - 1
        z = int(np.searchsorted(self.starts, end, "left"))
        symbols = self.symbols[self.places[k] : self.places[z] if z < len(self.places) else len(self.symbols)]
        upto = self.starts[k] + np.cumsum(self.sizes[symbols])
        i, j = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, end, "left"))
        before = int(upto[i] - self.sizes[symbols[i]])
        inner = symbols[i : j + 1].tolist()
        inner, before = self._cut(inner, before, start)
        inner = self._cut(inner[::-1], int(upto[j]), end, back=True)[0][::-1]
        return self.expand(np.array(inner, np.int64))

    def _cut(self, symbols: list[int], at: int, to: int, back: bool = False) -> tuple[list[int], int]:
        """Symbols without their ids before ``to`` (after it, if ``back``), of a sequence that begins (ends, reversed) at ``at``."""
        rest = symbols[::-1]
        while at != to:
            s = rest.pop()
            n = int(self.sizes[s])
            if n <= abs(to - at):
                at += -n if back else n
            else:
                a, b = map(int, self.rules[s - len(self.letters)])
                rest += [a, b] if back else [b, a]
        return rest[::-1], at

    def document(self, k: int) -> np.ndarray:
        """Ids of the ``k``-th document, from its own symbols only."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.n_ids)

    def all(self) -> list[np.ndarray]:
        return np.split(self.expand(self.symbols), self.starts[1:]) if self.doc_ids else []


def write(df: DataFrame, path: str, vocabulary: str = VOCABULARY, shard_ids: int = SHARD_IDS) -> None:
    """Write the shards of ``df(doc_id, text)`` at ``path``; null text counts as empty.

    Rows of one ``doc_id`` stay apart, in the order of a hash of their text, so
    that reruns agree; other columns are left out. One range shuffle of the texts,
    dealt by id and that hash, so that one id's rows are not one task's; a task
    holds one shard and one batch.
    """
    n = salt_count(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        held_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = before = shard = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "before": pa.array([before], pa.int64()), "n_docs": pa.array([len(held)], pa.int64()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([encode_shard(held_ids, held)], pa.binary())})

        for b in batches:
            for at in range(0, len(b), 256):
                docs = enc.encode(b.column(1).slice(at, 256).to_pylist())
                for doc_id, own in zip(b.column(0).slice(at, 256).to_pylist(), docs, strict=True):
                    held_ids.append(doc_id)
                    held.append(np.append(own, np.uint16(END_ID)))
                    size += len(own) + 1
                    if size >= shard_ids:
                        yield close()
                        held_ids, held, before, size, shard = [], [], before + size, 0, shard + 1
        if held:
            yield close()

    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    shards = ordered.mapInArrow(run, "part int, shard int, before long, n_docs long, n_ids long, payload binary")
    shards.write.mode("overwrite").option("compression", "none").parquet(path)


def _decoded(spark: SparkSession, path: str, make: Callable[[Shard, int], pa.RecordBatch], schema: str) -> DataFrame:
    """``make(shard, ids before it)`` for every shard at ``path``."""
    shards = spark.read.schema("part int, shard int, before long, n_docs long, n_ids long, payload binary").parquet(path)
    # One row for each write task, of which there are as many as range partitions.
    sums = dict(shards.groupBy("part").agg(F.sum("n_ids")).collect())
    first, total = {}, 0
    for part in sorted(sums):
        first[part], total = total, total + sums[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, payload in zip(*(b.column(c) for c in ("part", "before", "payload")), strict=True):
                yield make(Shard.read(payload.as_py()), first[part.as_py()] + before.as_py())

    return shards.select("part", "before", "payload").mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards at ``path``: ``doc_id, start, ids`` (unsigned 16-bit bytes)."""

    def make(s: Shard, before: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(s.doc_ids, pa.int64()), "start": pa.array(before + s.starts), "ids": pa.array([d.astype("<u2").tobytes() for d in s.all()], pa.binary())})

    return _decoded(spark, path, make, "doc_id long, start long, ids binary")


def digest_rows(df: DataFrame) -> DataFrame:
    """Writes the shards of ``df(doc_id, text)`` and describes every document as read back from them.

    A null or empty text has the end id only; a null ``doc_id`` comes first; rows
    of one id are described one by one; no rows give none.
    """
    path = f"{Work(df.sparkSession, 'grammar').path}/shards"
    write(df, path)

    def make(s: Shard, before: int) -> pa.RecordBatch:
        raw = memoryview(s.expand(s.symbols).astype("<u4").tobytes())
        ends = [*s.starts[1:].tolist(), s.n_ids]
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(s.starts.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(s.doc_ids, pa.int64()), "start": pa.array(before + s.starts), "n_tokens": pa.array(np.diff([*s.starts, s.n_ids])), "ids_crc32": pa.array(crcs, pa.int64())})

    return _decoded(df.sparkSession, path, make, "doc_id long, start long, n_tokens long, ids_crc32 long")
