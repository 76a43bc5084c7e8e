"""A deduplicating store of files on Parquet tables, with handles, metrics and scrubbing.

Tables below one folder: ``ledger`` (what was created and written), ``spans``
(recipes) and versions of ``chunks`` and ``target``. A store has one writer. Each
step has a number: its chunks come first (only those whose hash is absent), then
its spans in a folder of that number, then its row of the ledger. Spans without
a row of the ledger do not count, and the next step replaces them, so a step that
fails half way leaves no more than chunks that no recipe names. What names exist
and where their recipes end is kept by the store object, a row for each file,
and is the same when it is loaded again from the ledger.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import schemas
from quernstone.constants import SEGMENT
from quernstone.errors import AlreadyExists, InvalidInput, NotFound, PermissionDenied
from quernstone.functions.hashing import hasher, ratio
from quernstone.operators import store
from quernstone.operators.chunkers import Chunker, chunk, chunk_pieces
from quernstone.operators.ordered import running

Scrubber = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


@dataclass
class WriteMeasurements:
    """Seconds spent in chunking and in hashing; they add up."""

    chunk_time: float = 0.0
    hash_time: float = 0.0

    def __add__(self, other: WriteMeasurements) -> WriteMeasurements:
        return WriteMeasurements(self.chunk_time + other.chunk_time, self.hash_time + other.hash_time)


@dataclass(frozen=True)
class ScrubMeasurements:
    processed_data: int = 0
    running_time: float = 0.0
    data_left: int = 0


@dataclass
class Handle:
    """An open file: a read cursor, and a chunker unless it is read-only."""

    file_name: str
    chunker: Chunker | None
    offset: int = 0
    measurements: WriteMeasurements = field(default_factory=WriteMeasurements)


@dataclass
class _File:
    generation: int
    spans: int = 0
    size: int = 0
    #: The sequence number of the file's first write.
    first_seq: int | None = None


class FileStore:
    """Files cut into chunks, each distinct chunk stored once."""

    def __init__(self, spark: SparkSession, path: str, hash_name: str = "sha256", scrubber: Scrubber | None = None):
        self.spark, self.path, self.hasher, self.scrubber = spark, path.rstrip("/"), hasher(hash_name), scrubber
        self.files: dict[str, _File] = {}
        self.version = self.writes = self.generations = self.steps = 0
        self._load()

    # Tables

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}-{self.version}" if table in ("chunks", "target") else f"{self.path}/{table}"

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _table(self, table: str, schema: str) -> DataFrame:
        at = self._at(table)
        return self.spark.read.schema(schema).parquet(at) if self._exists(at) else self.spark.createDataFrame([], schema)

    def _commit(self, kind: str, name: str, f: _File, first_seq: int, next_seq: int, spans: int = 0, size: int = 0, n_bytes: int = 0) -> None:
        """The row of the ledger that makes a step count, and the same change in memory."""
        row = (kind, name, f.generation, first_seq, next_seq, spans, size, n_bytes, self.steps)
        self.spark.createDataFrame([row], schemas.LEDGER).drop("commit").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/commit={self.steps}")
        self._apply(*row)

    def _apply(self, kind: str, name: str, generation: int, first_seq: int, next_seq: int, spans: int, size: int, n_bytes: int, step: int) -> None:
        if kind == "create":
            self.files[name] = _File(generation)
        f = self.files.get(name)
        if f is not None and f.generation == generation and kind == "write":
            f.spans, f.size = f.spans + spans, f.size + size
            f.first_seq = first_seq if f.first_seq is None else f.first_seq
        self.generations = max(self.generations, generation + 1)
        self.writes, self.steps = max(self.writes, next_seq), step + 1

    def _load(self) -> None:
        while self._exists(f"{self.path}/chunks-{self.version + 1}"):
            self.version += 1
        for r in self._table("ledger", schemas.LEDGER).orderBy("commit").collect():  # a row for each step
            self._apply(*r)

    @property
    def chunks(self) -> DataFrame:
        """The chunk table: scan, or select its keys or payloads."""
        return self._table("chunks", schemas.CHUNKS)

    @property
    def target(self) -> DataFrame:
        return self._table("target", schemas.TARGET)

    def spans(self, name: str) -> DataFrame:
        """The recipe of one file."""
        f = self._find(name)
        return self._spans().filter((F.col("file_name") == name) & (F.col("generation") == f.generation))

    def _spans(self) -> DataFrame:
        return self._table("spans", schemas.SPANS).filter(F.col("commit") < self.steps).drop("commit")

    def _add_spans(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/spans/commit={self.steps}")

    # Files

    def _find(self, name: str) -> _File:
        if name not in self.files:
            raise NotFound(name)
        return self.files[name]

    def list_files(self) -> list[str]:
        return sorted(self.files)

    def file_exists(self, name: str) -> bool:
        return name in self.files

    def create_file(self, name: str, chunker: Chunker, overwrite: bool = True) -> Handle:
        """A new empty file; an old one of the name is replaced unless ``overwrite`` is false."""
        if name in self.files and not overwrite:
            raise AlreadyExists(name)
        self._commit("create", name, _File(self.generations), self.writes, self.writes)
        return Handle(name, chunker)

    def open_file(self, name: str, chunker: Chunker) -> Handle:
        self._find(name)
        return Handle(name, chunker)

    def open_readonly(self, name: str) -> Handle:
        self._find(name)
        return Handle(name, None)

    def close(self, handle: Handle) -> WriteMeasurements:
        self._find(handle.file_name)
        return handle.measurements

    def write(self, handle: Handle, data: bytes | DataFrame) -> None:
        """Appends bytes, or the ``bytes`` of a table in ``write_seq`` order, each row a write of its own.

        A table of many rows is many tasks throughout: places along the file come
        from running sums without payloads. ``write_seq`` is unique in the table.
        """
        self._check(handle)
        if isinstance(data, (bytes, bytearray)):
            data = self.spark.createDataFrame([(handle.file_name, 0, bytearray(data))], schemas.FILES)
        sized = data.agg(F.coalesce(F.sum(F.octet_length("bytes").cast("long")), F.lit(0)).alias("n"), F.coalesce(F.max("write_seq"), F.lit(-1)).alias("top")).first()
        files = data.select(F.lit(handle.file_name).alias("file_name"), (F.col("write_seq") + self.writes).alias("write_seq"), "bytes")
        began = time.perf_counter()
        cut = self._staged(chunk(files, handle.chunker, None, with_data=True).drop("file_name", "offset"), "cut")
        self._add(handle, cut, began, self.writes + sized.top + 1, sized.n)

    def write_pieces(self, handle: Handle, pieces: DataFrame) -> None:
        """Appends one write that arrives in pieces (``file_name, piece, bytes`` of one file); it may be longer than a row can be."""
        self._check(handle)
        began = time.perf_counter()
        one = pieces.withColumn("file_name", F.lit(handle.file_name))
        cut = chunk_pieces(one, handle.chunker, None).select(F.lit(self.writes).cast("long").alias("write_seq"), "idx", "len", "data")
        cut = self._staged(cut, "cut")
        self._add(handle, cut, began, self.writes + 1, cut.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0])

    def _check(self, handle: Handle) -> None:
        self._find(handle.file_name)
        if handle.chunker is None:
            raise PermissionDenied(handle.file_name)

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/stage-{self.steps}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _add(self, handle: Handle, cut: DataFrame, began: float, next_seq: int, n_bytes: int) -> None:
        """Chunks, spans and the ledger's row of ``cut(write_seq, idx, len, data)``."""
        f = self._find(handle.file_name)
        chunked = time.perf_counter()
        hashed = self._staged(cut.select("write_seq", "idx", "len", self.hasher.of(F.col("data")).alias("hash")), "hashed")
        took = time.perf_counter() - chunked
        first = store.insert_if_absent(self.chunks, hashed.groupBy("hash").agg(F.min(F.struct("write_seq", "idx")).alias("at"), F.min("len").alias("length")))
        first = first.select("hash", "length", "at.write_seq", "at.idx")
        absent = cut.select("write_seq", "idx", "data").join(first, ["write_seq", "idx"])
        absent.select("hash", "length", "data", F.lit(None).cast("array<binary>").alias("target_keys")).write.mode("append").parquet(self._at("chunks"))
        placed = running(hashed, "write_seq", ["write_seq", "idx"], {"upto": "len"}, place="n")
        self._add_spans(placed.select(F.lit(handle.file_name).alias("file_name"), F.lit(f.generation).cast("long").alias("generation"), (F.col("n") - 1 + f.spans).alias("span_idx"), "write_seq", "hash", (F.col("upto") - F.col("len") + f.size).alias("offset"), "len"))
        count = hashed.count()
        stage = f"{self.path}/stage-{self.steps}"
        self._commit("write", handle.file_name, f, self.writes, next_seq, count, n_bytes, n_bytes)
        self._drop(stage)
        handle.measurements += WriteMeasurements(chunked - began, took)

    def read_complete(self, handle: Handle) -> bytes:
        """The whole file."""
        return b"".join(self._payloads(handle.file_name, 0))

    def read(self, handle: Handle, size: int = SEGMENT) -> bytes:
        """The next whole spans of at most ``size`` bytes (a longer span alone), empty at the end; moves the cursor.

        Only spans that end within ``size`` bytes of the cursor are looked up.
        """
        self._find(handle.file_name)
        at = handle.offset
        near = (F.col("offset") == at) | (F.col("offset") + F.col("len") <= at + size)
        out, n = [], 0
        for part in self._payloads(handle.file_name, at, near):
            if n and n + len(part) > size:
                break
            out.append(part)
            n += len(part)
        handle.offset += n
        return b"".join(out)

    def _payloads(self, name: str, offset: int, near: Column | None = None) -> Iterator[bytes]:
        rest = self.spans(name).filter(F.col("offset") >= offset)
        rest = rest if near is None else rest.filter(near)
        found = store.retrieve(rest, self.chunks, self.target).orderBy("span_idx").select("data")
        return (bytes(r.data) for r in found.toLocalIterator())

    def payloads(self, names: list[str] | None = None) -> DataFrame:
        """The spans of all files or some with their payloads, in no order."""
        live = self.spark.createDataFrame([(n, f.generation) for n, f in self.files.items() if names is None or n in names], "file_name string, generation long")
        return store.retrieve(self._spans().join(live, ["file_name", "generation"], "left_semi"), self.chunks, self.target)

    def content(self, names: list[str] | None = None) -> DataFrame:
        """``file_name, content`` of all files or some, rebuilt on the executors; a file must fit into a row."""
        return store.reassemble(self.payloads(names))

    def write_to_disk(self, name: str, path: str) -> None:
        """The file's bytes at a new local path; an existing one is an error. Holds one segment at a time."""
        handle = self.open_readonly(name)
        try:
            out = open(path, "xb")
        except FileExistsError as e:
            raise AlreadyExists(path) from e
        with out:
            for part in self._payloads(handle.file_name, 0):
                out.write(part)

    # Measures

    def size_written(self) -> int:
        return self._table("ledger", schemas.LEDGER).agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]

    def metrics(self) -> dict[str, float]:
        """Sizes, counts and ratios; the average of an empty store is an error when it is asked for."""
        c = self.chunks.agg(
            F.coalesce(F.sum(F.when(F.col("data").isNotNull(), F.col("length"))), F.lit(0)).alias("cdc"),
            F.coalesce(F.sum(self.hasher.size(F.col("hash"))), F.lit(0)).alias("keys"),
            F.count(F.lit(1)).alias("n"),
        )
        t = self.target.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("t"))
        w = F.lit(self.size_written())
        row = c.crossJoin(t).select("cdc", "t", "n", ratio(w, F.col("cdc")).alias("cdc_ratio"), ratio(w, F.col("cdc") + F.col("keys")).alias("full"), ratio(w, F.col("cdc") + F.col("t")).alias("total")).first()
        return {"total_cdc_size": row.cdc, "total_size": row.cdc + row.t, "chunk_count": row.n, "cdc_dedup_ratio": row.cdc_ratio, "full_cdc_dedup_ratio": row.full, "total_dedup_ratio": row.total}

    def average_chunk_size(self) -> int:
        m = self.metrics()
        if not m["chunk_count"]:
            raise InvalidInput("the store is empty")
        return m["total_cdc_size"] // m["chunk_count"]

    def size_distribution(self, adjustment: int) -> DataFrame:
        """Histogram of chunk sizes; a scrubbed store has none."""
        if not self.chunks.filter("data is null").isEmpty():
            raise InvalidInput("chunks were moved to the target")
        return store.size_distribution(self.chunks.select("length"), adjustment)

    def chunk_count_distribution(self, handle: Handle, include_last: bool = False) -> DataFrame:
        return store.chunk_count_distribution(self.spans(handle.file_name), include_last)

    # Rewriting

    def scrub(self) -> ScrubMeasurements:
        """Runs the scrubber on the chunk table and the target; both are replaced as a new version."""
        if self.scrubber is None:
            raise InvalidInput("the store has no scrubber")
        began = time.perf_counter()
        chunks, target, done = self.scrubber(self.chunks, self.target)
        next_ = self.version + 1
        target.write.mode("overwrite").parquet(f"{self.path}/target-{next_}")
        chunks.write.mode("overwrite").parquet(f"{self.path}/chunks-{next_}")
        row = done.first()
        old, self.version = [self._at("chunks"), self._at("target")], next_
        for p in old:
            self._drop(p)
        return ScrubMeasurements(row.processed_data, time.perf_counter() - began, row.data_left)

    def to_dedup_ratio(self, handle: Handle, wanted: float) -> str:
        """A new file of known chunks that nears a deduplication ratio; adds nothing to the bytes written."""
        spans = self.spans(handle.file_name).select((F.col("span_idx") + 1).alias("g"), "hash", "len")
        made = store.to_dedup_ratio(spans, wanted)
        name = f"{handle.file_name}.{wanted:.2f}"
        turn = made.agg(F.coalesce(F.max(F.when(F.col("part") == 0, F.col("place"))), F.lit(0))).first()[0]
        placed = made.withColumn("_at", F.when(F.col("part") == 0, F.col("cycle") * turn + F.col("place")).otherwise(F.lit(1 << 40) + F.col("place")))
        placed = running(placed, "_at", ["_at"], {"upto": "len"}, place="n")
        self._commit("create", name, _File(self.generations), self.writes, self.writes)
        f = self._find(name)
        self._add_spans(placed.select(F.lit(name).alias("file_name"), F.lit(f.generation).cast("long").alias("generation"), (F.col("n") - 1).alias("span_idx"), F.lit(-1).cast("long").alias("write_seq"), "hash", (F.col("upto") - F.col("len")).alias("offset"), "len"))
        added = self._table("spans", schemas.SPANS).filter(F.col("commit") == self.steps).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        self._commit("write", name, f, self.writes, self.writes, *added)
        return name

    def clear_database(self) -> None:
        """Forgets recipes, chunks and the bytes written; the target stays."""
        for t in ("ledger", "spans", "chunks"):  # without the ledger nothing counts
            self._drop(self._at(t))
        self.files.clear()
        self.writes = self.steps = 0

    def clear(self) -> None:
        """Forgets everything."""
        self.clear_database()
        self._drop(self._at("target"))
