"""Chunking operators: a table of payloads to a table of spans.

Input rows are ``(file_name, write_seq, bytes)``; every row is a chunking
domain of its own. Fixed-size chunking is plain Catalyst; the content-defined
kinds run a kernel over Arrow batches that adds an array of cuts to each row,
and slicing and hashing go on in the JVM in the same stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.constants import KB
from quernstone.errors import InvalidInput
from quernstone.functions import kernels
from quernstone.functions.hashing import hasher
from quernstone.functions.kernels import SeqConfig, Sizes

_LABELS = {"fast": "FastCDC (2020)", "rabin": "RabinCDC", "leap": "LeapCDC", "ultra": "UltraCDC", "super": "SuperCDC", "seq": "SeqCDC", "seq-decreasing": "SeqCDC"}


@dataclass(frozen=True)
class Chunker:
    """What to cut by; immutable, so tasks share nothing."""

    kind: str
    sizes: Sizes
    config: SeqConfig | None = None

    @property
    def label(self) -> str:
        """The name in reports."""
        if self.kind == "fixed-size":
            return f"Fixed size chunking, chunk size: {self.sizes.min}"
        mode = {"seq": ", mode: increasing", "seq-decreasing": ", mode: decreasing"}.get(self.kind, "")
        return f"{_LABELS.get(self.kind, self.kind)}, sizes: {self.sizes}{mode}"

    def estimate(self, n: Column) -> Column:
        """How many chunks a payload of ``n`` bytes may have."""
        if self.kind == "fixed-size":
            return F.floor(n / self.sizes.min).cast("long") + 1
        return F.floor(n / (self.sizes.avg if self.kind.startswith("seq") else self.sizes.min)).cast("long")


def fixed(size: int = 4 * KB) -> Chunker:
    return Chunker("fixed-size", Sizes(size, size, size))


def cdc(kind: str, sizes: Sizes = kernels.DEFAULT, config: SeqConfig | None = None) -> Chunker:
    """A content-defined chunker; ``config`` is for the ``seq`` kinds only."""
    if kind not in kernels.KERNELS:
        raise InvalidInput(f"unknown chunker {kind!r}; known: fixed-size, {', '.join(sorted(kernels.KERNELS))}")
    if config is not None and not kind.startswith("seq"):
        raise InvalidInput(f"{kind} takes no configuration")
    return Chunker(kind, sizes, config)


def register(name: str, cuts: Callable, label: str | None = None) -> None:
    """A chunker of the user: ``cuts(uint8 array, sizes)`` returns the ends of all chunks."""
    kernels.KERNELS[name] = cuts
    _LABELS[name] = label or name


def from_options(kind: str, min_kb: int, avg_kb: int, max_kb: int, seq_mode: str | None = None) -> Chunker:
    """The chunker that command-line options name; sizes in KiB, fixed-size takes the least."""
    if kind == "fixed-size":
        return fixed(min_kb * KB)
    if kind == "seq":
        if seq_mode not in ("increasing", "decreasing"):
            raise InvalidInput("seq needs a mode: increasing or decreasing")
        kind = "seq" if seq_mode == "increasing" else "seq-decreasing"
    return cdc(kind, Sizes(min_kb * KB, avg_kb * KB, max_kb * KB))


def _with_cuts(files: DataFrame, chunker: Chunker) -> DataFrame:
    """``files`` with the array ``_cuts`` of offset and length; empty and null payloads have none."""
    n = F.octet_length("bytes").cast("long")
    if chunker.kind == "fixed-size":
        size = chunker.sizes.min
        starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<long>"))
        return files.withColumn("_cuts", F.transform(starts, lambda o: F.struct(o.alias("offset"), F.least(F.lit(size).cast("long"), n - o).alias("len"))))
    names, kind, sizes, config = files.columns, chunker.kind, chunker.sizes, chunker.config
    # A registered kernel is not known to the workers by name.
    own = kernels.KERNELS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.KERNELS.setdefault(kind, own)
        cut = pa.struct([("offset", pa.int64()), ("len", pa.int64())])
        for b in batches:
            rows = [[{"offset": o, "len": n} for o, n in kernels.chunk(x or b"", kind, sizes, config)] for x in b.column(names.index("bytes")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(cut))], names=[*names, "_cuts"])

    from pyspark.sql import types as T

    cuts = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("len", T.LongType())]))
    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("_cuts", cuts)]))


def chunk(files: DataFrame, chunker: Chunker, hash_name: str | None = "sha256", with_data: bool = False) -> DataFrame:
    """Spans ``file_name, write_seq, idx, offset, len``, with ``hash`` and ``data`` if asked for.

    ``offset`` counts within the write. The payload leaves the plan unless
    ``with_data`` keeps it.
    """
    cut = _with_cuts(files.select("file_name", "write_seq", "bytes"), chunker)
    cut = cut.select("file_name", "write_seq", "bytes", F.posexplode("_cuts").alias("idx", "_cut"))
    data = F.substring(F.col("bytes"), (F.col("_cut.offset") + 1).cast("int"), F.col("_cut.len").cast("int"))
    out = [F.col("file_name"), F.col("write_seq"), F.col("idx").cast("long").alias("idx"), F.col("_cut.offset").alias("offset"), F.col("_cut.len").alias("len")]
    if hash_name:
        out.append(hasher(hash_name).of(data).alias("hash"))
    if with_data:
        out.append(data.alias("data"))
    return cut.select(*out)


def chunk_pieces(pieces: DataFrame, chunker: Chunker, hash_name: str | None = "sha256") -> DataFrame:
    """Spans ``file_name, idx, offset, len, data`` (and ``hash``) of files that are given in pieces.

    ``pieces(file_name, piece, offset, bytes)``: consecutive pieces of each file, numbered
    from 0; no file need fit into a row. The cuts equal those of the whole file. A
    file is read by one task, in order; that holds a piece and less than the
    greatest chunk at a time. Null pieces count as empty, empty files have no spans.
    """
    kind, sizes, config = chunker.kind, chunker.sizes, chunker.config
    kernels.Carry(kind, sizes, config)  # refuses sizes that pieces cannot have
    own = kernels.KERNELS.get(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own:
            kernels.KERNELS.setdefault(kind, own)
        name, carry, idx, offset = None, None, 0, 0

        def spans(found: list[bytes]) -> pa.RecordBatch:
            nonlocal idx, offset
            size = [len(x) for x in found]
            starts = [offset + sum(size[:k]) for k in range(len(size))]
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(idx, idx + len(found)), pa.int64()), pa.array(starts, pa.int64()), pa.array(size, pa.int64()), pa.array(found, pa.binary())], names=["file_name", "idx", "offset", "len", "data"])
            idx, offset = idx + len(found), offset + sum(size)
            return out

        for b in batches:
            for k in range(len(b)):  # one piece at a time
                file = b.column("file_name")[k].as_py()
                if carry is None or file != name:
                    if carry is not None:
                        yield spans(carry.feed(b"", True))
                    name, carry, idx, offset = file, kernels.Carry(kind, sizes, config), 0, 0
                yield spans(carry.feed(b.column("bytes")[k].as_py() or b""))
        if carry is not None:
            yield spans(carry.feed(b"", True))

    ordered = pieces.select("file_name", "piece", "bytes").repartition("file_name").sortWithinPartitions("file_name", "piece")
    out = ordered.mapInArrow(run, "file_name string, idx long, offset long, len long, data binary")
    return out.withColumn("hash", hasher(hash_name).of(F.col("data"))) if hash_name else out


def violations(spans: DataFrame, files: DataFrame, chunker: Chunker) -> DataFrame:
    """Counts of what must not be, over all payloads: gaps or overlaps, uncovered bytes, sizes out of bounds."""
    from pyspark.sql import Window

    order = Window.partitionBy("file_name", "write_seq").orderBy("idx")
    s = spans.withColumn("_prev", F.lag(F.col("offset") + F.col("len"), 1, 0).over(order)).withColumn("_last", F.lead("idx").over(order).isNull())
    low, high = chunker.sizes.min, chunker.sizes.max
    per = s.groupBy("file_name", "write_seq").agg(F.count_if(F.col("offset") != F.col("_prev")).alias("gaps"), F.sum("len").alias("covered"), F.count_if((F.col("len") > high) | (~F.col("_last") & (F.col("len") < low)) | (F.col("len") < 1)).alias("out_of_bounds"))
    joined = files.select("file_name", "write_seq", F.octet_length("bytes").cast("long").alias("n")).join(per, ["file_name", "write_seq"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"),
        F.coalesce(F.sum("out_of_bounds"), F.lit(0)).alias("out_of_bounds"),
        F.coalesce(F.sum(F.col("n") - F.coalesce("covered", F.lit(0))), F.lit(0)).alias("uncovered_bytes"),
    )
