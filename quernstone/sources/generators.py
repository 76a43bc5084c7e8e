"""Made-up datasets: files of blocks, some of which repeat, and random bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.constants import KB, MB
from quernstone.errors import InvalidInput


def _blocks(spark: SparkSession, size: int, seed_of: str, fill: Callable[[np.random.Generator, int], bytes], block: int) -> DataFrame:
    rows = spark.range(-(-size // block)).select("id", F.expr(seed_of).alias("seed"), F.least(F.lit(block), F.lit(size) - F.col("id") * block).cast("int").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, seed, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"write_seq": pa.array([i], pa.int64()), "bytes": pa.array([fill(np.random.default_rng(seed & (1 << 63) - 1), n)], pa.binary())})

    return rows.mapInArrow(run, "write_seq long, bytes binary")


def duplicated(spark: SparkSession, name: str, size_kb: int, percent: int, seed: int = 1, block: int = MB) -> DataFrame:
    """A file of random blocks of which about ``percent`` in a hundred repeat one block; one row a block."""
    if not 0 <= percent <= 100:
        raise InvalidInput("the percentage must be between 0 and 100")
    which = f"if(pmod(xxhash64(id, {seed}L), 100) < {percent}, {seed}L, xxhash64(id, {seed}L, 7))"
    return _blocks(spark, size_kb * KB, which, lambda g, n: g.bytes(n), block).select(F.lit(name).alias("file_name"), "write_seq", "bytes")


def random_bytes(spark: SparkSession, name: str, size: int, draw: Callable[[np.random.Generator, int], np.ndarray] | None = None, seed: int = 1, block: int = MB) -> DataFrame:
    """A file of bytes drawn from any distribution; ``draw(generator, n)`` gives ``n`` values from 0 to 255."""
    draw = draw or (lambda g, n: g.integers(0, 256, n))
    return _blocks(spark, size, f"xxhash64(id, {seed}L)", lambda g, n: np.asarray(draw(g, n)).astype(np.uint8).tobytes(), block).select(F.lit(name).alias("file_name"), "write_seq", "bytes")
