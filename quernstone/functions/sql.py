"""The chunkers as a table function for SQL text.

    SELECT d.doc_id, c.* FROM documents d, LATERAL cdc_chunks(encode(d.text, 'utf-8'), 'fast', 128, 256, 1024) c
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quernstone.errors import InvalidInput
from quernstone.functions.kernels import KERNELS, Sizes, chunk


class CdcChunks:
    """Chunks of one payload; null has none."""

    def eval(self, payload: bytes, kind: str, low: int, avg: int, high: int) -> Iterator[tuple[int, int, int]]:
        if kind not in KERNELS:
            raise InvalidInput(f"unknown chunker {kind!r}")
        for k, (offset, n) in enumerate(chunk(bytes(payload or b""), kind, Sizes(low, avg, high))):
            yield k, offset, n


def register(spark: SparkSession, name: str = "cdc_chunks") -> None:
    """Makes the table function known to a session."""
    spark.udtf.register(name, udtf(CdcChunks, returnType="idx int, offset long, len long"))
