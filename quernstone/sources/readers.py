"""Datasets as files, reports read back, and the configuration file."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.constants import SEGMENT
from quernstone.errors import InvalidInput, NotFound
from quernstone.schemas import MEASURE


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, size`` of the files at ``path``; contents are not read."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files at ``path`` with their bytes, each one write."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit(0).cast("long").alias("write_seq"), F.col("content").alias("bytes"))


def pieces(spark: SparkSession, path: str, size: int = SEGMENT) -> DataFrame:
    """The files at ``path`` in pieces of ``size`` bytes: ``file_name, piece, offset, bytes``; no file need fit into a row.

    Empty files are left out, as by Spark's file source. A task opens its files
    itself, at any path that Arrow's file systems can read.
    """
    if size < 1:
        raise InvalidInput("a piece needs at least one byte")
    each = F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {size}"))
    wanted = datasets(spark, path).select("path", F.col("name").alias("file_name"), F.explode(each).alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for where, name, piece in zip(*(b.column(c).to_pylist() for c in ("path", "file_name", "piece")), strict=True):
                system, inner = fs.FileSystem.from_uri(where.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))
                with system.open_input_file(inner) as f:
                    f.seek(piece * size)
                    data = f.read(size)
                yield pa.RecordBatch.from_pydict({"file_name": [name], "piece": pa.array([piece], pa.int64()), "offset": pa.array([piece * size], pa.int64()), "bytes": pa.array([data], pa.binary())})

    return wanted.mapInArrow(run, "file_name string, piece long, offset long, bytes binary")


def report(spark: SparkSession, path: str) -> DataFrame:
    """Measurements read back from CSV."""
    return spark.read.csv(path, header=True, schema=MEASURE)


def distribution(spark: SparkSession, path: str) -> DataFrame:
    """``bucket, n`` from the JSON of a size distribution."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<bigint>>")).alias("p"))
    return pairs.select(F.get("p", F.lit(0)).alias("bucket"), F.get("p", F.lit(1)).alias("n"))


def config(path: str) -> dict:
    """A TOML file with ``args`` and one ``command``; the report folder must be there."""
    if not os.path.exists(path):
        raise NotFound(path)
    found = tomllib.loads(Path(path).read_text())
    if "args" not in found or len(found.get("command", {})) != 1:
        raise InvalidInput("the configuration needs args and one command")
    where = found["args"].get("report-path")
    if where is not None and not os.path.isdir(where):
        raise InvalidInput(f"{where} is not a folder")
    return found
