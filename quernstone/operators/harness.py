"""Measuring chunkers on datasets: write, read back, verify, report."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.errors import InvalidInput, NotFound
from quernstone.operators import store
from quernstone.operators.chunkers import Chunker
from quernstone.operators.filesystem import FileStore
from quernstone.operators.report import Measurement, Times, append_csv, save_distribution
from quernstone.sources import readers


class Dataset:
    """A file (or a folder of files) with its size; an absent path is an error."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self.spark, self.path, self.name = spark, path, name or os.path.basename(path.rstrip("/"))
        try:
            self.size = readers.datasets(spark, path).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        except Exception as e:
            raise NotFound(path) from e

    def writes(self) -> DataFrame:
        """Its files in order of path, each one write."""
        found = self.spark.read.format("binaryFile").load(self.path).select("path", F.col("content").alias("bytes"))
        order = F.expr("row_number() over (order by path) - 1")
        seq = found.select("path").withColumn("write_seq", order.cast("long"))  # names only
        return found.join(seq, "path").select(F.lit(self.name).alias("file_name"), "write_seq", "bytes")


class TableDataset(Dataset):
    """A column of a table, each row one write."""

    def __init__(self, files: DataFrame, name: str):
        self.spark, self.path, self.name, self.frame = files.sparkSession, "", name, files
        self.size = files.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]

    def writes(self) -> DataFrame:
        return self.frame.select(F.lit(self.name).alias("file_name"), "write_seq", "bytes")


class Fixture:
    """A store and the measurements made on it."""

    def __init__(self, files: FileStore):
        self.store = files

    def _write(self, dataset: Dataset, chunker: Chunker) -> tuple[str, Times]:
        name = str(uuid.uuid4())
        handle = self.store.create_file(name, chunker)
        began = time.perf_counter()
        self.store.write(handle, dataset.writes())
        wrote = time.perf_counter() - began
        m = self.store.close(handle)
        return name, Times(wrote, 0.0, m.chunk_time, m.hash_time)

    def fill_with(self, dataset: Dataset, chunker: Chunker) -> None:
        """Writes a dataset without measuring it."""
        self._write(dataset, chunker)

    def verify(self, dataset: Dataset, name: str) -> float:
        """Seconds to read a file's payloads; an error if they differ from the dataset, write by write."""
        began = time.perf_counter()
        payloads = self.store.payloads([name])
        payloads.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        first = self.store.files[name].first_seq or 0
        wrote = dataset.writes().select(F.lit(name).alias("file_name"), (F.col("write_seq") + first).alias("write_seq"), "bytes")
        if not store.verify_writes(wrote, payloads).isEmpty():
            raise InvalidInput(f"{dataset.name} was read back differently")
        return took

    def measure(self, dataset: Dataset, chunker: Chunker) -> Measurement:
        name, times = self._write(dataset, chunker)
        times.read_time = self.verify(dataset, name)
        m = self.store.metrics()
        return Measurement(dataset.name, chunker.label, dataset.size, m["cdc_dedup_ratio"], m["full_cdc_dedup_ratio"], self.store.average_chunk_size(), m["chunk_count"], times, dataset.path)

    def measure_multi(self, dataset: Dataset, chunker: Chunker, n: int) -> list[Measurement]:
        """``n`` runs, each on an empty store."""
        out = []
        for _ in range(n):
            self.store.clear()
            out.append(self.measure(dataset, chunker))
        return out

    def measure_repeated(self, dataset: Dataset, chunker: Chunker, n: int) -> list[Measurement]:
        """``n`` runs on one store, so that the ratio grows."""
        return [self.measure(dataset, chunker) for _ in range(n)]

    def dedup_ratio(self, dataset: Dataset, chunker: Chunker) -> float:
        """The ratio on an empty store, verified."""
        self.store.clear()
        return self.measure(dataset, chunker).dedup_ratio


def measure_datasets(fixture: Fixture, datasets: Iterable[Dataset], chunkers: Iterable[Chunker], folder: str, adjustments: tuple[int, ...] = (100, 500, 1000)) -> list[Measurement]:
    """Every dataset by every chunker on an empty store, with a CSV report and size histograms."""
    out, chunkers = [], list(chunkers)
    for d in datasets:
        for c in chunkers:
            fixture.store.clear()
            out.append(fixture.measure(d, c))
            append_csv(os.path.join(folder, "report.csv"), out[-1:])
            for a in adjustments:
                save_distribution(folder, d.name, c.label, a, fixture.store.size_distribution(a))
    return out
