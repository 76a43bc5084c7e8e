"""Records of measurements, and their CSV and JSON forms."""

from __future__ import annotations

import csv
import json
import os
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.constants import MB
from quernstone.schemas import MEASURE


@dataclass
class Times:
    """Seconds of one run; they add up."""

    write_time: float = 0.0
    read_time: float = 0.0
    chunk_time: float = 0.0
    hash_time: float = 0.0

    def __add__(self, other: Times) -> Times:
        return Times(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(Times)))


@dataclass
class Measurement:
    """One run of a chunker on a dataset. Throughput counts whole MiB, so it is 0 below one."""

    name: str
    chunker: str
    size: int
    dedup_ratio: float
    full_dedup_ratio: float
    avg_chunk_size: int
    chunk_count: int
    times: Times
    path: str
    date: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def throughput(self, part: str) -> float:
        s = getattr(self.times, f"{part}_time")
        n = self.size // MB
        return n / s if s else (float("inf") if n else float("nan"))

    def row(self) -> dict:
        """The flat record, in the order of the report."""
        t = asdict(self.times)
        flow = {f"{p}_throughput": self.throughput(p) for p in ("chunk", "hash", "write", "read")}
        head = {k: getattr(self, k) for k in ("date", "name", "chunker", "size", "dedup_ratio", "full_dedup_ratio", "avg_chunk_size", "chunk_count")}
        return {**head, **t, **flow, "path": self.path}

    def __str__(self) -> str:
        return f"{self.name} by {self.chunker}: ratio {self.dedup_ratio:.3f} (with keys {self.full_dedup_ratio:.3f}), {self.chunk_count} chunks of {self.avg_chunk_size} bytes on average"


def append_csv(path: str, measured: list[Measurement]) -> None:
    """One local CSV file: a header when it is new, rows after those it has."""
    names = [c.strip().split(" ")[0] for c in MEASURE.split(",")]
    fresh = not os.path.exists(path)
    with open(path, "a", newline="") as out:
        writer = csv.DictWriter(out, names)
        if fresh:
            writer.writeheader()
        for m in measured:
            writer.writerow({**m.row(), "date": m.date.isoformat()})


def measurements(spark: SparkSession, measured: list[Measurement]) -> DataFrame:
    return spark.createDataFrame([m.row() for m in measured], MEASURE)


def pivot(report: DataFrame, metric: str, without: str | None = None) -> DataFrame:
    """Mean of a numeric metric by dataset and chunker, the label's part after the first comma left out."""
    label = F.trim(F.split("chunker", ",")[0])
    kept = report.withColumn("chunker", label)
    if without:
        kept = kept.filter(F.col("chunker") != without)
    return kept.groupBy("name").pivot("chunker").agg(F.avg(metric))


def pivots(report: DataFrame) -> dict[str, DataFrame]:
    """A pivot for every numeric metric."""
    numeric = [f.name for f in report.schema.fields if f.dataType.simpleString() in ("double", "bigint", "int") and f.name != "size"]
    return {m: pivot(report, m) for m in numeric}


def title(metric: Column | str) -> Column:
    """A metric's name for people."""
    return F.initcap(F.replace(F.col(metric) if isinstance(metric, str) else metric, F.lit("_"), F.lit(" ")))


def save_distribution(folder: str, name: str, chunker: str, adjustment: int, distribution: DataFrame) -> str:
    """The histogram as a local JSON file of pairs; one pair for each size class, so it is small."""
    path = os.path.join(folder, f"distribution-{name}-{chunker.split(',')[0]}-{adjustment}.json")
    rows = sorted((r.bucket, r.n) for r in distribution.collect())
    with open(path, "w") as out:
        json.dump([list(r) for r in rows], out)
    return path
