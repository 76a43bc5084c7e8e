"""Command line: measure chunkers, or print a deduplication ratio.

    python -m quernstone.cli measure PATH --chunker ultra --min 4 --avg 8 --max 16 --report-path out
    python -m quernstone.cli run-config config.toml
"""

from __future__ import annotations

import argparse
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from quernstone.errors import InvalidInput
from quernstone.operators.chunkers import from_options
from quernstone.operators.filesystem import FileStore
from quernstone.operators.harness import Dataset, Fixture
from quernstone.operators.report import append_csv, save_distribution
from quernstone.sources.readers import config

CHUNKERS = ("super", "rabin", "seq", "ultra", "leap", "fixed-size", "fast")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quernstone", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("measure", "dedup-ratio"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--chunker", choices=CHUNKERS, default="fast")
        s.add_argument("--seq-mode", choices=("increasing", "decreasing"))
        s.add_argument("--hasher", default="sha256", choices=("sha256", "simple"))
        s.add_argument("--database", default="parquet", choices=("parquet", "hashmap"), help="both names mean the Parquet tables")
        for k, v in (("min", 8), ("avg", 16), ("max", 64)):
            s.add_argument(f"--{k}", type=int, default=v, help="KiB")
        s.add_argument("--report-path")
        s.add_argument("--count", type=int, default=1)
        s.add_argument("--cleanup", action="store_true", help="empty the store before each run")
        s.add_argument("--adjustment", type=int, default=1000)
        s.add_argument("--fill-paths", nargs="*", default=[])
    sub.add_parser("run-config").add_argument("config")
    return p


def from_config(path: str) -> argparse.Namespace:
    found = config(path)
    (name, own), = found["command"].items()
    out = parser().parse_args([name, str(own.get("path", own.get("dataset", "")))])
    for k, v in {**found["args"], **own}.items():
        if k in ("path", "dataset"):
            continue
        key = k.replace("-", "_")
        if not hasattr(out, key):
            raise InvalidInput(f"unknown setting {k}")
        setattr(out, key, v)
    return out


def run(args: argparse.Namespace, spark: SparkSession) -> list:
    """Runs a command and returns its measurements."""
    if args.command == "run-config":
        args = from_config(args.config)
    if args.report_path and not os.path.isdir(args.report_path):
        raise InvalidInput(f"{args.report_path} is not a folder")
    if args.adjustment < 1:
        raise InvalidInput("the adjustment must be at least 1")
    chunker = from_options(args.chunker, args.min, args.avg, args.max, args.seq_mode)
    base = spark.conf.get("spark.checkpoint.dir", None)
    own = None if base else tempfile.mkdtemp()
    files = FileStore(spark, f"{base or own}/cli-{os.getpid()}", args.hasher)
    fixture, dataset, out = Fixture(files), Dataset(spark, args.path), []
    try:
        for k in range(args.count):
            if args.cleanup or k == 0:
                files.clear()
                for p in args.fill_paths:
                    fixture.fill_with(Dataset(spark, p), chunker)
            out.append(fixture.measure(dataset, chunker))
            print(out[-1].dedup_ratio if args.command == "dedup-ratio" else out[-1])
            if args.report_path:
                append_csv(os.path.join(args.report_path, "report.csv"), out[-1:])
                if args.command == "measure":
                    save_distribution(args.report_path, f"{dataset.name}.{k}", chunker.label, args.adjustment, files.size_distribution(args.adjustment))
    finally:
        files.clear()
        if own:
            shutil.rmtree(own, ignore_errors=True)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(args, SparkSession.builder.appName("quernstone").getOrCreate())


if __name__ == "__main__":
    main()
