"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quernstone.errors import InvalidInput

#: Used only by local sessions that name no shared folder.
DEFAULT_DIR = "file:///tmp/checkpoints/quernstone"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; without one, a local session has a default and a cluster has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise InvalidInput("spark.checkpoint.dir must name a folder that the cluster shares")
    return base or DEFAULT_DIR


def written(df: DataFrame) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read from there, for plans that use it several times."""
    spark = df.sparkSession
    base = shared_dir(spark)
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
