"""Streams of files into the chunk tables, each micro-batch exactly once.

Every arriving file is a write of its own. A batch appends its spans and those
of its chunks that earlier batches lack. All rows carry the batch id and a
repeated batch replaces what it wrote, so a restart adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators import store
from quernstone.operators.chunkers import Chunker, chunk

_CHUNKS = "hash binary, length long, data binary, batch long"
_SPANS = "file_name string, write_seq long, idx long, offset long, len long, hash binary, batch long"


def read_files(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """Files that arrive in a folder, as ``file_name, write_seq, bytes``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema)
    if per_batch:
        source = source.option("maxFilesPerTrigger", per_batch)
    return source.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit(0).cast("long").alias("write_seq"), F.col("content").alias("bytes")).drop("path")


def _known(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path).filter(F.col("batch") < before) if there else spark.createDataFrame([], schema)


def ingest(files: DataFrame, path: str, chunker: Chunker, hash_name: str = "sha256", **options) -> StreamingQuery:
    """Starts the stream into ``path``/chunks and ``path``/spans; ``options`` go to the writer's trigger."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        cut = chunk(df, chunker, hash_name, with_data=True)
        known = _known(spark, f"{path}/chunks", _CHUNKS, number).select("hash")
        new = store.insert_if_absent(known, store.first_payloads(cut))
        for table, rows in (("chunks", new), ("spans", cut.drop("data"))):
            rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{table}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/progress")
    return writer.trigger(**(options or {"availableNow": True})).start()


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Spans of the files so far; a file that arrived again is its last arrival."""
    spans = spark.read.schema(_SPANS).parquet(f"{path}/spans")
    last = F.max("batch").over(Window.partitionBy("file_name"))
    return store.recipes(spans.withColumn("_last", last).filter("batch = _last").drop("_last", "batch"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")


def dedup_over_time(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Distinct and all property payloads of an event stream by window of ``ts``, with a watermark for late rows."""
    keyed = events.select(F.col("ts").cast("timestamp").alias("ts"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("hash"), F.octet_length(F.coalesce("props", F.lit(""))).alias("n"))
    per = keyed.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("long").alias("bytes"), F.approx_count_distinct("hash").alias("distinct_payloads")).select(F.col("w.start").alias("start"), "rows", "bytes", "distinct_payloads")
