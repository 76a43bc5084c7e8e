"""Tables shared by the cluster's executors, and column helpers.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: the files
survive the loss of any executor, unlike a local checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.tables import shared_dir

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch of whole texts, unless the session sets its own.
BATCH_ROWS = 1000
#: Rows that a Parquet reader decodes at once, unless the session sets its own.
READER_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Lower the session's defaults of 10,000 rows an Arrow batch and 4,096 a read.

    A row may be a long text. Arrow batches are held outside the heap; a reader's texts are one array, which doubles as it
    fills and, above half a region, goes to the old generation at once, so that the heap grows.
    """
    for key, usual, rows in (("execution.arrow.maxRecordsPerBatch", 10_000, BATCH_ROWS), ("parquet.columnarReaderBatchSize", 4096, READER_ROWS)):
        if spark.conf.get(f"spark.sql.{key}") == str(usual):
            spark.conf.set(f"spark.sql.{key}", str(rows))


class Work:
    """A folder of intermediate tables, unique to one call of an operator.

    Results read them lazily, so they stay until :func:`cleanup`.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = shared_dir(spark)
        self.spark = spark
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _MADE.append(self)
        small_batches(spark)

    def save(self, df: DataFrame, table: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        path = f"{self.path}/{table}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            path.getFileSystem(conf).delete(path, True)


#: The folders that this session has made.
_MADE: list[Work] = []


def cleanup() -> None:
    """Delete all intermediate tables of this session; results that were not written yet are lost with them."""
    while _MADE:
        _MADE.pop().drop("")


def tokens_path(name: str) -> str:
    """Where the installed public tokenizer file is; resolved on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for working columns that no column of the input has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salt_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
