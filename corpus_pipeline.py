"""The corpus pipeline: quality, near copies, personal data, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a DataFrame, which is written as Parquet and read again.

Null, empty and blank texts have the score of no evidence, which the model sets;
they are no copies and hold no personal data, and mixing takes words, so they
give nothing there. Rows of one
``doc_id`` stay separate documents throughout; equal ones are exact copies, of
which each row of the first document stays. A null ``doc_id`` counts as the least,
a null source as a source of its own. Further columns are carried along, whatever
their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import mixing, neardup, packing, pii, quality
from quernstone.llm.shared import Work, fresh, table


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` (where there is such a column) as the text now has it."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[f"`{c}`" for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line CRF scores below one half."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return neardup.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; ``n_chars`` is counted anew, null texts stay null."""
    out = pii.with_spans(docs, spans=fresh(docs.columns, "pii_spans")[0], redacted="text")
    return _counted(out, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies and parts of documents that bring every source to its target; texts without words give none."""
    return _counted(mixing.mixed_documents(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, with their ids, in sequences of at most 4,096 tokens."""
    return packing.pack_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_first),
    ("PII", redact),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Models and token ids cannot be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
