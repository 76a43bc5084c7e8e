"""The content-addressed store as relations: chunk table, recipes, and their measures.

Everything is a function of DataFrames. ``spans`` has a row for each chunk of
each file in order; ``chunks`` one for each distinct hash. Measures read lengths
only, so that column pruning keeps payloads out of the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.constants import SEGMENT
from quernstone.errors import InvalidInput
from quernstone.functions.hashing import ratio
from quernstone.operators.ordered import running
from quernstone.operators.tables import written


def files_of(df: DataFrame, name: str, payload: str, seq: Column | None = None) -> DataFrame:
    """A table's column as files: text is its UTF-8 bytes, null is empty."""
    n = F.lit(0).cast("long") if seq is None else seq.cast("long")
    return df.select(F.col(name).cast("string").alias("file_name"), n.alias("write_seq"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("bytes"))


def recipes(cut: DataFrame) -> DataFrame:
    """Spans of whole files: writes follow each other, and ``offset`` runs through the file."""
    order = Window.partitionBy("file_name").orderBy("write_seq", "idx")
    running = F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("len")
    rest = [c for c in cut.columns if c not in ("file_name", "idx", "offset", "len", "write_seq")]
    return cut.select("file_name", (F.row_number().over(order) - 1).cast("long").alias("span_idx"), "write_seq", running.alias("offset"), "len", *rest)


def unique_chunks(spans: DataFrame) -> DataFrame:
    """``hash, length, refs``: one row a hash. Equal hashes have equal lengths, so a hash aggregate does."""
    return spans.groupBy("hash").agg(F.min("len").alias("length"), F.count(F.lit(1)).alias("refs"))


def first_payloads(spans: DataFrame) -> DataFrame:
    """One payload a hash: that of its first place (file, write, index), chosen without payloads and then joined."""
    place = ["file_name", "write_seq", "idx"]
    first = spans.groupBy("hash").agg(F.min(F.struct(*place)).alias("_at"), F.min("len").alias("length"))
    first = first.select("hash", "length", *[F.col(f"_at.{c}").alias(c) for c in place])
    return spans.select(*place, "data").join(first, place).select("hash", "length", "data")


def insert_if_absent(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose hash ``chunks`` lacks, one a hash; old rows are never replaced."""
    return new.dropDuplicates(["hash"]).join(chunks.select("hash"), "hash", "left_anti")


def dedup_measures(spans: DataFrame, key_size: int = 32, by: list[str] | None = None, data_in_target: bool = False) -> DataFrame:
    """Sizes, counts and ratios of a store that holds ``spans``; ``by`` groups them.

    Bytes written count every span, unique bytes each hash once (within a group).
    ``full`` also counts the keys, ``total`` what a rewriting pass has moved.
    """
    by = by or []
    per = spans.groupBy(*by, "hash").agg(F.min("len").alias("len"), F.sum("len").alias("written"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    all_ = per.groupBy(*by).agg(zero(F.sum("written")).alias("size_written"), zero(F.sum("len")).alias("unique_size"), zero(F.sum("n")).alias("span_count"), F.count(F.lit(1)).alias("chunk_count"))
    cdc = F.lit(0) if data_in_target else F.col("unique_size")
    return all_.select(
        *by, "size_written", "unique_size", "span_count", "chunk_count",
        ratio(F.col("size_written"), cdc).alias("cdc_dedup_ratio"),
        ratio(F.col("size_written"), cdc + F.col("chunk_count") * key_size).alias("full_cdc_dedup_ratio"),
        ratio(F.col("size_written"), F.col("unique_size")).alias("total_dedup_ratio"),
        F.expr("try_divide(unique_size, chunk_count)").cast("long").alias("avg_chunk_size"),
    )


def chunk_ratio(spans: DataFrame) -> DataFrame:
    """All chunks over distinct ones, and all bytes over those of distinct ones."""
    per = unique_chunks(spans)
    out = per.agg(F.sum("refs").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("refs") * F.col("length")).alias("bytes"), F.sum("length").alias("distinct_bytes"))
    return out.select("chunks", "distinct_chunks", ratio(F.col("chunks"), F.col("distinct_chunks")).alias("chunk_ratio"), ratio(F.col("bytes"), F.col("distinct_bytes")).alias("data_ratio"))


def size_distribution(chunks: DataFrame, adjustment: int) -> DataFrame:
    """Distinct chunks by size, rounded down to a multiple of ``adjustment``."""
    if adjustment < 1:
        raise InvalidInput("the adjustment must be at least 1")
    return chunks.groupBy(F.expr(f"length div {adjustment} * {adjustment}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def chunk_count_distribution(spans: DataFrame, include_last: bool = False) -> DataFrame:
    """How often each hash is in each file, and its first length; a file's last span is left out unless asked for."""
    order = Window.partitionBy("file_name").orderBy("span_idx")
    s = spans if include_last else spans.withColumn("_next", F.lead("offset").over(order)).filter("_next is not null")
    return s.groupBy("file_name", "hash").agg(F.count(F.lit(1)).alias("n"), F.min_by("len", "span_idx").alias("length"))


def segments(spans: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Greedy segments of whole spans, at most ``size`` bytes each; a longer span stands alone.

    One pass over the ordered lengths of each file, a number at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, segment, count, total = None, -1, 0, 0
        for b in batches:
            out = []
            for file, n in zip(b.column("file_name").to_pylist(), b.column("len").to_pylist(), strict=True):
                if segment < 0 or file != name or (count and total + n > size):
                    if count:
                        out.append((name, segment, count, total))
                    name, segment, count, total = file, segment + 1 if file == name and segment >= 0 else 0, 0, 0
                count, total = count + 1, total + n
            yield _segments(out)
        if count:
            yield _segments([(name, segment, count, total)])

    ordered = spans.select("file_name", "span_idx", "len").repartition("file_name").sortWithinPartitions("file_name", "span_idx")
    return ordered.mapInArrow(run, "file_name string, segment long, n_spans long, n_bytes long")


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file_name": pa.string(), "segment": pa.int64(), "n_spans": pa.int64(), "n_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def _joined(data: str, order: str) -> Column:
    """Binary parts of a group in order, as one."""
    return F.coalesce(F.expr(f"listagg({data}) within group (order by {order})"), F.lit(b""))


def retrieve(spans: DataFrame, chunks: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Spans with their payload; a missing chunk is an error when the row is read.

    A chunk that a rewriting pass moved lists keys of ``target``; their values in
    that order are its payload.
    """
    miss = F.raise_error(F.concat(F.lit("missing chunk "), F.hex("hash"))).cast("binary")
    out = spans.join(chunks.select("hash", F.col("data").alias("_data"), "target_keys") if target is not None else chunks.select("hash", F.col("data").alias("_data")), "hash", "left")
    if target is None:
        return out.withColumn("data", F.coalesce("_data", miss)).drop("_data")
    moved = chunks.filter("target_keys is not null").select("hash", F.posexplode("target_keys").alias("_pos", "key"))
    moved = moved.join(target.withColumnRenamed("data", "_part"), "key", "left").withColumn("_part", F.coalesce("_part", F.raise_error(F.lit("missing target")).cast("binary")))
    joined = moved.groupBy("hash").agg(_joined("_part", "_pos").alias("_moved"))
    return out.join(joined, "hash", "left").withColumn("data", F.coalesce("_data", "_moved", miss)).drop("_data", "_moved", "target_keys")


def missing(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans whose hash the chunk table lacks."""
    return spans.join(chunks.select("hash"), "hash", "left_anti")


def reassemble(with_data: DataFrame) -> DataFrame:
    """Whole files from spans with payload: ``file_name, content``. A group is one file."""
    return with_data.groupBy("file_name").agg(_joined("data", "span_idx").alias("content"))


def verify(files: DataFrame, content: DataFrame) -> DataFrame:
    """Files whose stored content differs from what was written; a missing file differs unless it is empty."""
    whole = files.groupBy("file_name").agg(_joined("bytes", "write_seq").alias("wrote"))
    both = whole.join(content, "file_name", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    return both.filter((F.octet_length("wrote") != F.octet_length("content")) | (F.sha2("wrote", 256) != F.sha2("content", 256))).select("file_name")


def verify_writes(files: DataFrame, with_data: DataFrame) -> DataFrame:
    """Writes ``file_name, write_seq`` whose spans differ from their bytes; a file of many writes is many groups.

    Digests and lengths are compared, so no two payloads meet; spans of a write
    that ``files`` does not have differ too.
    """
    key = ["file_name", "write_seq"]
    stored = with_data.groupBy(*key).agg(_joined("data", "span_idx").alias("_c")).select(*key, F.sha2("_c", 256).alias("_stored"))
    wrote = files.select(*key, F.sha2(F.coalesce("bytes", F.lit(b"")), 256).alias("_wrote"))
    nothing = F.sha2(F.lit(b""), 256)
    return wrote.join(stored, key, "full").filter(F.coalesce("_wrote", nothing) != F.coalesce("_stored", nothing)).select(*key)


def corpus_spans(spans: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Spans of many files as those of one file, in an order that grows with the integer ``key``."""
    return running(written(spans.select("hash", "len", *dict.fromkeys([key, *order]))), key, order, {}, place="g").select("g", "hash", "len")


def to_dedup_ratio(spans: DataFrame, wanted: float) -> DataFrame:
    """A new recipe ``part, cycle, place, hash, len`` that nears a deduplication ratio.

    ``spans`` has the dense place ``g`` of each span. The first distinct spans are
    repeated in turn up to a number of bytes, the others follow once. The last
    span of the input is left out, as no other begins at its end; the wish bounds
    the repeated bytes alone, so the whole achieves about ``r + 1 - 1/r``.
    """
    if wanted < 1:
        raise InvalidInput("the ratio must be at least 1")
    spans = written(spans.select("g", "hash", "len"))
    last = spans.agg(F.max("g").alias("_last"))
    body = spans.join(F.broadcast(last), F.col("g") < F.col("_last")).drop("_last")  # one row
    first = body.groupBy("hash").agg(F.min("g").alias("g"), F.min_by("len", "g").alias("len"))
    ranked = written(running(written(first), "g", ["g"], {"upto": "len"}, place="place"))
    k = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("unique")).select(F.expr(f"cast(unique * cast({wanted!r} as double) as bigint)").alias("total"), F.ceil(F.col("n") * (1.0 / F.lit(wanted))).cast("long").alias("repeating"))
    ranked = ranked.crossJoin(F.broadcast(k))  # one row
    rep = ranked.filter("place <= repeating")
    # Every cycle adds the same bytes, so the sum at a place of a cycle needs no window over the cycles.
    cycles = rep.agg(F.sum("len").alias("turn"), F.max("total").alias("_total")).select("turn", F.explode(F.expr("sequence(0L, _total div turn)")).alias("cycle"))
    repeated = rep.crossJoin(F.broadcast(cycles)).filter(F.col("cycle") * F.col("turn") + F.col("upto") <= F.col("total"))
    return repeated.select(F.lit(0).alias("part"), "cycle", "place", "hash", "len").unionAll(ranked.filter("place > repeating").select(F.lit(1), F.lit(0).cast("long"), "place", "hash", "len"))


def distribution_json(distribution: DataFrame) -> DataFrame:
    """One row ``json``: ``[[bucket,count],...]`` by bucket."""
    pairs = F.sort_array(F.collect_list(F.array("bucket", "n")))
    return distribution.agg(F.to_json(pairs).alias("json"))


def scrub_copy(chunks: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves every payload to the target under its own hash; the chunk lists that key. Idempotent.

    Returns the new chunk table, the new target, and one row ``processed_data, data_left``.
    """
    moved = chunks.filter("data is not null").select(F.col("hash").alias("key"), "data")
    left = chunks.select("hash", "length", F.lit(None).cast("binary").alias("data"), F.array("hash").alias("target_keys"))
    done = chunks.agg(F.coalesce(F.sum(F.when(F.col("data").isNotNull(), F.col("length"))), F.lit(0)).alias("processed_data"), F.lit(0).cast("long").alias("data_left"))
    return left, target.unionByName(moved.join(target.select("key"), "key", "left_anti")), done


def scrub_nothing(chunks: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pass that changes nothing."""
    return chunks, target, chunks.limit(0).agg(F.lit(0).cast("long").alias("processed_data"), F.lit(0).cast("long").alias("data_left"))
