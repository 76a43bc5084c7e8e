"""Contract queries of the core operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.kernels import KERNELS, Sizes
from quernstone.operators import store
from quernstone.operators.chunkers import cdc, chunk, chunk_pieces, fixed, violations

Query = Callable[[SparkSession, str], DataFrame]
SMALL = Sizes(128, 256, 1024)
GRID = {"documents": ("doc_id", "text"), "pages": ("page_id", "html")}

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return store.files_of(_read(spark, sf_dir, name), *GRID[name])


def _fixed(spark: SparkSession, sf_dir: str, size: int = 1024, hash_name: str | None = "sha256", name: str = "documents") -> DataFrame:
    """Spans of a table's texts, one file a row; the id is a number again."""
    return chunk(_files(spark, sf_dir, name), fixed(size), hash_name).withColumn("doc_id", F.col("file_name").cast("long"))


def _hex(c: str = "hash") -> F.Column:
    return F.lower(F.hex(c))


def _cut(size: int = 1024, name: str = "documents") -> str:
    """The SQL of fixed-size chunks of a table."""
    key, text = GRID[name]
    return f"""c AS (SELECT doc_id, source, lang, o // {size} AS idx, o AS off, least({size}, n - o)::BIGINT AS len, sha256(b[o + 1 : o + {size}]) AS h
    FROM (SELECT {key} AS doc_id, {"source, lang" if name == "documents" else "NULL AS source, NULL AS lang"}, encode({text}) AS b, octet_length(encode({text})) AS n FROM {name}) f,
    LATERAL (SELECT unnest(range(0, n, {size})) AS o))"""


_U = "u AS (SELECT h, min(len) AS len, sum(len)::BIGINT AS written, count(*)::BIGINT AS refs FROM c GROUP BY h)"


def _with(tail: str, size: int = 1024, name: str = "documents") -> str:
    return f"WITH {_cut(size, name)}, {_U} {tail}"


@query("scan_datasets", "SELECT doc_id, octet_length(encode(text))::BIGINT AS size FROM documents")
def scan_datasets(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select(F.col("file_name").cast("long").alias("doc_id"), F.octet_length("bytes").cast("long").alias("size"))


@query("chunk_fixed", _with("SELECT doc_id, idx, off, len FROM c"))
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _fixed(spark, d, hash_name=None).select("doc_id", "idx", F.col("offset").alias("off"), "len")


@query("hash_sha256", _with("SELECT doc_id, idx, h AS hash FROM c"))
def hash_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _fixed(spark, d).select("doc_id", "idx", _hex().alias("hash"))


@query("hash_md5", "SELECT doc_id, md5(text) AS digest FROM documents")
def hash_md5(spark: SparkSession, d: str) -> DataFrame:
    from quernstone.functions.hashing import hasher

    return _read(spark, d, "documents").select("doc_id", F.lower(F.hex(hasher("md5").of(F.col("text").cast("binary")))).alias("digest"))


@query("hash_simple", _with("SELECT count(*)::BIGINT AS spans, count(DISTINCT h)::BIGINT AS chunks FROM c"))
def hash_simple(spark: SparkSession, d: str) -> DataFrame:
    return _fixed(spark, d, hash_name="simple").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("hash").alias("chunks"))


@query("estimate_chunks", "SELECT doc_id, n // 1024 + 1 AS fixed_size, n // 128 AS by_min, n // 256 AS by_avg FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents)")
def estimate_chunks(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length(F.col("bytes")).cast("long")
    return _files(spark, d).select(F.col("file_name").cast("long").alias("doc_id"), fixed(1024).estimate(n).alias("fixed_size"), cdc("fast", SMALL).estimate(n).alias("by_min"), cdc("seq", SMALL).estimate(n).alias("by_avg"))


@query("chunk_store", _with("SELECT h AS hash, len AS length, refs FROM u"))
def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    return store.unique_chunks(_fixed(spark, d)).select(_hex().alias("hash"), "length", "refs")


@query("chunk_payloads", _with("SELECT DISTINCT h AS hash, len AS length, h AS digest FROM c", 4096))
def chunk_payloads(spark: SparkSession, d: str) -> DataFrame:
    cut = chunk(_files(spark, d), fixed(), with_data=True)
    return store.first_payloads(cut).select(_hex().alias("hash"), "length", F.sha2("data", 256).alias("digest"))


def _measure_sql(column: str, value: str) -> str:
    return _with(f"SELECT {value} AS {column} FROM u")


def _measure(column: str) -> Query:
    return lambda spark, d: store.dedup_measures(_fixed(spark, d)).select(column)


for _name, _sql in {
    "cdc_dedup_ratio": "sum(written)::DOUBLE / sum(len)",
    "full_cdc_dedup_ratio": "sum(written)::DOUBLE / (sum(len) + 32 * count(*))",
    "total_dedup_ratio": "sum(written)::DOUBLE / sum(len)",
    "avg_chunk_size": "(sum(len) // count(*))::BIGINT",
    "chunk_count": "count(*)::BIGINT",
    "size_written": "sum(written)::BIGINT",
    "unique_size": "sum(len)::BIGINT",
}.items():
    query(_name, _measure_sql(_name, _sql))(_measure(_name))


def _by(column: str) -> None:
    sql = f"""WITH {_cut()}, u AS (SELECT {column}, h, min(len) AS len, sum(len) AS written FROM c GROUP BY {column}, h)
    SELECT {column}, sum(written)::BIGINT AS size_written, sum(len)::BIGINT AS unique_size, count(*)::BIGINT AS chunk_count, sum(written)::DOUBLE / sum(len) AS cdc_dedup_ratio FROM u GROUP BY {column}"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _read(spark, d, "documents")
        # The column takes the place of the file's name, so the texts are chunked where they are read.
        files = docs.select(F.col(column).alias("file_name"), F.col("doc_id").alias("write_seq"), F.col("text").cast("binary").alias("bytes"))
        cut = chunk(files, fixed(1024))
        return store.dedup_measures(cut.withColumnRenamed("file_name", column), by=[column]).select(column, "size_written", "unique_size", "chunk_count", "cdc_dedup_ratio")

    query(f"dedup_ratio_by_{column}", sql)(run)


_by("source")
_by("lang")


@query("chunk_ratio", _with("SELECT sum(refs)::BIGINT AS chunks, count(*)::BIGINT AS distinct_chunks, sum(refs)::DOUBLE / count(*) AS chunk_ratio, sum(written)::DOUBLE / sum(len) AS data_ratio FROM u"))
def chunk_ratio(spark: SparkSession, d: str) -> DataFrame:
    return store.chunk_ratio(_fixed(spark, d))


def _sizes(adjustment: int) -> None:
    query(f"size_distribution_{adjustment}", _with(f"SELECT len // {adjustment} * {adjustment} AS bucket, count(*)::BIGINT AS n FROM u GROUP BY 1"))(lambda spark, d: store.size_distribution(store.unique_chunks(_fixed(spark, d)), adjustment))


for _a in (100, 500, 1000):
    _sizes(_a)


@query("distribution_json", _with("SELECT '[' || string_agg('[' || bucket || ',' || n || ']', ',' ORDER BY bucket) || ']' AS json FROM (SELECT len // 100 * 100 AS bucket, count(*) AS n FROM u GROUP BY 1)"))
def distribution_json(spark: SparkSession, d: str) -> DataFrame:
    return store.distribution_json(store.size_distribution(store.unique_chunks(_fixed(spark, d)), 100))


@query("chunk_count_distribution", f"""WITH {_cut(256)}, s AS (SELECT *, lead(off) OVER (PARTITION BY doc_id ORDER BY idx) AS nx FROM c)
    SELECT doc_id, h AS hash, count(*)::BIGINT AS n, min_by(len, idx) AS length FROM s WHERE nx IS NOT NULL GROUP BY doc_id, h""")
def chunk_count_distribution(spark: SparkSession, d: str) -> DataFrame:
    spans = store.recipes(chunk(_files(spark, d), fixed(256)))
    return store.chunk_count_distribution(spans).select(F.col("file_name").cast("long").alias("doc_id"), _hex().alias("hash"), "n", "length")


@query("file_offsets", """WITH f AS (SELECT conv_id, turn, encode(text) AS b, octet_length(encode(text)) AS n FROM conversations),
    c AS (SELECT conv_id, turn, o // 100 AS idx, least(100, n - o)::BIGINT AS len FROM f, LATERAL (SELECT unnest(range(0, n, 100)) AS o))
    SELECT conv_id, (row_number() OVER w - 1)::BIGINT AS span_idx, (sum(len) OVER w - len)::BIGINT AS off, len FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, idx ROWS UNBOUNDED PRECEDING)""")
def file_offsets(spark: SparkSession, d: str) -> DataFrame:
    files = store.files_of(_read(spark, d, "conversations"), "conv_id", "text", F.col("turn"))
    spans = store.recipes(chunk(files, fixed(100), None))
    return spans.select(F.col("file_name").cast("long").alias("conv_id"), "span_idx", F.col("offset").alias("off"), "len")


@query("segmented_read", f"""WITH RECURSIVE {_cut(1000)}, r AS (
    SELECT doc_id, idx, len, len AS acc, 0::BIGINT AS seg FROM c WHERE idx = 0
    UNION ALL SELECT c.doc_id, c.idx, c.len, CASE WHEN r.acc + c.len <= 4096 THEN r.acc + c.len ELSE c.len END, CASE WHEN r.acc + c.len <= 4096 THEN r.seg ELSE r.seg + 1 END
    FROM r JOIN c ON c.doc_id = r.doc_id AND c.idx = r.idx + 1)
    SELECT doc_id, seg, count(*)::BIGINT AS n_spans, sum(len)::BIGINT AS n_bytes FROM r GROUP BY doc_id, seg""")
def segmented_read(spark: SparkSession, d: str) -> DataFrame:
    spans = store.recipes(chunk(_files(spark, d), fixed(1000), None))
    return store.segments(spans, 4096).select(F.col("file_name").cast("long").alias("doc_id"), F.col("segment").alias("seg"), "n_spans", "n_bytes")


@query("retrieve_join", _with("SELECT doc_id, idx, h AS digest FROM c"))
def retrieve_join(spark: SparkSession, d: str) -> DataFrame:
    cut = chunk(_files(spark, d), fixed(1024), with_data=True)
    out = store.retrieve(store.recipes(cut.drop("data")), store.first_payloads(cut))
    return out.select(F.col("file_name").cast("long").alias("doc_id"), F.col("span_idx").alias("idx"), F.sha2("data", 256).alias("digest"))


@query("missing_chunks", f"WITH {_cut(64)}, {_cut(64, 'pages').replace('c AS', 'p AS', 1)} SELECT doc_id, idx FROM c WHERE h NOT IN (SELECT h FROM p)")
def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents that a store of the pages lacks."""
    return store.missing(_fixed(spark, d, 64), store.unique_chunks(_fixed(spark, d, 64, name="pages"))).select("doc_id", "idx")


@query("missing_in_own_store", "SELECT doc_id, 0::BIGINT AS idx FROM documents WHERE false")
def missing_in_own_store(spark: SparkSession, d: str) -> DataFrame:
    spans = _fixed(spark, d)
    return store.missing(spans, store.unique_chunks(spans)).select("doc_id", "idx")


@query("insert_if_absent", f"WITH {_cut()} SELECT DISTINCT h AS hash, len AS length FROM c WHERE source = 'src1' AND h NOT IN (SELECT h FROM c WHERE source = 'src0')")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    one, two = (store.unique_chunks(chunk(store.files_of(docs.filter(F.col("source") == s), "doc_id", "text"), fixed(1024))) for s in ("src0", "src1"))
    return store.insert_if_absent(one, two).select(_hex().alias("hash"), "length")


@query("chunk_overlap", f"""WITH {_cut()}, s AS (SELECT DISTINCT source, h, len FROM c)
    SELECT a.source AS source_a, b.source AS source_b, count(*)::BIGINT AS shared, sum(a.len)::BIGINT AS shared_bytes FROM s a JOIN s b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that two sources share: from the set of sources of each hash, at most one pair a source pair and hash."""
    docs = _read(spark, d, "documents").select(F.col("source").alias("file_name"), F.col("doc_id").alias("write_seq"), F.col("text").cast("binary").alias("bytes"))
    per = chunk(docs, fixed(1024)).groupBy("hash").agg(F.array_sort(F.collect_set("file_name")).alias("s"), F.min("len").alias("len")).filter(F.size("s") > 1)
    one = per.select("len", "s", F.posexplode("s").alias("i", "source_a"))
    two = one.select("len", "source_a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("source_b"))
    return two.groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("shared"), F.sum("len").alias("shared_bytes"))


@query("file_exists", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)")
def file_exists(spark: SparkSession, d: str) -> DataFrame:
    names = _files(spark, d).select(F.col("file_name").cast("long").alias("doc_id"))
    return _read(spark, d, "labels").join(names, "doc_id", "left_semi").select("doc_id", "quality")


@query("list_files", "SELECT DISTINCT conv_id::VARCHAR AS file_name FROM conversations")
def list_files(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file_name")).distinct()


def _to_ratio(r: float) -> None:
    sql = f"""WITH {_cut()}, x AS (SELECT row_number() OVER (ORDER BY doc_id, off) AS g, h, len, lead(off) OVER (ORDER BY doc_id, off) AS nx FROM c),
    f AS (SELECT h, min(g) AS g, min_by(len, g) AS len FROM x WHERE nx IS NOT NULL GROUP BY h),
    p AS (SELECT h, len, row_number() OVER (ORDER BY g) AS p FROM f),
    k AS (SELECT count(*) AS n, sum(len) AS ul, trunc(sum(len) * {r}::DOUBLE)::BIGINT AS total, ceil(count(*) * (1.0::DOUBLE / {r}::DOUBLE))::BIGINT AS nr FROM p),
    rep AS (SELECT p.* FROM p, k WHERE p.p <= k.nr),
    y AS (SELECT q.c, rep.p, rep.h, rep.len, sum(rep.len) OVER (ORDER BY q.c, rep.p ROWS UNBOUNDED PRECEDING) AS cum FROM rep, (SELECT unnest(range(0, (SELECT (total // (SELECT sum(len) FROM rep) + 2)::BIGINT FROM k))) AS c) q),
    z AS (SELECT h, len FROM y, k WHERE cum <= total UNION ALL SELECT h, len FROM p, k WHERE p.p > k.nr),
    d AS (SELECT h, min(len) AS len FROM z GROUP BY h)
    SELECT count(*)::BIGINT AS n_spans, sum(len)::BIGINT AS n_bytes, (SELECT nr FROM k) AS repeating, sum(len)::DOUBLE / (SELECT sum(len) FROM d) AS achieved FROM z"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        spans = store.corpus_spans(_fixed(spark, d), "doc_id", ["doc_id", "idx"])
        made = store.to_dedup_ratio(spans, r)
        per = made.groupBy("hash").agg(F.min("len").alias("len"), F.sum("len").alias("all"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("part") == 0, F.col("place"))).alias("place"))
        return per.agg(F.sum("n").alias("n_spans"), F.sum("all").alias("n_bytes"), F.max("place").alias("repeating"), (F.sum("all").cast("double") / F.sum("len")).alias("achieved"))

    query(f"get_to_dedup_ratio_{r:g}", sql)(run)


for _r in (1.0, 2.0, 4.0):
    _to_ratio(_r)


@query("repeated_ratio", _with("SELECT k, k * sum(written)::DOUBLE / sum(len) AS cdc_dedup_ratio FROM u, (SELECT unnest(range(1, 4)) AS k) GROUP BY k"))
def repeated_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The ratio after the same data was written once, twice and three times: no chunk is new after the first."""
    one = store.dedup_measures(_fixed(spark, d))
    return spark.range(1, 4).withColumnRenamed("id", "k").crossJoin(one).select("k", (F.col("k") * F.col("size_written") / F.col("unique_size")).alias("cdc_dedup_ratio"))


@query("fill_then_measure", f"""WITH {_cut(1024, "documents")}, p AS (SELECT sha256(b[o + 1 : o + 1024]) AS h, least(1024, n - o) AS len FROM (SELECT encode(html) AS b, octet_length(encode(html)) AS n FROM pages), LATERAL (SELECT unnest(range(0, n, 1024)) AS o)),
    a AS (SELECT h, len FROM c UNION ALL SELECT h, len FROM p), u AS (SELECT h, min(len) AS len, sum(len) AS written FROM a GROUP BY h)
    SELECT sum(written)::BIGINT AS size_written, count(*)::BIGINT AS chunk_count, sum(written)::DOUBLE / sum(len) AS cdc_dedup_ratio FROM u""")
def fill_then_measure(spark: SparkSession, d: str) -> DataFrame:
    both = _fixed(spark, d, name="pages").unionByName(_fixed(spark, d))
    return store.dedup_measures(both).select("size_written", "chunk_count", "cdc_dedup_ratio")


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cut = chunk(_files(spark, d), fixed(1024), with_data=True)
    chunks = store.first_payloads(cut).withColumn("target_keys", F.lit(None).cast("array<binary>"))
    return cut, chunks, spark.createDataFrame([], "key binary, data binary")


@query("scrub_copy", _with("SELECT h AS hash, true AS moved, h AS target_key, len AS target_length FROM u"))
def scrub_copy(spark: SparkSession, d: str) -> DataFrame:
    chunks, target, _ = store.scrub_copy(*_store(spark, d)[1:])
    one = chunks.select(F.col("hash"), F.col("data").isNull().alias("moved"), F.explode("target_keys").alias("key"))
    return one.join(target, "key").select(_hex().alias("hash"), "moved", _hex("key").alias("target_key"), F.octet_length("data").cast("long").alias("target_length"))


@query("scrub_measurements", _with("SELECT sum(len)::BIGINT AS processed_data, 0::BIGINT AS data_left FROM u"))
def scrub_measurements(spark: SparkSession, d: str) -> DataFrame:
    return store.scrub_copy(*_store(spark, d)[1:])[2]


_WHOLE = "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS size FROM documents"


def _digests(content: DataFrame) -> DataFrame:
    return content.select(F.col("file_name").cast("long").alias("doc_id"), F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("size"))


@query("scrubbed_read", _WHOLE)
def scrubbed_read(spark: SparkSession, d: str) -> DataFrame:
    """Files read back after every payload moved to the target."""
    cut, chunks, target = _store(spark, d)
    chunks, target, _ = store.scrub_copy(chunks, target)
    return _digests(store.reassemble(store.retrieve(store.recipes(cut.drop("data")), chunks, target)))


def _round_trip(kind: str, chunker) -> None:
    def round_trip(spark: SparkSession, d: str) -> DataFrame:
        cut = chunk(_files(spark, d), chunker, with_data=True)
        return _digests(store.reassemble(store.retrieve(store.recipes(cut.drop("data")), store.first_payloads(cut))))

    def invariants(spark: SparkSession, d: str) -> DataFrame:
        files = _files(spark, d)
        return violations(chunk(files, chunker, None), files, chunker)

    def dedup(spark: SparkSession, d: str) -> DataFrame:
        return store.dedup_measures(chunk(_files(spark, d), chunker))

    name = kind.replace("-", "_")
    query(f"roundtrip_{name}", _WHOLE)(round_trip)
    query(f"chunk_invariants_{name}", "SELECT count(*)::BIGINT AS files, 0::BIGINT AS gaps, 0::BIGINT AS out_of_bounds, 0::BIGINT AS uncovered_bytes FROM documents")(invariants)
    if kind != "fixed":
        query(f"dedup_{name}")(dedup)


_round_trip("fixed", fixed(1024))
for _kind in list(KERNELS):
    _round_trip(_kind, cdc(_kind, SMALL))


def _pieces(spark: SparkSession, d: str, size: int = 1000) -> DataFrame:
    """The documents' bytes in pieces."""
    files = _files(spark, d).withColumn("n", F.octet_length("bytes"))
    each = files.select("file_name", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((n - 1) div {size} as int)")))).alias("piece"))
    return each.select("file_name", "piece", (F.col("piece") * size).cast("long").alias("offset"), F.substring("bytes", F.col("piece") * size + 1, F.lit(size)).alias("bytes"))


for _kind in ("fixed-size", *KERNELS):
    _chunker = fixed(777) if _kind == "fixed-size" else cdc(_kind, SMALL)

    def _stream(spark: SparkSession, d: str, chunker=_chunker) -> DataFrame:
        """Files that arrive in pieces, chunked with a carry between them and put together again."""
        spans = chunk_pieces(_pieces(spark, d), chunker, None)
        return _digests(store.reassemble(spans.withColumnRenamed("idx", "span_idx")))

    def _same(spark: SparkSession, d: str, chunker=_chunker) -> DataFrame:
        """Spans that are cut from pieces but not from the whole payload, or the other way round."""
        one = chunk_pieces(_pieces(spark, d), chunker, None).select("file_name", "idx", "offset", "len")
        two = chunk(_files(spark, d), chunker, None).select("file_name", "idx", "offset", "len")
        both = one.withColumn("side", F.lit(1)).union(two.withColumn("side", F.lit(-1))).groupBy("file_name", "idx", "offset", "len").agg(F.sum("side").alias("side"))
        return both.agg(F.count_if(F.col("side") != 0).alias("different"), F.countDistinct("file_name").alias("files"))

    query(f"stream_roundtrip_{_kind.replace('-', '_')}", _WHOLE)(_stream)
    query(f"stream_cuts_{_kind.replace('-', '_')}", "SELECT 0::BIGINT AS different, count(*)::BIGINT AS files FROM documents WHERE text <> ''")(_same)


@query("verify_writes", "SELECT count(*)::BIGINT AS writes, 0::BIGINT AS mismatches FROM conversations")
def verify_writes(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of a conversation is a write of its file; each is compared by itself."""
    files = store.files_of(_read(spark, d, "conversations"), "conv_id", "text", F.col("turn"))
    cut = chunk(files, fixed(64), with_data=True)
    bad = store.verify_writes(files, store.retrieve(store.recipes(cut.drop("data")), store.first_payloads(cut)))
    return files.agg(F.count(F.lit(1)).alias("writes")).crossJoin(bad.agg(F.count(F.lit(1)).alias("mismatches")))  # one row each


@query("scrub_nothing", _with("SELECT h AS hash, len AS length, 0::BIGINT AS processed_data, 0::BIGINT AS data_left FROM u"))
def scrub_nothing(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table after the pass that changes nothing, with what that pass reports."""
    chunks, _, done = store.scrub_nothing(*_store(spark, d)[1:])
    return chunks.select(_hex().alias("hash"), "length").crossJoin(done)  # one row


@query("param_grid", """SELECT a AS min_size, b AS avg_size, c AS max_size FROM (SELECT unnest([1024, 2048, 4096])::BIGINT AS a), (SELECT unnest([4096, 20000])::BIGINT AS b), (SELECT unnest([40000, 60000, 10000])::BIGINT AS c) WHERE a <= b AND b <= c""")
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, values: spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("long") for v in values])).alias(name))
    grid = one("min_size", [1024, 2048, 4096]).crossJoin(one("avg_size", [4096, 20000])).crossJoin(one("max_size", [40000, 60000, 10000]))
    return grid.filter("min_size <= avg_size and avg_size <= max_size")


_SIZES = (256, 512, 1024, 4096)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in GRID:
        for size in _SIZES:
            row = store.dedup_measures(_fixed(spark, d, size, name=name)).select(F.lit(name).alias("name"), F.lit(f"fixed-{size}").alias("chunker"), F.col("size_written").alias("size"), F.col("cdc_dedup_ratio").alias("dedup_ratio"), "full_cdc_dedup_ratio", "avg_chunk_size", "chunk_count")
            out = row if out is None else out.unionByName(row)
    return out


def _matrix_sql() -> str:
    rows = []
    for name in GRID:
        for size in _SIZES:
            rows.append(f"""SELECT '{name}' AS name, 'fixed-{size}' AS chunker, sum(written)::BIGINT AS size, sum(written)::DOUBLE / sum(len) AS dedup_ratio,
    sum(written)::DOUBLE / (sum(len) + 32 * count(*)) AS full_cdc_dedup_ratio, (sum(len) // count(*))::BIGINT AS avg_chunk_size, count(*)::BIGINT AS chunk_count
    FROM (WITH {_cut(size, name)}, {_U} SELECT * FROM u)""")
    return " UNION ALL ".join(rows)


query("dataset_chunker_matrix", _matrix_sql())(_matrix)


@query("report_pivot", f"SELECT name, {', '.join(f'''max(dedup_ratio) FILTER (chunker = 'fixed-{s}') AS fixed_{s}''' for s in _SIZES)} FROM ({_matrix_sql()}) GROUP BY name")
def report_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = _matrix(spark, d).groupBy("name").pivot("chunker", [f"fixed-{s}" for s in _SIZES]).agg(F.avg("dedup_ratio"))
    return wide.select("name", *[F.col(f"`fixed-{s}`").alias(f"fixed_{s}") for s in _SIZES])


@query("verify", "SELECT count(*)::BIGINT AS files, 0::BIGINT AS mismatches FROM documents")
def verify(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    cut = chunk(files, fixed(1024), with_data=True)
    bad = store.verify(files, store.reassemble(store.retrieve(store.recipes(cut.drop("data")), store.first_payloads(cut))))
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(bad.agg(F.count(F.lit(1)).alias("mismatches")))
