import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quernstone.constants import MB
from quernstone.errors import AlreadyExists, InvalidInput, NotFound, PermissionDenied
from quernstone.functions.kernels import Sizes
from quernstone.operators import store
from quernstone.operators.chunkers import cdc, chunk, fixed, register
from quernstone.operators.filesystem import FileStore, ScrubMeasurements, WriteMeasurements

FIXED = fixed(4096)


@pytest.fixture
def fs(spark, tmp_path):
    return FileStore(spark, str(tmp_path / "s"))


def write(fs, name, *parts, chunker=FIXED):
    h = fs.create_file(name, chunker)
    for p in parts:
        fs.write(h, p)
    return h


def test_two_writes_read_back(fs):
    h = write(fs, "f", b"\x01" * MB, b"\x01" * MB, chunker=cdc("leap"))
    assert fs.read_complete(h) == b"\x01" * (2 * MB)


def test_segmented_reads(fs):
    parts = [b"\x01" * MB, b"\x02" * MB, b"\x03" * MB, b"\x03" * 50]
    write(fs, "f", *parts)
    h = fs.open_file("f", FIXED)
    got = [fs.read(h) for _ in range(5)]
    assert b"".join(got) == b"".join(parts) and got[4] == b"" and [len(g) for g in got] == [MB, MB, MB, 50, 0]


def test_small_big_and_empty_files(fs):
    for name, data in (("tiny", b"\x01" * 10), ("big", b"\x01" * (3 * MB + 50)), ("none", b"")):
        write(fs, name, data)
        assert fs.read_complete(fs.open_readonly(name)) == data
    assert fs.list_files() == ["big", "none", "tiny"] and fs.file_exists("tiny") and not fs.file_exists("x")


def test_ratios_by_writes(fs):
    h = write(fs, "f", b"\x0a" * MB)
    assert fs.metrics()["cdc_dedup_ratio"] == 256 and fs.metrics()["total_cdc_size"] == 4096
    fs.write(h, b"\x0a" * MB)
    assert fs.metrics()["cdc_dedup_ratio"] == 512
    fs.write(h, b"\x14" * MB)
    m = fs.metrics()
    assert m["cdc_dedup_ratio"] == 384 and m["full_cdc_dedup_ratio"] == 3 * MB / (8192 + 64)
    assert fs.average_chunk_size() == 4096 and fs.size_written() == 3 * MB
    assert fs.size_distribution(1000).collect() == [(4000, 2)]


def test_late_reader_and_reopened_writer(fs):
    h = write(fs, "f")
    reader = fs.open_readonly("f")
    fs.write(h, b"\x01" * MB)
    assert fs.read_complete(reader) == b"\x01" * MB
    again = fs.open_file("f", FIXED)
    fs.write(again, b"\x02" * 5000)
    assert fs.read_complete(reader) == b"\x01" * MB + b"\x02" * 5000


def test_errors(fs, tmp_path):
    h = write(fs, "f", b"abc")
    ro = fs.open_readonly("f")
    with pytest.raises(PermissionDenied):
        fs.write(ro, b"x")
    assert fs.close(ro) == WriteMeasurements()
    with pytest.raises(AlreadyExists):
        fs.create_file("f", FIXED, overwrite=False)
    for bad in (lambda: fs.open_file("g", FIXED), lambda: fs.open_readonly("g")):
        with pytest.raises(NotFound):
            bad()
    with pytest.raises(InvalidInput):
        fs.scrub()
    fs.create_file("f", FIXED)
    assert fs.read_complete(h) == b"" and fs.size_written() == 3
    fs.write(fs.open_file("f", FIXED), b"abcd")
    fs.write_to_disk("f", str(tmp_path / "out"))
    assert (tmp_path / "out").read_bytes() == b"abcd"
    with pytest.raises(AlreadyExists):
        fs.write_to_disk("f", str(tmp_path / "out"))
    fs.files.pop("f")
    with pytest.raises(NotFound):
        fs.write(ro, b"x")


def test_empty_store(fs):
    m = fs.metrics()
    assert m["chunk_count"] == 0 and m["cdc_dedup_ratio"] != m["cdc_dedup_ratio"]
    with pytest.raises(InvalidInput):
        fs.average_chunk_size()
    with pytest.raises(InvalidInput):
        fs.size_distribution(0)


def test_many_chunkers_one_store_and_streams(fs, spark, tmp_path):
    write(fs, "a", b"\x00" * MB, chunker=cdc("super"))
    write(fs, "b", b"\x00" * MB, chunker=cdc("leap"))
    assert [len(fs.read_complete(fs.open_readonly(n))) for n in "ab"] == [MB, MB]
    data = spark.createDataFrame([("x", 0, bytearray(b"one")), ("x", 1, bytearray(b"two"))], "file_name string, write_seq long, bytes binary")
    write(fs, "c", data)
    assert fs.read_complete(fs.open_readonly("c")) == b"onetwo"
    again = FileStore(spark, fs.path)
    assert again.list_files() == ["a", "b", "c"] and again.read_complete(again.open_readonly("c")) == b"onetwo"


def test_scrub(spark, tmp_path):
    fs = FileStore(spark, str(tmp_path / "s"), scrubber=store.scrub_copy)
    data = bytes(range(256)) * 64 + b"tail"
    h = write(fs, "f", data)
    m = fs.scrub()
    assert (m.processed_data, m.data_left) == (4096 + 4, 0)
    assert fs.read_complete(h) == data
    after = fs.metrics()
    assert after["cdc_dedup_ratio"] == float("inf") and after["total_size"] == 4100
    with pytest.raises(InvalidInput):
        fs.size_distribution(100)
    assert fs.scrub().processed_data == 0 and fs.read_complete(h) == data
    fs.clear_database()
    assert fs.metrics()["total_size"] == 4100 and fs.list_files() == []
    fs.clear()
    assert fs.metrics()["total_size"] == 0
    same = FileStore(spark, str(tmp_path / "t"), scrubber=store.scrub_nothing).scrub()
    assert (same.processed_data, same.data_left) == (ScrubMeasurements().processed_data, 0)


def test_new_file_of_a_wanted_ratio(fs):
    data = b"".join(hashlib.sha256(bytes([k, k >> 8])).digest() * 128 for k in range(101))
    h = write(fs, "f", data)
    name = fs.to_dedup_ratio(h, 4.0)
    assert name == "f.4.00" and fs.size_written() == len(data)
    # 100 distinct spans without the last: 25 of them 16 times, 75 once.
    out = fs.read_complete(fs.open_readonly(name))
    assert len(out) == (400 + 75) * 4096 and out[: 25 * 4096] == data[: 25 * 4096] and out[25 * 4096 : 50 * 4096] == data[: 25 * 4096] and out[400 * 4096 :] == data[25 * 4096 : 100 * 4096]
    with pytest.raises(InvalidInput):
        fs.to_dedup_ratio(h, 0.5)
    counts = {r.n for r in fs.chunk_count_distribution(fs.open_readonly(name)).collect()}
    assert counts == {16, 1}


def test_retrieve_reports_missing_chunks(spark):
    files = spark.createDataFrame([("f", 0, bytearray(b"abcdef"))], "file_name string, write_seq long, bytes binary")
    spans = store.recipes(chunk(files, fixed(3)))
    none = spark.createDataFrame([], "hash binary, data binary")
    assert store.missing(spans, none).count() == 2
    with pytest.raises(Exception, match="missing chunk"):
        store.retrieve(spans, none).collect()


def test_a_chunker_and_a_hasher_of_the_user(spark):
    from quernstone.functions.hashing import hasher, register as register_hash

    register("sevens", lambda b, s: [*range(7, len(b), 7), len(b)])
    register_hash("crc", lambda c: F.unhex(F.lpad(F.hex(F.crc32(c)), 16, "0")), 8)
    files = spark.createDataFrame([("f", 0, bytearray(b"x" * 20))], "file_name string, write_seq long, bytes binary")
    got = chunk(files, cdc("sevens", Sizes(1, 7, 7)), "crc").orderBy("idx").collect()
    assert [(r.offset, r.len) for r in got] == [(0, 7), (7, 7), (14, 6)] and got[0].hash == got[1].hash != got[2].hash
    sha3 = chunk(files, fixed(20), "sha3-256").first().hash
    assert bytes(sha3) == hashlib.sha3_256(b"x" * 20).digest()
    with pytest.raises(InvalidInput):
        hasher("none")
    with pytest.raises(InvalidInput):
        cdc("none")


def test_running_sums_over_buckets(spark):
    from quernstone.operators.ordered import running

    df = spark.range(1000).select((F.col("id") * 3).alias("g"), (F.col("id") % 7).alias("v")).repartition(5)
    got = running(df, "g", ["g"], {"upto": "v"}, place="n", width=64).orderBy("g").collect()
    total = 0
    for k, r in enumerate(got):
        total += k % 7
        assert (r.g, r.upto, r.n) == (3 * k, total, k + 1)


def test_distribution_round_trip(spark, tmp_path):
    from quernstone.operators.report import save_distribution
    from quernstone.sources.readers import distribution

    df = spark.createDataFrame([(100, 2), (0, 5)], "bucket long, n long")
    path = save_distribution(str(tmp_path), "d", "FastCDC (2020), sizes: 1", 100, df)
    assert path.endswith("distribution-d-FastCDC (2020)-100.json") and json.load(open(path)) == [[0, 5], [100, 2]]
    assert sorted(map(tuple, distribution(spark, path).collect())) == [(0, 5), (100, 2)]


def test_reopened_store_is_the_same(spark, tmp_path):
    path = str(tmp_path / "s")
    fs = FileStore(spark, path)
    write(fs, "empty")
    write(fs, "replaced", b"old content")
    fs.create_file("replaced", FIXED)
    h = write(fs, "kept", b"one")
    three = spark.createDataFrame([("x", k, bytearray(d)) for k, d in enumerate([b"two", b"", b""])], "file_name string, write_seq long, bytes binary")
    fs.write(h, three)
    name = fs.to_dedup_ratio(h, 1.0)
    again = FileStore(spark, path)
    assert again.list_files() == fs.list_files() == ["empty", "kept", name, "replaced"]
    assert (again.writes, again.steps, again.generations, again.files) == (fs.writes, fs.steps, fs.generations, fs.files) and again.writes == 5
    assert [again.read_complete(again.open_readonly(n)) for n in ("empty", "replaced", "kept")] == [b"", b"", b"onetwo"]
    again.write(again.open_file("empty", FIXED), b"now full")
    assert again.spans("empty").select("write_seq").collect() == [(5,)]
    last = FileStore(spark, path)
    assert last.read_complete(last.open_readonly("empty")) == b"now full" and last.size_written() == 25


def test_a_step_that_fails_half_way_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    fs = FileStore(spark, path)
    h = write(fs, "f", b"begin")

    def lost(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(fs, "_commit", lost)
        with pytest.raises(OSError):
            fs.write(h, b" lost")
    for s in (fs, FileStore(spark, path)):
        assert s.read_complete(s.open_readonly("f")) == b"begin" and s.size_written() == 5
    again = FileStore(spark, path)
    again.write(again.open_file("f", FIXED), b" lost")
    assert again.read_complete(again.open_readonly("f")) == b"begin lost" and again.metrics()["chunk_count"] == 2


def test_a_table_of_many_writes_under_one_name(spark, tmp_path):
    fs = FileStore(spark, str(tmp_path / "s"))
    n = 200_000
    rows = spark.range(n).select(F.lit("x").alias("file_name"), F.col("id").alias("write_seq"), F.concat(F.lit("row "), F.col("id") % 1000).cast("binary").alias("bytes"))
    h = write(fs, "big", rows)
    assert fs.metrics()["chunk_count"] == 1000 and fs.files["big"].spans == n
    assert store.verify_writes(rows.withColumn("file_name", F.lit("big")), fs.payloads()).isEmpty()
    at = fs.spans("big").agg(F.count_distinct("span_idx"), F.max("span_idx"), F.max(F.col("offset") + F.col("len"))).first()
    assert tuple(at) == (n, n - 1, fs.files["big"].size)
    handle = fs.open_readonly("big")
    handle.offset = fs.spans("big").filter("span_idx = 150000").first().offset
    assert fs.read(handle, 20) == b"row 0row 1row 2row 3"
    assert h.measurements.chunk_time > 0


def test_writes_that_differ_are_named(spark):
    files = spark.createDataFrame([("f", 0, bytearray(b"abc")), ("f", 1, bytearray(b"")), ("g", 0, bytearray(b"xyz"))], "file_name string, write_seq long, bytes binary")
    cut = chunk(files, fixed(2), with_data=True)
    spans = store.recipes(cut.drop("data"))
    good = store.retrieve(spans, store.first_payloads(cut))
    assert store.verify_writes(files, good).isEmpty()
    bad = good.filter("file_name <> 'g'")
    assert [tuple(r) for r in store.verify_writes(files, bad).collect()] == [("g", 0)]
    assert [tuple(r) for r in store.verify_writes(files.filter("file_name = 'f'"), good).collect()] == [("g", 0)]


def test_files_in_pieces(spark, tmp_path):
    import numpy as np

    from quernstone.operators.chunkers import chunk_pieces
    from quernstone.sources import readers

    folder = tmp_path / "in"
    folder.mkdir()
    rng = np.random.default_rng(3)
    made = {"a.bin": rng.integers(0, 4, 300_000, dtype=np.uint8).tobytes(), "b.bin": rng.integers(0, 256, 100_001, dtype=np.uint8).tobytes(), "none.bin": b""}
    for name, data in made.items():
        (folder / name).write_bytes(data)
    pieces = readers.pieces(spark, str(folder), 10_000)
    assert {(r.file_name, r.n) for r in pieces.groupBy("file_name").agg(F.count("*").alias("n")).collect()} == {("a.bin", 30), ("b.bin", 11)}
    whole = readers.files(spark, str(folder))
    for c in (fixed(777), *(cdc(k, Sizes(128, 512, 4096)) for k in ("fast", "rabin", "leap", "ultra", "super", "seq", "seq-decreasing"))):
        got = sorted((r.file_name, r.idx, r.offset, r.len, bytes(r.hash)) for r in chunk_pieces(pieces, c).drop("data").collect())
        assert got == sorted((r.file_name, r.idx, r.offset, r.len, bytes(r.hash)) for r in chunk(whole, c).collect()), c.kind
    fs = FileStore(spark, str(tmp_path / "s"))
    h = fs.create_file("f", cdc("fast", Sizes(128, 512, 4096)))
    fs.write_pieces(h, pieces.filter("file_name = 'a.bin'"))
    fs.write(h, b"tail")
    assert fs.read_complete(h) == made["a.bin"] + b"tail" and fs.size_written() == 300_004
