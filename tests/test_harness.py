import pytest
from pyspark.sql import functions as F

from quernstone import cli
from quernstone.errors import InvalidInput, NotFound
from quernstone.functions.kernels import Sizes
from quernstone.operators import report, store
from quernstone.operators.chunkers import cdc, fixed, from_options
from quernstone.operators.filesystem import FileStore
from quernstone.operators.harness import Dataset, Fixture, TableDataset, measure_datasets
from quernstone.sources import generators, readers
from quernstone.streaming import ingest


def test_measurements_and_reports(spark, tmp_path):
    (tmp_path / "d").write_bytes(b"\x01" * 100_000 + b"\x02" * 100_000)
    d = Dataset(spark, str(tmp_path / "d"))
    assert d.size == 200_000
    f = Fixture(FileStore(spark, str(tmp_path / "s")))
    repeated = f.measure_repeated(d, fixed(1000), 2)
    assert [m.dedup_ratio for m in repeated] == [100.0, 200.0]
    assert [m.dedup_ratio for m in f.measure_multi(d, fixed(1000), 2)] == [100.0, 100.0]
    assert f.dedup_ratio(d, fixed(500)) == 200.0
    table = TableDataset(store.files_of(spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string"), "id", "t").withColumn("write_seq", F.col("file_name").cast("long")), "table")
    out = measure_datasets(f, [d, table], [fixed(1000), cdc("fast", Sizes(64, 128, 512))], str(tmp_path))
    assert len(out) == 4 and len(list(tmp_path.glob("distribution-*.json"))) == 12
    back = readers.report(spark, str(tmp_path / "report.csv"))
    assert back.count() == 4 and {r.name for r in back.collect()} == {"d", "table"}
    wide = report.pivot(back, "dedup_ratio").orderBy("name").collect()
    assert wide[0]["Fixed size chunking"] == 100.0
    assert "write_time" in report.pivots(back) and "path" not in report.pivots(back)
    assert report.measurements(spark, out).select(report.title(F.lit("dedup_ratio")).alias("t")).first().t == "Dedup Ratio"
    assert out[0].throughput("write") == 0.0
    with pytest.raises(NotFound):
        Dataset(spark, str(tmp_path / "nothing"))


def test_generators(spark):
    df = generators.duplicated(spark, "g", 64, 50, block=1024).cache()
    assert df.agg(F.sum(F.octet_length("bytes"))).first()[0] == 64 << 10
    n = df.select("bytes").distinct().count()
    assert 20 < n < 46
    assert generators.duplicated(spark, "g", 8, 100, block=1024).select("bytes").distinct().count() == 1
    with pytest.raises(InvalidInput):
        generators.duplicated(spark, "g", 8, 101)
    low = generators.random_bytes(spark, "r", 2500, lambda g, n: g.integers(0, 3, n), block=1000).collect()
    assert sorted(len(r.bytes) for r in low) == [500, 1000, 1000] and max(max(r.bytes) for r in low) == 2


def test_command_line(spark, tmp_path):
    (tmp_path / "d").write_bytes(b"\x01" * 50_000)
    (tmp_path / "c.toml").write_text(f'[args]\nchunker = "fixed-size"\nmin = 1\navg = 1\nmax = 1\nreport-path = "{tmp_path}"\n[command.measure]\npath = "{tmp_path}/d"\ncount = 2\ncleanup = true\n')
    got = cli.run(cli.parser().parse_args(["run-config", str(tmp_path / "c.toml")]), spark)
    assert [m.dedup_ratio for m in got] == [50_000 / (1024 + 50_000 % 1024)] * 2
    assert (tmp_path / "report.csv").exists() and len(list(tmp_path.glob("distribution-*"))) == 2
    one = cli.run(cli.parser().parse_args(["dedup-ratio", str(tmp_path / "d"), "--chunker", "seq", "--seq-mode", "increasing", "--min", "1", "--avg", "2", "--max", "4"]), spark)
    assert one[0].dedup_ratio > 1
    with pytest.raises(InvalidInput):
        from_options("seq", 1, 2, 3)
    with pytest.raises(InvalidInput):
        cli.run(cli.parser().parse_args(["measure", "x", "--report-path", str(tmp_path / "no")]), spark)
    with pytest.raises(NotFound):
        readers.config(str(tmp_path / "none.toml"))


def test_stream_of_files(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    contents = {}
    for k in range(4):
        contents[f"f{k}"] = b"\x07" * 4000 + bytes([k]) * 1000
        (source / f"f{k}").write_bytes(contents[f"f{k}"])
        ingest.ingest(ingest.read_files(spark, str(source), 1), out, fixed(1000)).awaitTermination()
    chunks = ingest.chunks(spark, out)
    assert chunks.count() == chunks.select("hash").distinct().count() == 5
    spans = ingest.recipes(spark, out)
    back = {r.file_name: bytes(r.content) for r in store.reassemble(store.retrieve(spans, chunks)).collect()}
    assert back == contents


def test_event_windows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = ingest.dedup_over_time(stream).writeStream.outputMode("complete").format("memory").queryName("by_day").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("by_day")
    assert got.agg(F.sum("rows")).first()[0] == events.count()
