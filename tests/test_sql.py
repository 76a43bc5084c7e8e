from quernstone.functions import sql
from quernstone.functions.kernels import Sizes, chunk


def test_table_function_in_sql(spark):
    sql.register(spark)
    texts = {1: "some words and more " * 60, 2: "", 3: None}
    spark.createDataFrame(list(texts.items()), "id long, t string").createOrReplaceTempView("udtf_texts")
    got = spark.sql("SELECT d.id, c.idx, c.offset, c.len FROM udtf_texts d, LATERAL cdc_chunks(encode(d.t, 'utf-8'), 'fast', 64, 128, 512) c").collect()
    want = [(1, k, o, n) for k, (o, n) in enumerate(chunk(texts[1].encode(), "fast", Sizes(64, 128, 512)))]
    assert sorted(map(tuple, got)) == want
