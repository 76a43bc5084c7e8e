from quernstone.llm.shared import Work

ARROW, READER = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


def test_few_whole_texts_are_held_at_once(spark):
    kept = {k: spark.conf.get(k) for k in (ARROW, READER)}
    try:
        for k in kept:
            spark.conf.unset(k)
        work = Work(spark, "shared-test")
        assert int(spark.conf.get(ARROW)) <= 1000 and int(spark.conf.get(READER)) <= 1000
        texts = [(i, f"{i} " * 500) for i in range(2000)]
        df = work.save(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "texts")
        rows = df.mapInArrow(lambda batches: (b for b in batches), df.schema)
        assert sorted(map(tuple, rows.collect())) == texts  # several batches of either kind
        spark.conf.set(ARROW, "77")
        spark.conf.set(READER, "99")
        Work(spark, "shared-test")
        assert (spark.conf.get(ARROW), spark.conf.get(READER)) == ("77", "99")
        work.drop("")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
