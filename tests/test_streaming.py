from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickweave.operators import model
from tickweave.sources.store import Store
from tickweave.streaming.ingest import windowed, write_stream


def test_micro_batches_reach_the_store(spark, tmp_path):
    rows = [("S", "v", datetime(2024, 1, 1) + timedelta(seconds=s), s, None, float(s), None, None, None) for s in range(10)]
    spark.createDataFrame(rows, model.TALL_SCHEMA).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(model.TALL_SCHEMA).parquet(str(tmp_path / "in"))
    write_stream(stream, store, str(tmp_path / "check"), available_now=True).awaitTermination(60)
    assert store.scan("S").count() == 10


def test_a_batch_is_committed_once(spark, tmp_path):
    """A named segment that is in the catalog is left alone; one that was written but not published is written anew."""
    rows = spark.createDataFrame([("S", "v", datetime(2024, 1, 1) + timedelta(seconds=s), s, None, float(s), None, None, None) for s in range(10)], model.TALL_SCHEMA)
    store = Store(spark, str(tmp_path / "store"))
    rows.write.parquet(str(tmp_path / "store" / "data" / "segment_id=stream-x-0"))
    for _ in range(2):
        store.append(rows, "stream-x-0")
    assert [r["n_rows"] for r in store.catalog().collect()] == [10] and store.version() == 1
    assert store.scan("S").count() == 10


def test_windows(spark):
    df = spark.range(120).select(F.lit("a").alias("k"), F.timestamp_add("SECOND", F.col("id"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")).alias("ts"), F.col("id").cast("double").alias("v"))
    got = windowed(df, ["k"], "ts", "v", "1 minute", "10 seconds").orderBy("start").collect()
    assert [(r["n"], r["low"], r["high"]) for r in got] == [(60, 0.0, 59.0), (60, 60.0, 119.0)]
