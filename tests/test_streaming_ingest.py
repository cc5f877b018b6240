"""Streaming spot ingest equals the batch ingest on the same day files."""

from pyspark.sql import functions as F

from ragchew import fixtures as fx
from ragchew.registry import _scratch
from ragchew.sources import spots as spot_src
from ragchew.streaming import stream_spot_ingest


def test_stream_equals_batch(spark, small_dir):
    raw = fx.raw_spots(spark, small_dir)
    src = _scratch(spark, "spot-days")
    # day files as they arrive: one CSV folder per day, with the file columns
    day = F.substring("date", 1, 10)
    (raw.withColumn("tx_mode", F.lit("CW")).withColumn("__day", day)
        .select("callsign", "de_pfx", "de_cont", "freq", "band", "dx", "dx_pfx", "dx_cont", "mode",
                "db", "date", "speed", "tx_mode", "__day")
        .write.partitionBy("__day").option("header", "true").csv(src))
    files = f"{src}/*"
    dim = fx.prefix_dimension(spark, small_dir)
    sink, ckpt = _scratch(spark, "spot-sink"), _scratch(spark, "spot-ckpt")
    q = stream_spot_ingest(spark, files, dim, "cqww", "cw", 2023, sink, ckpt)
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink).select(*spot_src.SPOT_COLUMNS)
    batch = spot_src.ingest_spots(spot_src.read_spot_files(spark, [files]), dim, "cqww", "cw",
                                  2023).select(*spot_src.SPOT_COLUMNS)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0
