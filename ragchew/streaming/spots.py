"""Spot day files picked up as they land (file source, exactly-once sink).

The batch spot ingest (continent fill J7 + cleaning P10) applied to each
micro-batch of new files; each batch is a batch job that writes one folder of the partitioned Parquet
store, named by the number of the batch, so a batch that runs again after a failure overwrites itself. The query's progress
lives in ``checkpoint`` (a shared folder), so a
restarted job continues where it stopped. No state is kept between batches:
every spot is cleaned on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragchew.sources.spots import RAW_SPOT_SCHEMA, ingest_spots
from ragchew.operators.lookup import prepare_prefixes


def stream_spot_ingest(spark: SparkSession, source_dir: str, prefixes: DataFrame, contest: str,
                       contest_mode: str, year: int, sink_path: str, checkpoint: str,
                       available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``."""
    dim = prepare_prefixes(prefixes)
    reader = spark.readStream.schema(RAW_SPOT_SCHEMA).option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(source_dir)

    def write(batch: DataFrame, number: int) -> None:
        cleaned = ingest_spots(batch, dim, contest, contest_mode, year)
        cleaned.write.mode("overwrite").partitionBy("contest", "contest_mode", "year").parquet(f"{sink_path}/batch={number}")

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
