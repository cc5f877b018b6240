"""Generic file read and write by format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

READ_FORMATS = ("csv", "parquet", "json", "orc", "text")
WRITE_FORMATS = ("csv", "parquet", "json", "orc")


def read(spark: SparkSession, file_format: str, path: str | list[str],
         schema: T.StructType | str | None = None,
         process_result: Callable[[DataFrame], DataFrame] | None = None,
         **options) -> DataFrame:
    """S1 + S2: read ``path`` in ``file_format``; unknown formats raise.
    ``process_result`` is the post-read hook (identity by default)."""
    if file_format not in READ_FORMATS:
        raise NotImplementedError(f"Reading from format {file_format} not implemented.")
    reader = spark.read.format(file_format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return process_result(df) if process_result else df


def write(df: DataFrame, file_format: str, path: str, mode: str = "overwrite",
          partition_by: list[str] | None = None, **options) -> None:
    """Write ``df`` in ``file_format`` (pickle is not offered)."""
    if file_format not in WRITE_FORMATS:
        raise NotImplementedError(f"Writing to format {file_format} not implemented.")
    writer = df.write.format(file_format).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
