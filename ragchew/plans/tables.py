"""Contest summary and contest-log tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragchew.constants import BANDS
from ragchew.operators.rolling import rolling_sums

_KEY = ["contest", "contest_mode", "year", "mycall"]


def contest_summary(scored: DataFrame, contest: str) -> DataFrame:
    """Per (log, band) and per log: valid QSOs, multipliers, points; the score
    only on the total row (band null). Known bands and totals are kept; the
    total still counts out-of-band contacts."""
    if contest == "cqww":
        aggs = [F.sum(F.col("is_valid").cast("long")).alias("qsos"),
                F.sum(F.col("is_zone").cast("long")).alias("zones"),
                F.sum(F.col("is_dxcc").cast("long")).alias("dxcc"),
                F.sum(F.col("qso_points").cast("long")).alias("qso_points")]
        mult = F.col("zones") + F.col("dxcc")
    else:
        aggs = [F.sum(F.col("is_valid").cast("long")).alias("qsos"),
                F.sum(F.col("is_mult").cast("long")).alias("is_mult"),
                F.sum(F.col("qso_points").cast("long")).alias("qso_points")]
        mult = F.col("is_mult")
    grouped = scored.groupingSets([[*_KEY, "band"], _KEY], *_KEY, "band").agg(
        *aggs, F.grouping("band").alias("__total"))
    out = grouped.withColumn(
        "score", F.when(F.col("__total") == 1, F.col("qso_points") * mult))
    out = out.where(F.col("band").isin(BANDS) | (F.col("__total") == 1))
    return out.drop("__total")


LOG_TABLE_COLUMNS = {
    "cqww": ["datetime", "frequency", "band", "mode", "call", "zone", "country", "mycall",
             "year", "is_zone", "is_dxcc", "rate_10", "rate_30", "rate_60"],
    "cqwpx": ["datetime", "frequency", "band", "mode", "call", "myserial", "serial", "country",
              "mycall", "year", "prefix", "is_mult", "rate_10", "rate_30", "rate_60"],
    "iaru": ["datetime", "frequency", "band", "mode", "call", "exchange", "country", "mycall",
             "year", "is_mult", "rate_10", "rate_30", "rate_60"],
}


def contest_log(scored: DataFrame, contest: str) -> DataFrame:
    """The log table: contract columns plus valid QSOs in the last 10/30/60
    minutes of each row (row-wise rolling sums)."""
    out = rolling_sums(scored, F.col("is_valid").cast("long"),
                       {"rate_10": 10, "rate_30": 30, "rate_60": 60})
    return out.select(*LOG_TABLE_COLUMNS[contest])


# Column specs of the tables: id -> type (numeric, text, datetime).
COLUMN_TYPES = {
    "datetime": "datetime", "frequency": "numeric", "band": "numeric", "mode": "text",
    "call": "text", "zone": "numeric", "country": "text", "mycall": "text", "year": "numeric",
    "is_zone": "numeric", "is_dxcc": "numeric", "is_mult": "numeric", "myserial": "numeric",
    "serial": "numeric", "prefix": "text", "exchange": "text", "rate_10": "numeric",
    "rate_30": "numeric", "rate_60": "numeric", "qsos": "numeric", "zones": "numeric",
    "dxcc": "numeric", "qso_points": "numeric", "score": "numeric",
}
_KINDS = {
    "numeric": ("byte", "short", "integer", "long", "float", "double", "decimal", "boolean"),
    "text": ("string",),
    "datetime": ("timestamp", "timestamp_ntz", "date"),
}


def check_columns(df: DataFrame, ids: list[str]) -> DataFrame:
    """Every id present with a type of its kind; returns ``df``."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    for c in ids:
        if c not in types:
            raise ValueError(f"column {c} missing")
        kind = COLUMN_TYPES.get(c)
        if kind and not types[c].startswith(_KINDS[kind]):
            raise TypeError(f"column {c} is {types[c]}, expected {kind}")
    return df


def page_after(df: DataFrame, order_by: list[str], last: dict | None = None,
               page_size: int = 250) -> DataFrame:
    """O3 without an offset: the page that follows the row with the values ``last``
    in ``order_by`` (None: the first page). ``order_by`` must tell all rows
    apart. The rows up to ``last`` are filtered in the scan, and each task
    keeps no more than a page, however far the reader has come."""
    if last is not None:
        follows = F.lit(False)
        for c in reversed(order_by):  # nulls come first
            col, value = F.col(c), last[c]
            beyond = col.isNotNull() if value is None else F.coalesce(col > F.lit(value), F.lit(False))
            follows = beyond | (col.eqNullSafe(F.lit(value)) & follows)
        df = df.where(follows)
    return df.orderBy(*order_by).limit(page_size)


def page(df: DataFrame, order_by: list[str], page_number: int = 0, page_size: int = 250) -> DataFrame:
    """O3: one page of a table in a fixed order (the log table uses 25). An offset
    passes all earlier pages through one task: for the first pages of a table;
    ``page_after`` goes on from any row, and ``write_pages`` serves far pages."""
    return df.orderBy(*order_by).offset(page_number * page_size).limit(page_size)


# O3 far pages -------------------------------------------------------------------

PART, NTH = "__part", "__nth"


def write_pages(df: DataFrame, order_by: list[str], path: str) -> None:
    """O3: the table in a total order, for pages anywhere in it: range-partitioned, sorted parts with numbered rows, and a
    directory of one row per part (rows before it, rows in it). Rows equal in ``order_by`` keep the
    order they were written in."""
    spark = df.sparkSession
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the part
    parts = df.orderBy(*order_by).withColumns({PART: F.spark_partition_id(), NTH: number})
    parts.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    written = spark.read.schema(parts.schema).parquet(f"{path}/rows")
    sizes = written.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"))
    # a row of its own keeps the columns, also of an empty table
    sizes = sizes.withColumn("columns", F.lit(None).cast("string")).unionByName(
        spark.createDataFrame([(-1, 0, parts.schema.json())], f"{PART} int, rows long, columns string"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, page_number: int, page_size: int = 250) -> DataFrame:
    """Page ``page_number`` (from 0) of a table of ``write_pages``: the directory names the parts that hold it, and of those
    only the rows with its numbers are read."""
    first = page_number * page_size
    directory = spark.read.parquet(f"{path}/directory")
    parts = directory.where(
        (F.col("before") < first + page_size) & (F.col("before") + F.col("rows") > first)).collect()
    columns = directory.where(F.col("columns").isNotNull()).first()["columns"]
    rows = spark.read.schema(T.StructType.fromJson(json.loads(columns))).parquet(f"{path}/rows")
    wanted = F.lit(False)
    for p in parts:  # as many as a page spans
        wanted = wanted | ((F.col(PART) == p[PART]) & F.col(NTH).between(first - p["before"], first + page_size - 1 - p["before"]))
    return rows.where(wanted).orderBy(PART, NTH).drop(PART, NTH)
