"""Spot archives (one CSV per contest day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragchew.operators.lookup import fill_continents
from ragchew.sources.cabrillo import read_log_lines

RAW_SPOT_SCHEMA = T.StructType([
    T.StructField("callsign", T.StringType()),
    T.StructField("de_pfx", T.StringType()),
    T.StructField("de_cont", T.StringType()),
    T.StructField("freq", T.DoubleType()),
    T.StructField("band", T.StringType()),
    T.StructField("dx", T.StringType()),
    T.StructField("dx_pfx", T.StringType()),
    T.StructField("dx_cont", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("db", T.IntegerType()),
    T.StructField("date", T.StringType()),
    T.StructField("speed", T.IntegerType()),
    T.StructField("tx_mode", T.StringType()),
])

SPOT_COLUMNS = ["callsign", "freq", "band", "dx", "mode", "db", "speed", "de_cont", "dx_cont",
                "datetime"]


def read_spot_files(spark: SparkSession, paths: list[str], mode: str = "cw") -> DataFrame:
    """The day files of a contest, read as one DataFrame with a fixed
    schema (no inference). Phone contests have no spots: empty frame."""
    if mode.lower() == "ssb" or not paths:
        return spark.createDataFrame([], RAW_SPOT_SCHEMA)
    return (spark.read.schema(RAW_SPOT_SCHEMA).option("header", "true")
            .option("mode", "PERMISSIVE").csv(paths))


def read_spot_lines(spark: SparkSession, paths: list[str], mode: str = "cw") -> DataFrame:
    """S8 with rejects: the raw columns of every line of the day files with ``path``, ``line_no`` (1 is
    the heading), ``line``, and ``unreadable`` where a field is missing, too many or of another type.
    Headings and empty lines are left out."""
    record = T.StructType([*RAW_SPOT_SCHEMA.fields, T.StructField("unreadable", T.StringType())])
    if mode.lower() == "ssb" or not paths:
        return spark.createDataFrame([], T.StructType([
            T.StructField("path", T.StringType()), T.StructField("line_no", T.LongType()),
            T.StructField("line", T.StringType()), *record.fields]))
    parsed = F.from_csv("line", record.simpleString()[len("struct<"):-1].replace(":", " "),
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"})
    lines = read_log_lines(spark, paths, {"spot": parsed}).where((F.col("seq") > 1) & (F.trim("line") != ""))
    return lines.select("path", F.col("seq").alias("line_no"), "line", "spot.*")


def mark_rejects(raw: DataFrame) -> DataFrame:
    """P10 with reasons: ``raw`` (with ``unreadable``) and the first ``reason`` why a line is no spot, null for a spot."""
    metres = F.col("band").contains("m") & ~F.col("band").contains("cm")
    return raw.withColumn(
        "reason",
        F.when(F.col("unreadable").isNotNull(), "unreadable_record")
        .when(F.col("dx").isNull(), "no_station")
        .when(~F.coalesce(metres, F.lit(False)), "band_not_in_metres")
        .when(band_number().isNull(), "unreadable_band")
        .when(spot_time().isNull(), "unreadable_time")).drop("unreadable")


def band_number() -> Column:
    return F.replace(F.col("band"), F.lit("m"), F.lit("")).try_cast("int")


def spot_time() -> Column:
    return F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def clean_spots(raw: DataFrame) -> DataFrame:
    """P10: keep the spot columns, drop rows without ``dx``, keep bands given
    in metres (not centimetres) and make them integers, parse the time."""
    out = raw.where(F.col("dx").isNotNull())
    out = out.where(F.col("band").contains("m") & ~F.col("band").contains("cm"))
    out = out.withColumns({
        "band": band_number(),
        "datetime": spot_time(),
        "freq": F.col("freq").try_cast("double"),
        "db": F.col("db").try_cast("int"),
        "speed": F.col("speed").try_cast("int"),
    })
    return out.select(*SPOT_COLUMNS)


def ingest_spots(raw: DataFrame, prefixes: DataFrame, contest: str, contest_mode: str,
                 year: int) -> DataFrame:
    """Continents filled by prefix (J7), cleaned (P10), tagged with the
    contest key (ready for the store)."""
    filled = fill_continents(raw, prefixes)
    return clean_spots(filled).select(
        F.lit(contest).alias("contest"), F.lit(contest_mode).alias("contest_mode"),
        F.lit(int(year)).alias("year"), *SPOT_COLUMNS)
