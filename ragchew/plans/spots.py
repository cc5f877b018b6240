"""Band conditions, CW speed, spot counts, mean SNR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragchew.constants import BANDS, DEFAULT_RX_CONTINENTS
from ragchew.functions.timecols import dummy_clock, label_col
from ragchew.operators.timing import add_bin, add_contest_hour

KEY = ["contest", "contest_mode"]


def _count(df: DataFrame, column: str) -> Column:
    """Spots with a value of ``column``: counted, or merged from the states of a rollup (``plans/rollups.py``)."""
    return F.sum(f"n_{column}") if f"n_{column}" in df.columns else F.count(column)


def _mean(df: DataFrame, column: str) -> Column:
    """Mean of ``column``: averaged, or merged from the states of a rollup."""
    return F.try_divide(F.sum(f"sum_{column}"), F.sum(f"n_{column}")) if f"n_{column}" in df.columns else F.avg(column)


def select_stations(spots: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Keep the asked (dx, year) pairs (a semi join; pairs deduplicated)."""
    if pairs is None:
        return spots
    return spots.join(pairs.select("dx", "year").distinct(), ["dx", "year"], "left_semi")


def band_conditions(spots: DataFrame, reference: str, time_bin_size: int = 60,
                    continents: list[str] | None = None) -> DataFrame:
    """A10: spots between ``reference`` and each other continent per band and
    time bin, and their percent of that (band, continent, year) total."""
    conts = continents or DEFAULT_RX_CONTINENTS
    df = spots.where((F.col("dx_cont") == reference) | (F.col("de_cont") == reference))
    df = df.where(F.col("band").isin(BANDS))
    df = df.withColumn("continent", F.when(F.col("dx_cont") == reference, F.col("de_cont"))
                       .otherwise(F.col("dx_cont")))
    df = df.where(F.col("continent").isin(conts))
    df = add_bin(df, "__bin", "datetime", time_bin_size, KEY).drop("datetime") \
        .withColumnRenamed("__bin", "datetime")
    grp = df.groupBy(*KEY, "continent", "band", "year", "datetime").agg(
        _count(df, "freq").alias("numerator"))
    w = Window.partitionBy(*KEY, "band", "continent", "year")
    grp = grp.withColumn("denominator", F.sum("numerator").over(w))
    return grp.withColumn("percent", F.try_divide(F.lit(100.0) * F.col("numerator"), F.col("denominator")))


def _per_station(spots: DataFrame, pairs, time_bin_size, hour_scope, rx_continents=None):
    df = select_stations(spots, pairs)
    df = add_contest_hour(df, hour_scope or [*KEY, "year"])
    if rx_continents:
        df = df.where(F.col("de_cont").isin(rx_continents))
    df = df.withColumn("callsign_year", label_col("dx", "year"))
    return add_bin(df, "dummy_datetime", dummy_clock("hour"), time_bin_size, KEY)


def cw_speed(spots: DataFrame, pairs: DataFrame | None = None, time_bin_size: int = 60,
             hour_scope: list[str] | None = None) -> DataFrame:
    """Mean sending speed per (station label, band, dummy-clock bin)."""
    df = _per_station(spots, pairs, time_bin_size, hour_scope)
    return df.groupBy(*KEY, "callsign_year", "band", "dummy_datetime").agg(
        _mean(df, "speed").alias("speed"))


def spot_counts(spots: DataFrame, pairs: DataFrame | None = None, time_bin_size: int = 60,
                rx_continents: list[str] | None = None,
                hour_scope: list[str] | None = None) -> DataFrame:
    """Number of spots (non-null ``db``) per label, band and bin, heard
    by receivers on the given continents."""
    conts = rx_continents or DEFAULT_RX_CONTINENTS
    df = _per_station(spots, pairs, time_bin_size, hour_scope, conts)
    return df.groupBy(*KEY, "callsign_year", "band", "dummy_datetime").agg(
        _count(df, "db").alias("counts"))


def snr_mean(spots: DataFrame, pairs: DataFrame | None = None, time_bin_size: int = 60,
             rx_continents: list[str] | None = None,
             hour_scope: list[str] | None = None) -> DataFrame:
    """Mean signal-to-noise per label, band and bin."""
    conts = rx_continents or DEFAULT_RX_CONTINENTS
    df = _per_station(spots, pairs, time_bin_size, hour_scope, conts)
    return df.groupBy(*KEY, "callsign_year", "band", "dummy_datetime").agg(
        _mean(df, "db").alias("db"))
