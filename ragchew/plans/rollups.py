"""A6, A8, A10-A13 from rollups: partial states by minute, kept per log or day and replaced with it.

A rollup row holds what the analyses need of the rows of one minute: counts, sums (for means), and for running
totals the last value with its ``seq``. States of any number of minutes merge (sums add, of the last values the one with the
greatest ``seq`` stays), so every bin width in whole minutes follows from them. The rollups are a table of units
(``sources/units.py``) beside the store: a log or day that is loaded again replaces its states, and no other row is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragchew.constants import EVOLUTION_FEATURES, LOG_KEY
from ragchew.functions.timecols import dummy_clock, minute_bin
from ragchew.operators.timing import add_bin, add_contest_hour
from ragchew.plans import spots as spot_plans
from ragchew.plans.activity import LOG, with_label
from ragchew.sources import units

SPOT_GROUP = ["contest", "contest_mode", "year", "dx", "band", "de_cont", "dx_cont"]
SPOT_COUNTS, SPOT_MEANS = ["freq"], ["db", "speed"]
LOG_SUMS = ["qso_points", "is_valid"]
LAST = sorted(c for c, how in EVOLUTION_FEATURES.values() if how == "last")
MEAN = sorted(c for c, how in EVOLUTION_FEATURES.values() if how == "mean")


def spot_rollup(spots: DataFrame) -> DataFrame:
    """States of cleaned spots by minute, station, band and continents. Spots without a time have none."""
    timed = spots.where(F.col("datetime").isNotNull())
    return timed.groupBy(*SPOT_GROUP, minute_bin("datetime", 1).alias("datetime")).agg(
        *[F.count(c).alias(f"n_{c}") for c in [*SPOT_COUNTS, *SPOT_MEANS]], *[F.sum(c).alias(f"sum_{c}") for c in SPOT_MEANS])


def log_rollup(scored: DataFrame) -> DataFrame:
    """States of scored contacts by log and minute."""
    def last(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("value")))).alias(f"last_{c}")

    return scored.groupBy(*LOG_KEY, minute_bin("datetime", 1).alias("datetime")).agg(
        F.min("hour").alias("hour"), F.count(F.lit(1)).alias("sum_qsos"), *[F.sum(F.col(c).cast("long")).alias(f"sum_{c}") for c in LOG_SUMS],
        *[last(c) for c in LAST], *[F.sum(c).alias(f"sum_{c}") for c in MEAN], *[F.count(c).alias(f"n_{c}") for c in MEAN])


def put_spots(spots: DataFrame, root: str) -> None:
    """Keep the states of these days, instead of those kept of the same days."""
    units.put(spot_rollup(spots), root, {"__day": F.to_date("datetime")})


def put_logs(scored: DataFrame, root: str) -> None:
    """Keep the states of these logs, instead of those kept of the same logs."""
    units.put(log_rollup(scored), root, {"__station": F.col("mycall")})


def load(spark: SparkSession, root: str, **where) -> DataFrame:
    """The kept states, of partitions with the values ``where``."""
    return units.load(spark, root, where)


def rate(rolled: DataFrame, time_bin_size: int = 60, target: str = "qsos") -> DataFrame:
    """Sum of ``target`` (``qsos``, or one of ``LOG_SUMS``) per dummy-clock bin and label."""
    df = add_bin(with_label(rolled), "dummy_datetime", dummy_clock("hour"), time_bin_size, LOG)
    return df.groupBy(*LOG, "callsign_year", "dummy_datetime").agg(F.sum(f"sum_{target}").alias(f"{target}_sum"))


def contest_evolution(rolled: DataFrame, feature: str, time_bin_size: int = 1,
                      hour_scope: list[str] | None = None) -> DataFrame:
    """One score feature per (label, dummy-clock bin)."""
    if feature not in EVOLUTION_FEATURES:
        raise ValueError(f"Feature to plot not known: {feature}")
    column, how = EVOLUTION_FEATURES[feature]
    df = add_contest_hour(rolled, hour_scope or [*LOG, "year"])
    df = add_bin(with_label(df), "dummy_datetime", dummy_clock("hour"), time_bin_size, LOG)
    merged = (F.max(f"last_{column}")["value"] if how == "last"
              else F.try_divide(F.sum(f"sum_{column}"), F.sum(f"n_{column}")))
    return df.groupBy(*LOG, "callsign_year", "dummy_datetime").agg(merged.alias(column))


# A10-A13 read a rollup like spots: their counts and means merge the states.
band_conditions = spot_plans.band_conditions
cw_speed = spot_plans.cw_speed
spot_counts = spot_plans.spot_counts
snr_mean = spot_plans.snr_mean
