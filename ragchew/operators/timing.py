"""P2 with a chosen scope, and helpers for time bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragchew.functions.timecols import contest_saturday, hours_between, minute_bin

# Scopes are made of these columns only: at most contests x modes x years
# groups (a few hundred), so the start times are always small to broadcast.
SCOPE_COLUMNS = ("contest", "contest_mode", "year")


def add_contest_hour(df: DataFrame, scope: list[str], ts: str = "datetime",
                     out: str = "hour") -> DataFrame:
    """Fractional hours since Saturday 00:00 of the week of the earliest
    contact in each ``scope`` group (e.g. per contest-year, or per contest to
    overlay years on one clock). The per-group minimum is a partial aggregate
    (one row per group) joined back on the group key."""
    if not scope or not set(scope) <= set(SCOPE_COLUMNS):
        raise ValueError(f"scope must be a non-empty subset of {SCOPE_COLUMNS}")
    starts = df.groupBy(*scope).agg(F.min(ts).alias("__first_ts"))
    # Scope keys are hot by nature (a shuffle join would send a whole
    # contest-year to one task) and few by construction: broadcast them.
    return (df.join(F.broadcast(starts), scope, "left")
              .withColumn(out, hours_between(ts, contest_saturday("__first_ts")))
              .drop("__first_ts"))


DAY_MINUTES = 24 * 60


def add_bin(df: DataFrame, out: str, ts: Column | str, minutes: int, scope: list[str]) -> DataFrame:
    """Start of the ``minutes``-wide bin of ``ts`` as column ``out``, bins
    counted from midnight of the first day of each ``scope`` group.

    If the width divides a day, every midnight starts a bin and the first
    one need not be looked up."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if DAY_MINUTES % minutes == 0:
        return df.withColumn(out, minute_bin(ts, minutes))
    if not scope or not set(scope) <= set(SCOPE_COLUMNS):
        raise ValueError(f"scope must be a non-empty subset of {SCOPE_COLUMNS}")
    starts = df.groupBy(*scope).agg(F.min(ts).alias("__first_bin_ts"))
    midnight = F.to_timestamp_ntz(F.to_date("__first_bin_ts").cast("string"))
    return (df.join(F.broadcast(starts), scope, "left")
              .withColumn(out, minute_bin(ts, minutes, midnight))
              .drop("__first_bin_ts"))
