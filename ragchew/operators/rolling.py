"""Row-wise rolling sums over the last ``w`` minutes of each log.

pandas' time-based rolling on a log sorted by time: rows are ordered by
(time, ``order``); the window of a row at time ``t`` is ``(t - w, t]``, and
among rows of the same time only those up to and including the row itself.
A row without a time gets null and counts for no other row; a null value
counts as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragchew.constants import LOG_KEY
from ragchew.functions.timecols import ntz_micros

MINUTE = 60_000_000


def rolling_sums(df: DataFrame, value: Column, windows: dict[str, int],
                 log_key: list[str] | None = None, ts: str = "datetime",
                 order: str = "seq", strategy: str = "per_log") -> DataFrame:
    """Add one column per ``windows`` entry (name -> minutes).

    Both plans give the same rows. ``per_log`` (a log fits one task): a RANGE
    frame over the log minus the later rows of the same time, on the log
    partitioning of the scoring job. ``chunked`` (a log too big for one
    task): a per-(log, time) aggregate with a RANGE frame over the earlier
    times, joined back, plus the running sum among the rows of the same time,
    so windows hold one time of a log, or one row per time."""
    if strategy not in ("per_log", "chunked"):
        raise ValueError(f"unknown strategy: {strategy}")
    key = log_key or LOG_KEY
    us = ntz_micros(ts)
    value = F.coalesce(value, F.lit(0))
    timed = F.col(ts).isNotNull()
    same = Window.partitionBy(*key, ts).orderBy(order)
    if strategy == "per_log":
        later = same.rowsBetween(1, Window.unboundedFollowing)
        cols = {}
        for name, minutes in windows.items():
            frame = (Window.partitionBy(*key).orderBy(us)
                     .rangeBetween(-(minutes * MINUTE - 1), Window.currentRow))
            cols[name] = F.when(timed, F.sum(value).over(frame)
                                - F.coalesce(F.sum(value).over(later), F.lit(0)))
        return df.withColumns(cols)
    per_ts = (df.where(timed).groupBy(*key, ts).agg(F.sum(value).alias("__m"))
                .withColumn("__us", ntz_micros(ts)))
    earlier = [F.coalesce(F.sum("__m").over(
        Window.partitionBy(*key).orderBy("__us").rangeBetween(-(minutes * MINUTE - 1), -1)),
        F.lit(0)).alias(f"__before_{name}") for name, minutes in windows.items()]
    out = df.withColumn("__tied", F.sum(value).over(
        same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.join(per_ts.select(*key, ts, *earlier), [*key, ts], "left")
    # a row without a time finds no aggregate: null
    out = out.withColumns({name: F.col("__tied") + F.col(f"__before_{name}") for name in windows})
    return out.drop("__tied", *[f"__before_{name}" for name in windows])
