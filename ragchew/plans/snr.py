"""W7-W11 (J8, A15, A16): smoothed signal strength of stations per band and
receiver continent.

Every step is a DataFrame operator: relational division for the closed
receiver list, partial aggregates for the activity filter and the bin means,
a blocked recurrence for the two-sided exponential smoothing and a
bounded window frame for the centred rolling median. Windows are keyed by (station, band, continent[,
receiver]); after the bin mean each such series has at most one row per
(time bin, frequency), so its length is bounded by the contest duration.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragchew.constants import (BANDS, SNR_ALPHA, SNR_MIN_RX_SPOTS_PER_HOUR,
                               SNR_SMOOTHING_HOURS)
from ragchew.functions.predicate import predicate
from ragchew.functions.timecols import minute_bin
from ragchew.operators.timing import add_bin
from ragchew.session import materialize, tasks_for

KEY = ["contest", "contest_mode", "year"]
# Weight at the end of a block of the smoothing: far below what can change a double, far above the least one.
EWM_BLOCK_WEIGHT = 1e-100
# Hash columns of the cells: a part of the keys of the activity filter, the bin means and the series, which all reuse it.
SERIES_HASH = ["dx", "callsign", "band"]
# Cells of a task of the grid.
CELLS_PER_TASK = 64_000


def ewm_block(alpha: float) -> int:
    """Rows in a block of the smoothing: the weight of a row falls to ``EWM_BLOCK_WEIGHT`` over one, so a
    row depends on its own block and the one before only; ``alpha`` lies in (0, 1]."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError(f"alpha must be in (0, 1]: {alpha}")
    if alpha == 1.0:
        return 1
    return max(1, math.ceil(math.log(EWM_BLOCK_WEIGHT) / math.log1p(-alpha)))


def closed_receivers(spots: DataFrame, callsigns: list[str]) -> DataFrame:
    """Receivers that heard every one of ``callsigns`` (relational
    division: distinct stations per receiver == len(callsigns))."""
    heard = (spots.where(F.col("dx").isin(callsigns))
             .groupBy(*KEY, "callsign").agg(F.countDistinct("dx").alias("__n")))
    return heard.where(F.col("__n") == len(set(callsigns))).select(*KEY, "callsign")


def active_receivers(spots: DataFrame, min_spots: int = SNR_MIN_RX_SPOTS_PER_HOUR) -> DataFrame:
    """Keep spots whose (clock hour, station, receiver, band) has at least
    ``min_spots`` spots (count is a partial aggregate, joined back)."""
    keys = [*KEY, "__hour", "dx", "callsign", "band"]
    df = spots.withColumn("__hour", minute_bin("datetime", 60))
    busy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_spots)
    return df.join(busy.select(*keys), keys, "left_semi").drop("__hour")


def ewm_two_sided(df: DataFrame, partition: list[str], order: list[str], value: str = "db",
                  alpha: float = SNR_ALPHA) -> DataFrame:
    """Mean of the forward and backward bias-adjusted exponential moving
    averages of ``value`` within each partition.

    Blocked linear recurrence: rows are numbered and cut into blocks. With ``q = 1 - alpha`` the sum of a row
    over its block is ``q^r`` times the running sum of ``x * q^-r`` (``r`` counts from the block's start), whose terms
    grow with ``r``, so nothing cancels. A block hands its last sum on to the next, which adds it with the weight
    ``q^(r + 1)``; the sums of weights are a closed form. Backward the same from the block's end. A row carries no array, and
    every running sum is one pass. Null values have no weight and no number; the mean is null beside
    them if one side has no value at all."""
    if alpha == 1.0:
        return df
    q, size = 1.0 - alpha, ewm_block(alpha)
    series = Window.partitionBy(*partition)
    up = series.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    # numbers of the last value up to the row and of the first from the row on (0-based)
    df = df.withColumns({"__at": F.count(value).over(up) - 1, "__n": F.count(value).over(series)})
    df = df.withColumn("__next", F.col("__at") + F.col(value).isNull().cast("long"))
    names = {"fore": ("__at", 1), "back": ("__next", -1)}
    for name, (at, way) in names.items():
        block, r = F.floor(F.col(at) / size), F.pmod(F.col(at), F.lit(size))
        age = r if way > 0 else F.lit(size - 1) - r
        df = df.withColumns({f"__{name}_block": block, f"__{name}_age": age.cast("double")})
    for name, (at, way) in names.items():
        block, age = F.col(f"__{name}_block"), F.col(f"__{name}_age")
        towards = [F.col(c).asc() if way > 0 else F.col(c).desc() for c in (at, *order)]
        inside = Window.partitionBy(*partition, f"__{name}_block").orderBy(*towards).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(f"__{name}", F.pow(F.lit(q), age) * F.sum(x * F.pow(F.lit(q), -age)).over(inside))
        # the last sum of the block handed on
        handed = series.orderBy(block.asc() if way > 0 else block.desc()).rangeBetween(-1, -1)
        df = df.withColumn(f"__{name}_in", F.max_by(f"__{name}", age).over(handed))
    fore, back = (
        (F.col(f"__{n}") + F.coalesce(F.col(f"__{n}_in"), F.lit(0.0)) * F.pow(F.lit(q), F.col(f"__{n}_age") + 1))
        * F.lit(alpha) / F.nullif(F.lit(1.0) - F.pow(F.lit(q), weights.cast("double")), F.lit(0.0))
        for n, weights in (("fore", F.col("__at") + 1), ("back", F.greatest(F.col("__n") - F.col("__next"), F.lit(0)))))
    df = df.withColumn(value, (fore + back) / 2.0)
    return df.drop(*[c for c in df.columns if c.startswith(("__fore", "__back"))], "__at", "__n", "__next")


def centred_rolling_median(df: DataFrame, partition: list[str], order: str, size: int,
                           value: str = "db") -> DataFrame:
    """Median over a centred window of ``size`` rows (``size//2`` before,
    ``size - size//2 - 1`` after), at least one row."""
    before = size // 2
    after = size - before - 1
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-before, after)
    return df.withColumn(value, F.percentile(F.col(value), F.lit(0.5)).over(w))


def fill_gaps(df: DataFrame, series: list[str], time_bin_size: int, value: str = "db") -> DataFrame:
    """W8 on a dense grid: every series gets every bin between its first and
    last one (at most the contest length), and a missing value becomes the
    mean of its neighbours (lag/lead); one without two neighbours stays null
    and is dropped."""
    bounds = df.groupBy(*series).agg(F.min("datetime").alias("__lo"), F.max("datetime").alias("__hi"))
    step = F.expr(f"INTERVAL {int(time_bin_size)} MINUTES")
    grid = bounds.select(*series, F.explode(F.sequence("__lo", "__hi", step)).alias("datetime"))
    dense = grid.join(df, [*series, "datetime"], "left")
    w = Window.partitionBy(*series).orderBy("datetime", "freq")
    filled = F.coalesce(F.col(value), (F.lag(value).over(w) + F.lead(value).over(w)) / 2.0)
    return dense.withColumn(value, filled).where(F.col(value).isNotNull())


def snr_grid(spots: DataFrame, callsigns: list[str], year: int, bands: list[int] | None = None,
             time_bin_size: int = 10, rx_continents: list[str] | None = None,
             filter_str: str | None = None, closed_list: bool = True,
             fill_missing: bool = False, template_minutes: int | None = None) -> DataFrame:
    """Closed receiver list -> active receivers -> bin means -> two-sided
    smoothing per receiver -> median over receivers -> centred rolling median
    over ``SNR_SMOOTHING_HOURS``.

    The spots are read once: a partial aggregate per (clock hour, time bin,
    station, receiver, frequency, band, continent) keeps the sum and count of
    ``db`` and the spot count. The closed list, the per-hour activity filter
    and the bin means all work on that small table (written once), and the
    bin mean of the surviving spots is the ratio of their sums. ``template_minutes`` keeps only the bins that lie on a grid
    of that width from the first bin on (D9: the literal template has 10 minutes, whatever the bins)."""
    bands = [int(b) for b in (bands or BANDS)]
    calls = [c.upper() for c in callsigns]
    df = spots.where(F.col("year") == int(year))
    if filter_str:
        df = df.where(predicate(filter_str, df.columns))  # P11
    df = df.where(F.col("dx").isin(calls))
    if rx_continents:
        df = df.where(F.col("de_cont").isin(rx_continents))
    df = df.withColumns({
        "freq": F.bround("freq", 0).cast("int"),
        "__hour": minute_bin("datetime", 60),
    })
    df = add_bin(df, "__bin", "datetime", time_bin_size, KEY)
    cell = [*KEY, "__hour", "__bin", "dx", "callsign", "freq", "band", "de_cont"]
    agg = df.groupBy(*cell).agg(F.sum("db").alias("__sum"), F.count("db").alias("__n_db"),
                                F.count("callsign").alias("__n"))
    agg = materialize(agg, "snr-cells")
    tasks = tasks_for(agg.sparkSession, agg.count(), CELLS_PER_TASK)
    if closed_list:
        agg = agg.join(closed_receivers(agg, calls), [*KEY, "callsign"], "left_semi")
    agg = agg.repartition(tasks, *SERIES_HASH)
    busy = Window.partitionBy(*KEY, "__hour", "dx", "callsign", "band")
    agg = agg.withColumn("__busy", F.sum("__n").over(busy))
    agg = agg.where(F.col("__busy") >= SNR_MIN_RX_SPOTS_PER_HOUR)
    out = (agg.groupBy(*KEY, "__bin", "dx", "callsign", "freq", "band", "de_cont")
              .agg((F.sum("__sum") / F.sum("__n_db")).alias("db"))
              .withColumnRenamed("__bin", "datetime"))
    if template_minutes:
        starts = out.groupBy(*KEY).agg(F.min("datetime").alias("__start"))  # one row per contest and year
        minutes = F.timestamp_diff("MINUTE", F.col("__start"), F.col("datetime"))
        out = out.join(F.broadcast(starts), KEY).where(minutes % template_minutes == 0).drop("__start")
    out = out.where(F.col("band").isin(bands))
    if fill_missing:
        out = fill_gaps(out, [*KEY, "dx", "band", "de_cont", "callsign"], time_bin_size)
    out = ewm_two_sided(out, [*KEY, "dx", "band", "de_cont", "callsign"], ["datetime", "freq"])
    out = out.groupBy(*KEY, "datetime", "dx", "band", "de_cont").agg(
        F.percentile(F.col("db"), F.lit(0.5)).alias("db"))
    size = max(int(SNR_SMOOTHING_HOURS * 60 / time_bin_size), 1)
    return centred_rolling_median(out, [*KEY, "dx", "band", "de_cont"], "datetime", size)
