"""The activity analyses of scored logs.

Inputs are scored logs (``operators.scoring.score_logs``). Zero-filled grids
are generated per log with ``explode(sequence(...))`` over a fixed domain and
joined to the facts on equal keys; no cross join is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragchew.constants import (BANDMAP, CONTEST_HOURS,
                               CONTINENTS, EVOLUTION_FEATURES)
from ragchew.functions.timecols import dummy_clock, label_col
from ragchew.operators.rolling import rolling_sums
from ragchew.operators.timing import add_bin, add_contest_hour
from ragchew.session import materialize, tasks_for

LOG = ["contest", "contest_mode"]
# Cells of a zero-filled grid that one task makes.
CELLS_PER_TASK = 500_000


def with_label(df: DataFrame, call: str = "mycall") -> DataFrame:
    return df.withColumn("callsign_year", label_col(call, "year"))


def frequency_view(scored: DataFrame) -> DataFrame:
    """Label, dummy clock, frequency and band per contact."""
    return with_label(scored).select(
        *LOG, "callsign_year", "seq", dummy_clock("hour").alias("dummy_datetime"),
        "frequency", "band")


def _target(scored: DataFrame, target: str):
    """What the rates sum: contacts, or a column (flags count as 0 or 1)."""
    if target == "qsos":
        return F.lit(1).cast("long")
    flag = scored.schema[target].dataType.typeName() == "boolean"
    return F.col(target).cast("long") if flag else F.col(target)


def rate(scored: DataFrame, time_bin_size: int = 60, target: str = "qsos") -> DataFrame:
    """Sum of ``target`` (``qsos`` = one per contact) per dummy-clock bin
    and label; only bins with contacts."""
    df = with_label(scored)
    value = _target(scored, target)
    df = add_bin(df, "dummy_datetime", dummy_clock("hour"), time_bin_size, LOG)
    return df.groupBy(*LOG, "callsign_year", "dummy_datetime").agg(
        F.sum(value).alias(f"{target}_sum"))


def rolling_rate(scored: DataFrame, time_bin_size: int = 60, target: str = "qsos") -> DataFrame:
    """Per contact, sum of ``target`` over the log's last ``time_bin_size``
    minutes (row-wise, ties up to the current row), on the dummy clock."""
    value = _target(scored, target)
    out = rolling_sums(scored, value, {f"{target}_sum": time_bin_size})
    return with_label(out).select(
        *LOG, "callsign_year", "seq", dummy_clock("hour").alias("dummy_datetime"),
        f"{target}_sum")


def _bands_present(df: DataFrame) -> DataFrame:
    return df.select("band", "band_id").distinct()


def qsos_per_hour(scored: DataFrame, time_bin_size: int = 60,
                  continents: list[str] | None = None) -> DataFrame:
    """A5: contacts per (station, year, band, hour bin) over a zero-filled 48 h
    grid of the bands that occur, plus the total over bands per hour bin."""
    conts = continents or CONTINENTS
    p = float(time_bin_size) / 60
    nbins = int(-(-CONTEST_HOURS // p)) if p else 0
    df = scored.where(F.col("continent").isin(conts))
    df = df.withColumn("hbin", F.floor(F.bround(F.col("hour") / F.lit(p), 2)).cast("long"))
    facts = df.groupBy(*LOG, "mycall", "year", "band", "band_id", "hbin").agg(
        F.count("call").alias("qsos"))
    # small (logs x bands x bins) and read four times below: written once
    facts = materialize(facts, "qsos-hour-facts")
    totals = facts.groupBy(*LOG, "mycall", "year", "hbin").agg(
        F.sum("qsos").alias("total_qsos"))
    domain = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(i).alias("band_id"))
                       for i, (b, _, _) in enumerate(BANDMAP)],
                     F.struct(F.lit(-1).alias("band"), F.lit(-1).alias("band_id")))
    logs = facts.select(*LOG, "mycall", "year").distinct()
    # a log has many cells: the tasks that fill them are as many as these need, not as the logs do
    cells = logs.count() * nbins * (len(BANDMAP) + 1)
    logs = logs.repartition(tasks_for(facts.sparkSession, cells, CELLS_PER_TASK), "mycall", "year")
    grid = (logs
            .withColumn("hbin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nbins - 1).cast("long"))))
            .withColumn("__b", F.explode(domain))
            .select(*LOG, "mycall", "year", "hbin", "__b.band", "__b.band_id"))
    grid = grid.join(F.broadcast(_bands_present(facts)), ["band", "band_id"], "left_semi")
    out = (grid.join(facts, [*LOG, "mycall", "year", "band", "band_id", "hbin"], "left")
               .join(totals, [*LOG, "mycall", "year", "hbin"], "left"))
    return with_label(out).select(
        *LOG, "mycall", "year", F.col("band").cast("string").alias("band"), "band_id",
        F.bround(F.col("hbin") * F.lit(p), 2).alias("hour_rounded"),
        F.coalesce("qsos", F.lit(0)).cast("long").alias("qsos"),
        F.coalesce("total_qsos", F.lit(0)).cast("long").alias("total_qsos"),
        "callsign_year")


def heatmap(scored: DataFrame, time_bin_size: int = 1, continents: list[str] | None = None,
            hour_step: int = 1) -> DataFrame:
    """A3: per (time bin, label, contest hour): contacts and the distinct calls
    in order of appearance, zero-filled over hours x minutes x labels; cells
    outside the grid are dropped."""
    conts = continents or CONTINENTS
    df = with_label(scored.where(F.col("continent").isin(conts)))
    df = add_bin(df.withColumn("contest_hour", F.floor("hour").cast("long")),
                 "__bin", "datetime", time_bin_size, LOG)
    keys = [*LOG, "callsign_year", "contest_hour", "__bin"]
    # distinct calls per cell first (partial aggregate: a hot cell only carries
    # its distinct calls), then one ordered list and the count per cell
    firsts = df.groupBy(*keys, "call").agg(F.min("seq").alias("__first"),
                                           F.count(F.lit(1)).alias("__n"))
    facts = firsts.groupBy(*keys).agg(
        F.sum("__n").alias("qsos"),
        F.transform(F.array_sort(F.collect_list(F.struct("__first", "call"))),
                    lambda x: x["call"]).alias("calls"))
    facts = (facts.withColumn("contest_minute", F.minute("__bin").cast("long"))
             .drop("__bin"))
    # small (one row per busy cell) and read twice below: written once
    facts = materialize(facts, "heatmap-facts")
    hours = F.sequence(F.lit(0).cast("long"), F.lit(CONTEST_HOURS - 1).cast("long"),
                       F.lit(hour_step).cast("long"))
    minutes = F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"),
                         F.lit(time_bin_size).cast("long"))
    grid = (facts.select(*LOG, "callsign_year").distinct()
            .withColumn("contest_hour", F.explode(hours))
            .withColumn("contest_minute", F.explode(minutes)))
    out = grid.join(facts, [*LOG, "callsign_year", "contest_hour", "contest_minute"], "left")
    return out.select(
        *LOG, "callsign_year", "contest_hour", "contest_minute",
        F.coalesce("qsos", F.lit(0)).cast("long").alias("qsos"),
        F.coalesce("calls", F.array().cast("array<string>")).alias("calls"))


def heatmap_pivot(heat: DataFrame, time_bin_size: int = 1) -> DataFrame:
    """A4: one row per (label, contest hour), one column per minute bin."""
    minutes = list(range(0, 60, time_bin_size))
    return (heat.groupBy(*LOG, "callsign_year", "contest_hour")
                .pivot("contest_minute", minutes).agg(F.first("qsos")))


def qso_direction(scored: DataFrame, contest_hours=(0, 23), bin_width: int = 10) -> DataFrame:
    """Contacts per heading bin ``(left, left + 10]`` and label, within
    ``[h0, h1)`` contest hours; every bin of every label present, 0 when empty;
    heading exactly 0 falls in no bin."""
    h0, h1 = contest_hours
    nb = 360 // bin_width
    df = with_label(scored.where((F.col("hour") >= h0) & (F.col("hour") < h1)))
    df = df.where((F.col("heading") > 0) & (F.col("heading") <= 360))
    df = df.withColumn("__bin", (F.ceil(F.col("heading") / bin_width) - 1).cast("long"))
    facts = df.groupBy(*LOG, "callsign_year", "__bin").agg(F.count("call").alias("qsos"))
    facts = materialize(facts, "direction-facts")  # small, read twice
    grid = (facts.select(*LOG, "callsign_year").distinct()
            .withColumn("__bin", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.lit(nb - 1).cast("long")))))
    out = grid.join(facts, [*LOG, "callsign_year", "__bin"], "left")
    return out.select(*LOG, "callsign_year",
                      (F.col("__bin") * bin_width).cast("double").alias("heading_first"),
                      F.coalesce("qsos", F.lit(0)).cast("long").alias("qsos"))


def contest_evolution(scored: DataFrame, feature: str, time_bin_size: int = 1,
                      hour_scope: list[str] | None = None) -> DataFrame:
    """One score feature per (label, dummy-clock bin): the last non-null
    value in log order, or the mean. The contest hour is recomputed over
    ``hour_scope`` (default: each contest-year)."""
    if feature not in EVOLUTION_FEATURES:
        raise ValueError(f"Feature to plot not known: {feature}")
    column, how = EVOLUTION_FEATURES[feature]
    scope = hour_scope or [*LOG, "year"]
    df = add_contest_hour(scored, scope)
    df = add_bin(with_label(df), "dummy_datetime", dummy_clock("hour"), time_bin_size, LOG)
    if how == "last":
        agg = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("seq")))
    else:
        agg = F.avg(column)
    return df.groupBy(*LOG, "callsign_year", "dummy_datetime").agg(agg.alias(column))


def previous_call(scored: DataFrame) -> DataFrame:
    """W3 view: minutes and band of the same call's previous valid contact."""
    return scored.select(*LOG, "year", "mycall", "seq", "call", "band",
                         F.col("is_valid").cast("int").alias("is_valid"),
                         "minutes_from_previous_call", "band_from_previous_call",
                         "band_transition_from_previous_call")


def repeat_histogram(scored: DataFrame, time_bin_size: int = 5) -> DataFrame:
    """Contacts per (label, band transition, bin of minutes since the
    call's previous contact) and the cumulative count over bins."""
    df = with_label(scored.where(F.col("minutes_from_previous_call").isNotNull()))
    df = df.withColumn("__bin", F.floor(F.col("minutes_from_previous_call") / time_bin_size))
    keys = [*LOG, "callsign_year", "band_transition_from_previous_call"]
    facts = df.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("qsos"))
    w = (Window.partitionBy(*keys).orderBy("__bin")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return facts.select(*keys, (F.col("__bin") * time_bin_size).cast("double").alias("minutes_bin"),
                        F.col("qsos").cast("long").alias("qsos"),
                        F.sum("qsos").over(w).cast("long").alias("cum_qsos"))


def transition_labels(scored: DataFrame) -> DataFrame:
    """O2: the distinct band transitions of repeated contacts (at most a pair of
    bands each) in display order, numbered from 0."""
    label = "band_transition_from_previous_call"
    labels = scored.where(F.col("minutes_from_previous_call").isNotNull()).agg(
        F.array_sort(F.collect_set(label)).alias("labels"))
    return labels.select(F.posexplode("labels").alias("position", label))


def axis_max(df: DataFrame, column: str, margin: float = 1.05) -> DataFrame:
    """The axis top used by the charts (one row: margin x maximum)."""
    return df.agg((F.max(column) * F.lit(margin)).alias(f"{column}_axis_max"))
