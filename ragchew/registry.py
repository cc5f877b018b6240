"""Named queries over the test tables: name -> (spark, sf_dir) -> DataFrame.

Each query builds its stand-in input from the driver's tables with
``ragchew.fixtures`` and runs the library operator named by the query on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragchew import fixtures as fx
from ragchew.functions.bands import add_band
from ragchew.operators.scoring import score_logs
from ragchew.plans import tables, activity, rollups, spots as spot_plans, snr
from ragchew.functions.timecols import minute_bin
from ragchew.sources import spots as spot_src
from ragchew.operators.lookup import PrefixTable, fill_continents, lookup_call, prepare_prefixes
from ragchew.operators import calendar
from ragchew.sources import cabrillo, catalog, files, store
from ragchew.session import checkpoint_dir, materialize
import uuid
from ragchew.constants import EVOLUTION_FEATURES

Query = Callable[[SparkSession, str], DataFrame]

SCORE_COMMON = ["contest", "contest_mode", "year", "mycall", "seq", "datetime", "band", "band_id",
                "call", "country", "continent", "mycountry", "mycontinent"]
SCORE_TAIL = ["is_valid", "qso_points", "n_mult", "cum_qso_points", "cum_mult",
              "cum_contest_score", "cum_valid_qsos", "cum_points_per_qso", "diff_contest_score",
              "mult_worth_points", "mult_worth_qsos", "hour", "minutes_from_previous_call",
              "band_from_previous_call", "band_transition_from_previous_call"]
SCORE_COLUMNS = {
    "cqww": SCORE_COMMON + ["zone", "is_dxcc", "is_zone"] + SCORE_TAIL,
    "cqwpx": SCORE_COMMON + ["prefix", "is_mult"] + SCORE_TAIL,
    "iaru": SCORE_COMMON + ["myexchange", "exchange", "is_mult"] + SCORE_TAIL,
}
ROUND6 = ["cum_points_per_qso", "mult_worth_points", "mult_worth_qsos", "hour",
          "diff_contest_score", "minutes_from_previous_call"]


_PREPARED: dict[tuple[str, str], PrefixTable] = {}


def prefixes(spark: SparkSession, sf_dir: str) -> PrefixTable:
    """The prefix dimension, prepared once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PREPARED:
        _PREPARED[key] = prepare_prefixes(fx.prefix_dimension(spark, sf_dir))
    return _PREPARED[key]


def scored_job(spark: SparkSession, sf_dir: str, contest: str = "cqww") -> DataFrame:
    """G5 over the fixture logs (lazy; nothing written)."""
    raw = fx.raw_logs(spark, sf_dir, contest=contest)
    return score_logs(raw, contest, prefixes(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, contest: str = "cqww") -> DataFrame:
    """Scored logs for the analyses (the scoring job, lazily; the store
    round trip is exercised by ``store_reload``)."""
    return scored_job(spark, sf_dir, contest)


def _present(df: DataFrame, cols: list[str]) -> DataFrame:
    """Output shape shared with the oracle: ints for flags, 6-place doubles."""
    out = []
    for c in cols:
        if c == "is_valid":
            out.append(F.col(c).cast("int").alias(c))
        elif c in ROUND6:
            out.append(F.round(F.col(c).cast("double"), 6).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def q_band(spark, sf_dir):
    raw = fx.raw_logs(spark, sf_dir)
    return add_band(raw).select("contest", "contest_mode", "year", "mycall", "seq",
                                "frequency", "band", "band_id")


def _q_score(contest):
    def q(spark, sf_dir):
        return _present(scored_job(spark, sf_dir, contest), SCORE_COLUMNS[contest])
    return q


def _q_summary(contest):
    def q(spark, sf_dir):
        return tables.contest_summary(scored(spark, sf_dir, contest), contest)
    return q


q_summary_iaru = _q_summary("iaru")


def _r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (shared with the oracle)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


def q_contest_hour(spark, sf_dir):
    return _r6(scored(spark, sf_dir).select("contest", "contest_mode", "year", "mycall", "seq",
                                            "datetime", "hour"))


def q_rate(spark, sf_dir):
    return activity.rate(scored(spark, sf_dir), time_bin_size=60)


def q_rate_points(spark, sf_dir):
    return activity.rate(scored(spark, sf_dir), time_bin_size=30, target="qso_points")


def q_rolling_rate(spark, sf_dir):
    return activity.rolling_rate(scored(spark, sf_dir), time_bin_size=60)


def _q_log_table(contest):
    def q(spark, sf_dir):
        return _r6(tables.contest_log(scored(spark, sf_dir, contest), contest))
    return q


def q_qsos_hour(spark, sf_dir):
    return activity.qsos_per_hour(scored(spark, sf_dir), time_bin_size=60)


def q_qsos_hour_30(spark, sf_dir):
    return activity.qsos_per_hour(scored(spark, sf_dir), time_bin_size=30,
                                  continents=["EU", "NA", "AS", "SA", "OC"])


def q_heatmap(spark, sf_dir):
    return activity.heatmap(scored(spark, sf_dir), time_bin_size=1)


def q_heatmap_10(spark, sf_dir):
    return activity.heatmap(scored(spark, sf_dir), time_bin_size=10,
                            continents=["EU", "NA", "AS", "SA", "OC"])


def q_heatmap_pivot(spark, sf_dir):
    return activity.heatmap_pivot(activity.heatmap(scored(spark, sf_dir), 1), 1)


def q_frequency(spark, sf_dir):
    return activity.frequency_view(scored(spark, sf_dir))


def q_direction(spark, sf_dir):
    return activity.qso_direction(scored(spark, sf_dir), (0, 23))


def _q_evolution(feature):
    def q(spark, sf_dir):
        return _r6(activity.contest_evolution(scored(spark, sf_dir), feature, time_bin_size=60))
    return q


def q_prev_call(spark, sf_dir):
    return _r6(activity.previous_call(scored(spark, sf_dir)))


def q_repeat_hist(spark, sf_dir):
    return activity.repeat_histogram(scored(spark, sf_dir), time_bin_size=5)


SNR_CALLS = ["ST0", "ST1", "ST2", "ST3", "ST4"]
SNR_RX = ["EU", "NA", "AS", "AF"]


def spots(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """G9 over the fixture: raw spot rows -> continents filled -> cleaned."""
    raw = fx.raw_spots(spark, sf_dir, dense=dense)
    return spot_src.ingest_spots(raw, prefixes(spark, sf_dir), "cqww", "cw", 2023)


def q_spot_fill_cont(spark, sf_dir):
    raw = fx.raw_spots(spark, sf_dir)
    return fill_continents(raw, prefixes(spark, sf_dir)).select(
        "callsign", "dx", "date", "freq", "db", "de_pfx", "dx_pfx", "de_cont", "dx_cont")


def q_spot_clean(spark, sf_dir):
    raw = fx.raw_spots(spark, sf_dir)
    return spot_src.ingest_spots(raw, prefixes(spark, sf_dir), "cqww", "cw", 2023)


def q_band_conditions(spark, sf_dir):
    return _r6(spot_plans.band_conditions(spots(spark, sf_dir), "EU", 60))


def q_cw_speed(spark, sf_dir):
    return _r6(spot_plans.cw_speed(spots(spark, sf_dir), None, 60))


def q_spot_counts(spark, sf_dir):
    return spot_plans.spot_counts(spots(spark, sf_dir), None, 60)


def q_snr_mean(spark, sf_dir):
    return _r6(spot_plans.snr_mean(spots(spark, sf_dir), None, 60))


def _dense(spark, sf_dir):
    return spots(spark, sf_dir, dense=True).where(F.col("year") == 2023)


def q_closed_receivers(spark, sf_dir):
    df = _dense(spark, sf_dir).where(F.col("de_cont").isin(SNR_RX))
    return snr.closed_receivers(df, SNR_CALLS)


def q_active_receivers(spark, sf_dir):
    df = _dense(spark, sf_dir).where(F.col("dx").isin(SNR_CALLS) & F.col("de_cont").isin(SNR_RX))
    return snr.active_receivers(df)


def q_snr_smooth(spark, sf_dir):
    df = _dense(spark, sf_dir).where(F.col("dx").isin(SNR_CALLS) & F.col("de_cont").isin(SNR_RX))
    df = df.withColumns({"datetime": minute_bin("datetime", 10),
                         "freq": F.bround("freq", 0).cast("int")})
    df = df.groupBy(*snr.KEY, "datetime", "dx", "callsign", "freq", "band", "de_cont").agg(
        F.avg("db").alias("db"))
    return _r6(snr.ewm_two_sided(df, [*snr.KEY, "dx", "band", "de_cont", "callsign"],
                                 ["datetime", "freq"]))


def q_snr_grid(spark, sf_dir):
    return _r6(snr.snr_grid(_dense(spark, sf_dir), SNR_CALLS, 2023, time_bin_size=10,
                            rx_continents=SNR_RX))


def q_snr_grid_5(spark, sf_dir):
    return _r6(snr.snr_grid(_dense(spark, sf_dir), SNR_CALLS[:2], 2023, bands=[10, 20, 40],
                            time_bin_size=5, rx_continents=SNR_RX))


def _scratch(spark, what: str) -> str:
    """A fresh folder under the shared checkpoint folder; it goes when the session ends."""
    parent = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)  # only what exists can be marked
    fs.deleteOnExit(where)
    return f"{parent}/{what}"


def q_weekends(spark, sf_dir):
    years = fx.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    return calendar.weekends(years)


def q_contest_dates(spark, sf_dir):
    years = fx.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    return calendar.contest_dates(calendar.weekends(years), calendar.contest_rules(spark))


def q_prefix_lookup(spark, sf_dir):
    calls = fx.raw_logs(spark, sf_dir).select("call").distinct()
    return lookup_call(calls, "call", prefixes(spark, sf_dir))


def q_geo(spark, sf_dir):
    return _r6(scored(spark, sf_dir).select(
        "contest", "contest_mode", "year", "mycall", "seq", "locator", "mylocator",
        "distance", "distance_lp", "heading", "heading_lp"))


def q_prefix_lookup_shuffled(spark, sf_dir):
    """J5 with the sorted order cut by one character instead of two."""
    calls = fx.raw_logs(spark, sf_dir).select("call").distinct()
    return lookup_call(calls, "call", fx.prefix_dimension(spark, sf_dir), piece=1)


def _log_text(spark, sf_dir):
    path = fx.write_log_text(fx.raw_logs(spark, sf_dir), _scratch(spark, "logtext"))
    return cabrillo.log_lines(cabrillo.read_log_text(spark, path).drop("path"))


def q_log_scan(spark, sf_dir):
    typed, _ = cabrillo.parse_qso_lines(_log_text(spark, sf_dir), "cqww")
    return typed


def q_log_scan_lines(spark, sf_dir):
    """S3 line by line, as for logs too long for one row."""
    path = fx.write_log_text(fx.raw_logs(spark, sf_dir), _scratch(spark, "logtext"))
    return cabrillo.parse_qso_lines(cabrillo.read_log_lines(spark, path).drop("path"), "cqww")[0]


def q_log_header(spark, sf_dir):
    return cabrillo.parse_header(_log_text(spark, sf_dir), ["contest", "contest_mode", "year", "mycall"])


def q_catalog_calls(spark, sf_dir):
    return catalog.callsigns_from_pages(fx.table(spark, sf_dir, "pages"))


def q_catalog_links(spark, sf_dir):
    return catalog.year_modes_from_pages(fx.table(spark, sf_dir, "pages"),
                                         pattern=r"href=\"/?(\w+)\"")


def q_catalog_pairs(spark, sf_dir):
    return catalog.pairs_from_pages(fx.table(spark, sf_dir, "pages"),
                                    r"<a href=\"(/?\w+)\">(\w+)<", {"link": 1, "text": 2})


def q_catalog_arrl_years(spark, sf_dir):
    """(year, iid) anchors of the year pages."""
    return catalog.arrl_years(fx.arrl_year_pages(spark, sf_dir))


def q_catalog_arrl_links(spark, sf_dir):
    """(callsign, link) anchors of the log pages."""
    return catalog.arrl_links(fx.arrl_log_pages(spark, sf_dir), keep=["iid"])


def q_catalog_arrl_options(spark, sf_dir):
    """The ARRL options, stored once and read back."""
    def build():
        return catalog.arrl_options(fx.arrl_year_pages(spark, sf_dir), fx.arrl_log_pages(spark, sf_dir), "iaru")
    path = _scratch(spark, "options")
    catalog.stored_options(spark, path, build)
    return catalog.stored_options(spark, path, build)


def q_catalog_cq_links(spark, sf_dir):
    """Year-modes with the fixed pattern."""
    return catalog.year_modes_from_pages(fx.cq_pages(spark, sf_dir))


def q_catalog_cq_options(spark, sf_dir):
    """The CQ options of all pages, after a first load in which a third of the pages were missing and a third
    had another text: only those two thirds are parsed again."""
    pages, path, n = fx.cq_pages(spark, sf_dir), _scratch(spark, "options"), F.col("page_id") % 3
    early = pages.where(n != 0).withColumn("html", F.when(n == 1, F.lit('<a href="2020cw/">EA1A<')).otherwise(F.col("html")))
    catalog.refresh_options(spark, path, early, catalog.cq_options, "cqww")
    return catalog.refresh_options(spark, path, pages, catalog.cq_options, "cqww").select("page_id", "callsign", "mode", "year")


def q_log_table_far_page(spark, sf_dir):
    """O3: a page of 7 rows near the end of the CQWW log table, through the page directory."""
    t = _r6(tables.contest_log(scored(spark, sf_dir, "cqww"), "cqww"))
    path = _scratch(spark, "pages")
    tables.write_pages(t, tables.LOG_TABLE_COLUMNS["cqww"], path)
    total = spark.read.parquet(f"{path}/directory").agg(F.sum("rows")).first()[0]
    return tables.read_page(spark, path, total // 7 - 2, 7)


def q_snr_grid_query(spark, sf_dir):
    """The grid of the spots that a predicate in the users' language keeps."""
    return _r6(snr.snr_grid(_dense(spark, sf_dir), SNR_CALLS, 2023, time_bin_size=10, rx_continents=SNR_RX,
                            filter_str="(speed >= 22 or db == 7) and band in [10, 20, 40] and not callsign.str.startswith('RX3') and db != 9"))


def q_snr_grid_template(spark, sf_dir):
    """W11, D9 literal form: 5-minute bins on a template of 10 minutes."""
    return _r6(snr.snr_grid(_dense(spark, sf_dir), SNR_CALLS[:2], 2023, bands=[10, 20, 40],
                            time_bin_size=5, rx_continents=SNR_RX, template_minutes=10))


def _rolled_logs(spark, sf_dir):
    """The rollup of all logs: the even stations come twice, first with other points among all."""
    path, all_logs = _scratch(spark, "rollup"), materialize(scored(spark, sf_dir), "scored")
    even = F.substring("mycall", 3, 9).cast("int") % 2 == 0
    rollups.put_logs(all_logs.withColumn("qso_points", F.when(even, 9).otherwise(F.col("qso_points"))), path)
    rollups.put_logs(all_logs.where(even), path)
    return rollups.load(spark, path, contest="cqww")


def _rolled_spots(spark, sf_dir):
    """The rollup of all spots: the second day comes twice, first a part of it with the first day."""
    path, all_spots = _scratch(spark, "rollup"), materialize(spots(spark, sf_dir), "spots")
    late = F.to_date("datetime") > F.lit("2023-11-25").cast("date")
    for part in (~late | (F.col("speed") > 24), late):
        rollups.put_spots(all_spots.where(part), path)
    return rollups.load(spark, path, contest="cqww", year=2023)


def _q_rolled_logs(analysis):
    def q(spark, sf_dir):
        return _r6(analysis(_rolled_logs(spark, sf_dir)))
    return q


def _q_rolled_spots(analysis):
    def q(spark, sf_dir):
        return _r6(analysis(_rolled_spots(spark, sf_dir)))
    return q


def _rollup_queries() -> dict[str, Query]:
    return {
        "rollup_rate": _q_rolled_logs(lambda r: rollups.rate(r, 60)),
        "rollup_rate_points": _q_rolled_logs(lambda r: rollups.rate(r, 30, "qso_points")),
        "rollup_evolution_score": _q_rolled_logs(lambda r: rollups.contest_evolution(r, "score", 60)),
        "rollup_evolution_points_per_qso": _q_rolled_logs(lambda r: rollups.contest_evolution(r, "points_per_qso", 60)),
        "rollup_band_conditions": _q_rolled_spots(lambda r: rollups.band_conditions(r, "EU", 60)),
        "rollup_cw_speed": _q_rolled_spots(lambda r: rollups.cw_speed(r, None, 60)),
        "rollup_spot_counts": _q_rolled_spots(lambda r: rollups.spot_counts(r, None, 60)),
        "rollup_snr_mean": _q_rolled_spots(lambda r: rollups.snr_mean(r, None, 25)),
    }


def q_contest_modes(spark, sf_dir):
    """Contests and modes that have dates in the years of the orders."""
    return calendar.contest_modes(q_contest_dates(spark, sf_dir))


def q_transition_labels(spark, sf_dir):
    """O2 over the repeated contacts."""
    return activity.transition_labels(scored(spark, sf_dir))


def q_column_check(spark, sf_dir):
    """The summary, returned by the check of its columns."""
    return tables.check_columns(q_summary_iaru(spark, sf_dir), ["mycall", "year", "band", "qsos", "is_mult",
                                                                "qso_points", "score"])


def q_score_page_after(spark, sf_dir):
    """O3: the third page of the scored contacts, each from the last row of the one before."""
    key = ["contest", "contest_mode", "year", "mycall", "seq"]
    t = _present(scored(spark, sf_dir), SCORE_COLUMNS["cqww"])
    last = None
    for _ in range(2):
        last = tables.page_after(t, key, last).select(*key).tail(1)[0].asDict()
    return tables.page_after(t, key, last)


def _stored(spark, sf_dir, years=None):
    df = scored_job(spark, sf_dir)
    if years:
        df = df.where(F.col("year").isin(years))
    path = _scratch(spark, "store")
    store.write_partitioned(df.select(*SCORE_COLUMNS["cqww"]), path, cluster_by=["mycall"])
    return path


def q_skip_existing(spark, sf_dir):
    """Which of all logs are not among the stored ones of 2023, asked of the table of units."""
    path, raw = _scratch(spark, "store"), fx.raw_logs(spark, sf_dir)
    store.add_partitioned(raw.where("year = 2023"), path, {store.STATION: F.col("mycall")}, cluster_by=["mycall"])
    return store.missing_logs(raw, store.stored_logs(spark, path))


def q_store_reload(spark, sf_dir):
    path = _stored(spark, sf_dir)
    back = store.load_logs(spark, path, contest="cqww", contest_mode="cw")
    return _present(back, SCORE_COLUMNS["cqww"])


def q_prefix(spark, sf_dir):
    from ragchew.functions.callsign import callsign_prefix
    raw = fx.raw_logs(spark, sf_dir)
    return raw.select("contest", "contest_mode", "year", "mycall", "seq", "call",
                      callsign_prefix("call").alias("prefix"))


def q_evolution_score_one_clock(spark, sf_dir):
    """D2 literal form: one contest clock over all years of the contest."""
    return _r6(activity.contest_evolution(scored(spark, sf_dir), "score", time_bin_size=60,
                                          hour_scope=["contest", "contest_mode"]))


def q_heatmap_10_stepped(spark, sf_dir):
    """D5 literal form: hours stepped by the minute bin."""
    return activity.heatmap(scored(spark, sf_dir), time_bin_size=10, hour_step=10)


def q_direction_12_36(spark, sf_dir):
    return activity.qso_direction(scored(spark, sf_dir), (12, 36))


def q_band_conditions_na(spark, sf_dir):
    return _r6(spot_plans.band_conditions(spots(spark, sf_dir), "NA", 30,
                                          ["EU", "AS", "SA", "OC", "AF"]))


def q_log_table_page(spark, sf_dir):
    """O3: page 4 (250 rows) of the CQWW log table in a total order."""
    t = _r6(tables.contest_log(scored(spark, sf_dir, "cqww"), "cqww"))
    return tables.page(t, tables.LOG_TABLE_COLUMNS["cqww"], page_number=3, page_size=250)


# The chunked (hot-log) plan on the same inputs: chunks of 1,000 seq values
# cut every fixture log into about ten chunks.
CHUNK_ROWS_FOR_CHECK = 1000


def q_score_cqww_chunked(spark, sf_dir):
    raw = fx.raw_logs(spark, sf_dir)
    out = score_logs(raw, "cqww", prefixes(spark, sf_dir), strategy="chunked",
                     rows_per_chunk=CHUNK_ROWS_FOR_CHECK)
    return _present(out, SCORE_COLUMNS["cqww"])


def q_log_table_cqww_chunked(spark, sf_dir):
    from ragchew.operators.rolling import rolling_sums
    raw = fx.raw_logs(spark, sf_dir)
    out = score_logs(raw, "cqww", prefixes(spark, sf_dir), strategy="chunked",
                     rows_per_chunk=CHUNK_ROWS_FOR_CHECK)
    out = rolling_sums(out, F.col("is_valid").cast("long"),
                       {"rate_10": 10, "rate_30": 30, "rate_60": 60},
                       strategy="chunked")
    return _r6(out.select(*tables.LOG_TABLE_COLUMNS["cqww"]))


# Bins that do not divide a day start at the first midnight.
def q_rate_7(spark, sf_dir):
    return activity.rate(scored(spark, sf_dir), time_bin_size=7)


def q_rate_valid(spark, sf_dir):
    """A6 with a flag as target."""
    return activity.rate(scored(spark, sf_dir), time_bin_size=60, target="is_valid")


def q_heatmap_7(spark, sf_dir):
    return activity.heatmap(scored(spark, sf_dir), time_bin_size=7)


def q_evolution_score_25(spark, sf_dir):
    return _r6(activity.contest_evolution(scored(spark, sf_dir), "score", time_bin_size=25))


def q_band_conditions_25(spark, sf_dir):
    return _r6(spot_plans.band_conditions(spots(spark, sf_dir), "EU", 25))


def q_snr_mean_25(spark, sf_dir):
    return _r6(spot_plans.snr_mean(spots(spark, sf_dir), None, 25))


def q_spot_pairs(spark, sf_dir):
    """Sending speed of the asked (station, year) pairs: even stations."""
    pairs = spots(spark, sf_dir).where(F.substring("dx", 3, 9).cast("int") % 2 == 0).select("dx", "year")
    return _r6(spot_plans.cw_speed(spots(spark, sf_dir), pairs, 60))


def q_snr_grid_filter(spark, sf_dir):
    """The grid of the spots that a predicate keeps."""
    return _r6(snr.snr_grid(_dense(spark, sf_dir), SNR_CALLS, 2023, time_bin_size=10,
                            rx_continents=SNR_RX, filter_str="speed >= 24"))


def _bin_means(spark, sf_dir):
    df = _dense(spark, sf_dir).where(F.col("dx").isin(SNR_CALLS) & F.col("de_cont").isin(SNR_RX))
    df = df.withColumns({"datetime": minute_bin("datetime", 10),
                         "freq": F.bround("freq", 0).cast("int")})
    return df.groupBy(*snr.KEY, "datetime", "dx", "callsign", "freq", "band", "de_cont").agg(
        F.avg("db").alias("db"))


def q_snr_smooth_slow(spark, sf_dir):
    """W9 with a small alpha: older terms keep their weight."""
    return _r6(snr.ewm_two_sided(_bin_means(spark, sf_dir), [*snr.KEY, "dx", "band", "de_cont", "callsign"],
                                 ["datetime", "freq"], alpha=0.05))


def q_snr_fill(spark, sf_dir):
    """Missing bins of each series from their two neighbours."""
    return _r6(snr.fill_gaps(_bin_means(spark, sf_dir), [*snr.KEY, "dx", "band", "de_cont", "callsign"], 10))


def q_axis_max(spark, sf_dir):
    """A17 over the hourly rate."""
    return _r6(activity.axis_max(activity.rate(scored(spark, sf_dir), 60), "qsos_sum"))


def q_log_pairs(spark, sf_dir):
    """Stored logs of the asked (station, year) pairs: even stations, 2024."""
    path = _stored(spark, sf_dir)
    pairs = (fx.raw_logs(spark, sf_dir).where("year = 2024")
             .where(F.substring("mycall", 3, 9).cast("int") % 2 == 0).select("mycall", "year"))
    return _present(store.load_logs(spark, path, pairs=pairs), SCORE_COLUMNS["cqww"])


INGEST_COLUMNS = ["contest", "contest_mode", "year", "mycall", "datetime", "call", "band",
                  "is_valid", "qso_points", "n_mult", "cum_contest_score"]


def q_ingest_two_steps(spark, sf_dir):
    """G10 + S14: text logs of even stations, then of odd ones, into one store,
    then the first again with ``force``: the store has each log once."""
    from ragchew.plans.ingest import ingest_logs
    raw, dim, path = fx.raw_logs(spark, sf_dir), prefixes(spark, sf_dir), _scratch(spark, "store")
    even = F.substring("mycall", 3, 9).cast("int") % 2 == 0
    texts = [fx.write_log_text(raw.where(part), _scratch(spark, "logtext")) for part in (even, ~even)]
    for text, force in ((texts[0], False), (texts[1], False), (texts[0], True)):
        ingest_logs(spark, text, "cqww", "cw", dim, store_path=path, force=force)
    return _present(store.load_logs(spark, path, "cqww", "cw"), INGEST_COLUMNS)


def q_ingest_headers(spark, sf_dir):
    """The stored header of every log, as the map in its contacts and as rows; the even stations' logs come twice."""
    from ragchew.plans.ingest import ingest_logs
    raw, dim = fx.raw_logs(spark, sf_dir), prefixes(spark, sf_dir)
    path, heads = _scratch(spark, "store"), _scratch(spark, "headers")
    even = F.substring("mycall", 3, 9).cast("int") % 2 == 0
    for part, force in ((even, False), (F.lit(True), True)):
        text = fx.write_log_text(raw.where(part), _scratch(spark, "logtext"))
        ingest_logs(spark, text, "cqww", "cw", dim, store_path=path, force=force, header_path=heads)
    key = ["contest", "contest_mode", "year", "mycall"]
    logs = store.load_logs(spark, path, "cqww", "cw").select(*key, F.explode("meta_data").alias("key", "value")).groupBy(
        *key, "key", "value").agg(F.count(F.lit(1)).alias("contacts"))
    rows = store.load_logs(spark, heads, "cqww", "cw").groupBy(*key, "key", "value").agg(F.count(F.lit(1)).alias("header_rows"))
    return logs.join(rows, [*key, "key", "value"], "full")


def q_spot_rejects(spark, sf_dir):
    """What became of the lines of damaged day files, the second day read twice: stored, or rejected with a reason."""
    from ragchew.plans.ingest import ingest_spots_job
    days, dim = _write_spot_days(spark, sf_dir, fx.damage(fx.raw_spots(spark, sf_dir))), prefixes(spark, sf_dir)
    path, bad = _scratch(spark, "spots"), _scratch(spark, "rejects")
    for day in (days[0], days[1], days[1]):
        ingest_spots_job(spark, [day], dim, "cqww", "cw", 2023, store_path=path, rejects_path=bad)
    stored = store.load_spots(spark, path, "cqww", "cw").select(F.lit("stored").alias("outcome"), "callsign")
    gone = store.load_spots(spark, bad, "cqww", "cw").select(F.col("reason").alias("outcome"),
                                                             F.substring_index("line", ",", 1).alias("callsign"))
    return stored.unionByName(gone).groupBy("outcome", "callsign").agg(F.count(F.lit(1)).alias("lines"))


def _write_spot_days(spark, sf_dir, raw=None):
    """The spots as CSV day files; the two folders. A row goes to the day of its ``day`` or else of its date."""
    raw = (fx.raw_spots(spark, sf_dir) if raw is None else raw).withColumn("tx_mode", F.lit("CW"))
    raw = raw if "day" in raw.columns else raw.withColumn("day", F.substring("date", 1, 10))
    root, days = _scratch(spark, "spot-files"), ["2023-11-25", "2023-11-26"]
    (raw.where(F.col("day").isin(days))
        .select("day", *[f.name for f in spot_src.RAW_SPOT_SCHEMA.fields])
        .write.option("header", "true").partitionBy("day").csv(root))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for day in days:  # a day without spots has a folder too
        where = fs.Path(f"{root}/day={day}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return [f"{root}/day={day}" for day in days]


def q_ingest_spot_days(spark, sf_dir):
    """G9 + S14: one day's spots, then the next day's, then that day again,
    into one store: it has each day once."""
    from ragchew.plans.ingest import ingest_spots_job
    days, dim, path = _write_spot_days(spark, sf_dir), prefixes(spark, sf_dir), _scratch(spark, "spots")
    for day in (days[0], days[1], days[1]):
        ingest_spots_job(spark, [day], dim, "cqww", "cw", 2023, store_path=path)
    return store.load_spots(spark, path, "cqww", "cw").select("contest", "contest_mode", "year",
                                                              *spot_src.SPOT_COLUMNS)


def q_spot_years(spark, sf_dir):
    """S10 + S12: two stored years (the two days stand in for them), one asked."""
    from ragchew.plans.ingest import ingest_spots_job
    days, dim, path = _write_spot_days(spark, sf_dir), prefixes(spark, sf_dir), _scratch(spark, "spots")
    for day, year in zip(days, (2023, 2024)):
        ingest_spots_job(spark, [day], dim, "cqww", "cw", year, store_path=path)
    return store.load_spots(spark, path, "cqww", "cw", [2024]).select("contest", "contest_mode", "year",
                                                                      *spot_src.SPOT_COLUMNS)


def _q_log_scan(contest):
    def q(spark, sf_dir):
        raw = fx.raw_logs(spark, sf_dir, contest=contest)
        path = fx.write_log_text(raw, _scratch(spark, "logtext"), contest)
        lines = cabrillo.log_lines(cabrillo.read_log_text(spark, path).drop("path"))
        return cabrillo.parse_qso_lines(lines, contest)[0]
    return q


def q_log_metadata(spark, sf_dir):
    """The headers as maps, stored as (key, value) rows."""
    key = ["contest", "contest_mode", "year", "mycall"]
    return store.metadata_rows(cabrillo.header_map(cabrillo.parse_header(_log_text(spark, sf_dir), key), key), key)


def q_generic_io(spark, sf_dir):
    """A table written as JSON and read with a schema and a hook."""
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = _scratch(spark, "json")
    files.write(orders, "json", path)
    return files.read(spark, "json", path, orders.schema,
                      lambda df: df.withColumn("o_orderstatus", F.lower("o_orderstatus")))


def _q_generic(fmt):
    def q(spark, sf_dir):
        """S1, S2, S13 in the formats of the loads."""
        orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        path, options = _scratch(spark, fmt), {"header": "true"} if fmt == "csv" else {}
        files.write(orders, fmt, path, **options)
        return files.read(spark, fmt, path, orders.schema, lambda df: df.where("o_orderstatus <> 'P'"), **options)
    return q


def _open_queries() -> dict[str, Query]:
    return {
        "rate_7": q_rate_7,
        "rate_valid": q_rate_valid,
        "heatmap_7": q_heatmap_7,
        "evolution_score_25": q_evolution_score_25,
        "band_conditions_25": q_band_conditions_25,
        "snr_mean_25": q_snr_mean_25,
        "spot_pairs": q_spot_pairs,
        "snr_grid_filter": q_snr_grid_filter,
        "snr_smooth_slow": q_snr_smooth_slow,
        "snr_fill": q_snr_fill,
        "axis_max": q_axis_max,
        "log_pairs": q_log_pairs,
        "ingest_two_steps": q_ingest_two_steps,
        "ingest_spot_days": q_ingest_spot_days,
        "ingest_headers": q_ingest_headers,
        "spot_rejects": q_spot_rejects,
        "spot_years": q_spot_years,
        "log_scan_cqwpx": _q_log_scan("cqwpx"),
        "log_scan_iaru": _q_log_scan("iaru"),
        "log_metadata": q_log_metadata,
        "generic_io": q_generic_io,
        "prefix_lookup_shuffled": q_prefix_lookup_shuffled,
        "log_scan_lines": q_log_scan_lines,
        "catalog_arrl_years": q_catalog_arrl_years,
        "catalog_arrl_links": q_catalog_arrl_links,
        "catalog_arrl_options": q_catalog_arrl_options,
        "catalog_cq_links": q_catalog_cq_links,
        "catalog_cq_options": q_catalog_cq_options,
        "log_table_far_page": q_log_table_far_page,
        "snr_grid_query": q_snr_grid_query,
        "snr_grid_template": q_snr_grid_template,
        "generic_csv": _q_generic("csv"),
        "generic_parquet": _q_generic("parquet"),
        **_rollup_queries(),
        "contest_modes": q_contest_modes,
        "transition_labels": q_transition_labels,
        "column_check": q_column_check,
        "score_page_after": q_score_page_after,
    }


def _dim_queries() -> dict[str, Query]:
    return {
        "weekends": q_weekends,
        "contest_dates": q_contest_dates,
        "prefix_lookup": q_prefix_lookup,
        "geo": q_geo,
        "log_scan": q_log_scan,
        "log_header": q_log_header,
        "catalog_calls": q_catalog_calls,
        "catalog_links": q_catalog_links,
        "catalog_pairs": q_catalog_pairs,
        "skip_existing": q_skip_existing,
        "store_reload": q_store_reload,
        "prefix": q_prefix,
        "log_table_page": q_log_table_page,
        "evolution_score_one_clock": q_evolution_score_one_clock,
        "heatmap_10_stepped": q_heatmap_10_stepped,
        "direction_12_36": q_direction_12_36,
        "band_conditions_na": q_band_conditions_na,
        "score_cqww_chunked": q_score_cqww_chunked,
        "log_table_cqww_chunked": q_log_table_cqww_chunked,
    }


def _spot_queries() -> dict[str, Query]:
    return {
        "spot_fill_cont": q_spot_fill_cont,
        "spot_clean": q_spot_clean,
        "band_conditions": q_band_conditions,
        "cw_speed": q_cw_speed,
        "spot_counts": q_spot_counts,
        "snr_mean": q_snr_mean,
        "closed_receivers": q_closed_receivers,
        "active_receivers": q_active_receivers,
        "snr_smooth": q_snr_smooth,
        "snr_grid": q_snr_grid,
        "snr_grid_5": q_snr_grid_5,
    }


def queries() -> dict[str, Query]:
    evolution = {f"evolution_{f}": _q_evolution(f) for f in EVOLUTION_FEATURES}
    return {
        **_activity_queries(), **evolution, **_base_queries(), **_spot_queries(), **_dim_queries(),
        **_open_queries(),
    }


def _activity_queries() -> dict[str, Query]:
    return {
        "contest_hour": q_contest_hour,
        "rate": q_rate,
        "rate_points": q_rate_points,
        "rolling_rate": q_rolling_rate,
        "log_table_cqww": _q_log_table("cqww"),
        "log_table_cqwpx": _q_log_table("cqwpx"),
        "log_table_iaru": _q_log_table("iaru"),
        "qsos_hour": q_qsos_hour,
        "qsos_hour_30": q_qsos_hour_30,
        "heatmap": q_heatmap,
        "heatmap_10": q_heatmap_10,
        "heatmap_pivot": q_heatmap_pivot,
        "frequency": q_frequency,
        "direction": q_direction,
        "prev_call": q_prev_call,
        "repeat_hist": q_repeat_hist,
    }


def _base_queries() -> dict[str, Query]:
    return {
        "band": q_band,
        "score_cqww": _q_score("cqww"),
        "summary_cqww": _q_summary("cqww"),
        "score_cqwpx": _q_score("cqwpx"),
        "summary_cqwpx": _q_summary("cqwpx"),
        "score_iaru": _q_score("iaru"),
        "summary_iaru": _q_summary("iaru"),
    }
