"""Ingest jobs (text logs and spot files -> partitioned store)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragchew.constants import LOG_KEY
from ragchew.operators.calendar import contest_dates, contest_rules, weekends
from ragchew.operators.scoring import score_logs
from ragchew.session import materialize
from ragchew.sources import cabrillo, spots as spot_src, store


def ingest_logs(spark: SparkSession, text_path: str, contest: str, contest_mode: str,
                prefixes: DataFrame, store_path: str | None = None, force: bool = False,
                header_path: str | None = None):
    """Cabrillo files under ``text_path`` (one file per log, folders
    ``year=/mycall=`` or any layout), read line by line -> parsed QSOs (S3, S5-S7) -> scored
    (G5) -> put into the store (S14), each contact with the header of its file as the map ``meta_data`` (S4).

    The headers are a dimension of one row per file, joined by file after the scoring. With ``header_path`` they are also
    stored as (key, value) rows (S15), replaced with their log.
    Logs already in the store are skipped unless ``force`` (S16), which
    replaces them; other stored logs stay as they are.
    Returns (scored rows, rejected lines, header rows); with a store, the
    scored rows are the logs of this run as the store now has them."""
    lines = cabrillo.read_log_lines(spark, text_path)
    qso, rejects = cabrillo.parse_qso_lines(lines, contest)
    qso = qso.withColumns({"contest": F.lit(contest), "contest_mode": F.lit(contest_mode),
                           "mycall": F.upper("mycall")})
    if "year" not in qso.columns:
        qso = qso.withColumn("year", F.year("datetime"))
    if store_path is not None:
        qso = materialize(qso, "qso-lines")  # asked for keys, calls and contacts
    file_key = [c for c in lines.columns if c not in ("seq", "line")]
    header = cabrillo.parse_header(lines, file_key)
    files = cabrillo.header_map(header, ["path"])
    none = F.create_map().cast("map<string,string>")

    def with_header(df: DataFrame) -> DataFrame:
        return df.join(files, "path", "left").withColumn("meta_data", F.coalesce("meta_data", none))

    if store_path is None:
        return with_header(score_logs(qso, contest, prefixes)), rejects, header
    # written before the store changes, since it is read again after that
    todo = materialize(store.missing_logs(qso, store.stored_logs(spark, store_path, contest, contest_mode), force),
                       "logs-to-ingest")
    wanted = qso.join(todo, LOG_KEY, "left_semi")
    scored = with_header(score_logs(wanted, contest, prefixes))
    unit = {store.STATION: F.col("mycall")}
    if header_path is not None:
        rows = store.metadata_rows(with_header(wanted.select(*LOG_KEY, "path").distinct()), [*LOG_KEY, "path"])
        store.add_partitioned(rows, header_path, unit, replaced=todo.withColumns(unit))
    store.add_partitioned(scored, store_path, unit, cluster_by=["mycall"], replaced=todo.withColumns(unit))
    back = store.load_logs(spark, store_path, contest, contest_mode)
    return back.join(todo, LOG_KEY, "left_semi"), rejects, header


def spot_day_files(spark: SparkSession, root: str, contest: str, contest_mode: str,
                   years: list[int]) -> list[str]:
    """Day files ``<root>/YYYYMMDD.csv`` of the contest weekends (G7). The
    dates are a handful per year: the list is small by construction."""
    ydf = spark.createDataFrame([(int(y),) for y in years], "year int")
    rules = contest_rules(spark).where((F.col("contest") == contest)
                                       & (F.col("mode") == contest_mode))
    dates = contest_dates(weekends(ydf), rules)
    days = dates.select(F.explode(F.array(F.to_date("saturday"), F.to_date("sunday"))).alias("d"))
    return [f"{root.rstrip('/')}/{r.d.strftime('%Y%m%d')}.csv" for r in days.collect()]


def ingest_spots_job(spark: SparkSession, files: list[str], prefixes: DataFrame, contest: str,
                     contest_mode: str, year: int, store_path: str | None = None,
                     rejects_path: str | None = None) -> DataFrame:
    """Spot day files -> continents filled (J7) -> cleaned (P10) ->
    days put into the store, other stored days left as they are (S14).
    Phone contests have no spots. Every line that is not stored is a reject with its file, line number and
    reason (``spots.mark_rejects``); with ``rejects_path`` they are kept there, replaced with their file. With a store,
    returns its rows of these days."""
    marked = spot_src.mark_rejects(spot_src.read_spot_lines(spark, files, contest_mode))  # read and parsed once, written
    good = marked.where(F.col("reason").isNull()).drop("path", "line_no", "line", "reason")
    key = {"contest": F.lit(contest), "contest_mode": F.lit(contest_mode), "year": F.lit(int(year))}
    if rejects_path is not None:
        bad = marked.where(F.col("reason").isNotNull()).select("path", "line_no", "line", "reason").withColumns(key)
        read = marked.select("path").distinct().withColumns({**key, "__file": F.col("path")})
        store.add_partitioned(bad, rejects_path, {"__file": F.col("path")}, replaced=read)
    out = spot_src.ingest_spots(good, prefixes, contest, contest_mode, year)
    if store_path is None:
        return out
    day = {"__day": F.to_date("datetime")}
    days = store.add_partitioned(out, store_path, day)
    back = store.load_spots(spark, store_path, contest, contest_mode, [year]).withColumns(day)
    return back.join(days, [*store.PARTITIONS, *day], "left_semi").drop(*day)
