"""Stand-in inputs built from the driver's test tables (see FIXTURES.md).

These functions only shape rows into the schemas the jobs expect (raw contest
logs, raw spot files, the country-prefix dimension, index pages). They do none
of the jobs' work: bands, countries, scores, continents, ... are computed by the
library from these raw rows. Each builder has a DuckDB twin in ``SQL`` so the
oracle queries start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragchew.session import tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_SPLIT = 500_000


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The test tables are single-row-group files (one input split); spread
    the stand-in rows by their ``key`` as a multi-file input would arrive: over the session's parallelism, and
    over more splits where these would be of more than ``ROWS_PER_SPLIT`` rows. (By key, since dealing rows out in turn sorts them first.)"""
    return df.repartition(tasks_for(df.sparkSession, df.count(), ROWS_PER_SPLIT), *key)


def spark_dialect(sql: str) -> str:
    """The shared fragments use DuckDB's ``//``; Spark spells it ``div``."""
    return sql.replace("//", " div ")


# SQL fragments shared by the Spark builders (spark.sql dialect) and the
# DuckDB oracle. Only functions with the same meaning in both are used.
_CONTINENT_OF_NATION = (
    "CASE n_regionkey WHEN 0 THEN 'AF' "
    "WHEN 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'NA' ELSE 'SA' END "
    "WHEN 2 THEN 'AS' WHEN 3 THEN 'EU' ELSE 'OC' END"
)
_BAND_BASE = (
    "CASE (e.event_id // 3) % 6 WHEN 0 THEN 28000 WHEN 1 THEN 21000 WHEN 2 THEN 14000 "
    "WHEN 3 THEN 7000 WHEN 4 THEN 3500 ELSE 1800 END"
)
# The worked stations are the customers, as many as the table holds.
_CUSTKEY = "((v.event_id * 37 + v.event_id // 7 * 18) % (SELECT count(*) FROM customer))"


def _logs_select(minutes_expr: str) -> str:
    return f"""
    SELECT
      CAST(2023 + e.event_id % 2 AS INT) AS year,
      'ST' || CAST(e.user_id // 15 AS STRING) AS mycall,
      e.event_id AS seq,
      CAST({_BAND_BASE} + e.event_id % 90 AS INT) AS frequency,
      'CW' AS mode,
      CAST({minutes_expr} AS BIGINT) AS qso_minute,
      CAST(599 AS INT) AS myrst,
      CASE WHEN e.event_id % 50 = 0 THEN 'F/' ELSE '' END
        || chr(CAST(65 + c.c_nationkey AS INT)) || 'A'
        || CAST(c.c_custkey % 10 AS STRING)
        || chr(CAST(65 + c.c_custkey // 676 % 26 AS INT)) || chr(CAST(65 + c.c_custkey // 26 % 26 AS INT))
        || chr(CAST(65 + c.c_custkey % 26 AS INT))
        || CASE WHEN e.event_id % 50 = 1 THEN '/P' ELSE '' END AS call,
      CAST(599 AS INT) AS rst,
      CAST((e.user_id // 15) % 25 + 1 AS INT) AS myzone,
      CAST(c.c_nationkey + 1 + CASE WHEN e.event_id % 97 = 0 THEN 1 ELSE 0 END AS INT) AS zone,
      CAST(e.event_id % 100000 + 1 AS INT) AS myserial,
      CAST((e.event_id * 7) % 1000 + 1 AS INT) AS serial,
      CAST((e.user_id // 15) % 25 + 1 AS STRING) AS myexchange,
      CASE WHEN e.event_id % 11 = 0 THEN 'HQ' || CAST(c.c_custkey % 9 AS STRING)
           ELSE CAST(c.c_nationkey + 1 + CASE WHEN e.event_id % 97 = 0 THEN 1 ELSE 0 END AS STRING)
      END AS exchange,
      CAST(e.event_id % 2 AS INT) AS radio
    FROM (SELECT v.*, {_CUSTKEY} AS worked FROM events v) e JOIN customer c ON c.c_custkey = e.worked
    """


def raw_logs(spark: SparkSession, sf_dir: str, contest: str = "cqww",
             contest_mode: str = "cw") -> DataFrame:
    """Raw QSO rows of every log (one log per year x station).

    Columns: contest, contest_mode, year, mycall, seq, frequency, mode,
    datetime, myrst, call, rst, myzone, zone, myserial, serial, myexchange,
    exchange, radio. ``seq`` is the line order inside the log.
    """
    ev = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "event_id")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    ev.createOrReplaceTempView("__rc_events")
    cust.createOrReplaceTempView("__rc_customer")
    minutes = "timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01 00:00:00', e.ts) // 15"
    body = (_logs_select(minutes).replace("FROM events ", "FROM __rc_events ")
            .replace("FROM customer)", "FROM __rc_customer)").replace("JOIN customer ", "JOIN __rc_customer "))
    df = spark.sql(spark_dialect(body))
    start = F.when(F.col("year") == 2023, F.lit("2023-11-25")).otherwise(F.lit("2024-11-23"))
    df = df.withColumn(
        "datetime",
        F.to_timestamp_ntz(start) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("qso_minute")),
    )
    return df.select(
        F.lit(contest).alias("contest"), F.lit(contest_mode).alias("contest_mode"),
        "year", "mycall", "seq", "frequency", "mode", "datetime", "myrst", "call", "rst",
        "myzone", "zone", "myserial", "serial", "myexchange", "exchange", "radio",
    )


def prefix_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country-file stand-in: prefix -> country attributes.

    One- and two-letter prefixes per nation, some longer three-character
    prefixes mapped to another nation (longest match matters), and exact-call
    entries for the logging stations (``exact`` = true).
    """
    nation = table(spark, sf_dir, "nation")
    nation.createOrReplaceTempView("__rc_nation")
    ev = table(spark, sf_dir, "events").select("user_id")
    ev.createOrReplaceTempView("__rc_events_u")
    return spark.sql(spark_dialect(_PREFIXES_SQL.replace("FROM nation", "FROM __rc_nation")
                                   .replace("FROM events", "FROM __rc_events_u")))


_PREFIXES_SQL = f"""
WITH nat AS (
  SELECT n_nationkey AS n, n_name, {_CONTINENT_OF_NATION} AS continent FROM nation
),
entries AS (
  SELECT chr(CAST(65 + n AS INT)) AS prefix, false AS exact, n AS target FROM nat
  UNION ALL
  SELECT chr(CAST(65 + n AS INT)) || 'A', false, n FROM nat
  UNION ALL
  SELECT chr(CAST(65 + n AS INT)) || 'A0', false, (n + 7) % 25 FROM nat WHERE n % 2 = 0
  UNION ALL
  SELECT DISTINCT 'ST' || CAST(user_id // 15 AS STRING), true, CAST((user_id // 15) % 25 AS INT)
  FROM events
)
SELECT e.prefix, e.exact, t.n_name AS country, CAST(t.n + 1 AS INT) AS adif,
       CAST(t.n % 40 + 1 AS INT) AS cqz, CAST(t.n % 75 + 1 AS INT) AS ituz,
       t.continent,
       CAST((t.n * 13) % 160 - 80 AS DOUBLE) AS latitude,
       CAST((t.n * 29) % 360 - 180 AS DOUBLE) AS longitude
FROM entries e JOIN nat t ON t.n = e.target
"""

# Spot fixtures ---------------------------------------------------------------
_SPOT_BANDS = ("CASE l.l_partkey % 8 WHEN 0 THEN '10m' WHEN 1 THEN '15m' WHEN 2 THEN '20m' "
               "WHEN 3 THEN '40m' WHEN 4 THEN '80m' WHEN 5 THEN '160m' WHEN 6 THEN '6m' "
               "ELSE '70cm' END")
_DX_CONT = ("CASE l.l_orderkey % 5 WHEN 0 THEN 'EU' WHEN 1 THEN 'NA' WHEN 2 THEN 'AS' "
            "WHEN 3 THEN 'SA' ELSE 'AF' END")
# A prefix of a nation on the same continent as _DX_CONT (nations 3, 6, 2, 1, 0).
_DX_PFX = ("CASE l.l_orderkey % 5 WHEN 0 THEN 'DA' WHEN 1 THEN 'GA' WHEN 2 THEN 'CA' "
           "WHEN 3 THEN 'BA' ELSE 'AA' END")


def _spots_sql(dense: bool) -> str:
    rx = "l.l_suppkey // 10" if dense else "l.l_suppkey"
    rx_nation = "(l.l_suppkey // 10) % 25" if dense else "s.s_nationkey"
    dx = (f"CASE WHEN ({rx}) % 4 = 3 THEN 'ST0' ELSE 'ST' || CAST(l.l_orderkey % 5 AS STRING) END"
          if dense else "'ST' || CAST(l.l_orderkey % 5 AS STRING)")
    return f"""
    SELECT
      'RX' || CAST({rx} AS STRING) AS callsign,
      CAST(7000 + (l.l_partkey % 4) / 2.0 AS DOUBLE) AS freq,
      {_SPOT_BANDS} AS band,
      {dx} AS dx,
      'CW' AS mode,
      CAST(l.l_quantity AS INT) AS db,
      CAST((l.l_orderkey * 7919 + l.l_partkey * 31) % 172800 AS BIGINT) AS sec,
      CAST(18 + 2 * l.l_linenumber AS INT) AS speed,
      CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE {_CONTINENT_OF_NATION} END AS de_cont,
      CASE WHEN l.l_orderkey % 13 = 0 THEN NULL ELSE {_DX_CONT} END AS dx_cont,
      chr(CAST(65 + {rx_nation} AS INT)) || 'A' AS de_pfx,
      {_DX_PFX} AS dx_pfx
    FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
    JOIN nation ON n_nationkey = {rx_nation}
    """


def raw_spots(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Raw spot rows as they come in the daily CSV files (all columns text-typed
    as in the files: band like '20m', date 'yyyy-MM-dd HH:mm:ss').

    ``dense`` maps ten suppliers to one receiver (SNR-grid fixture)."""
    spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_partkey"
    ).createOrReplaceTempView("__rs_lineitem")
    for name in ("supplier", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"__rs_{name}")
    body = (_spots_sql(dense).replace("FROM lineitem", "FROM __rs_lineitem")
            .replace("JOIN supplier", "JOIN __rs_supplier").replace("JOIN nation", "JOIN __rs_nation"))
    df = spark.sql(spark_dialect(body))
    ts = F.to_timestamp_ntz(F.lit("2023-11-25")) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("sec"))
    return df.select(
        "callsign", "freq", "band", "dx", "mode", "db",
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("date"),
        "speed", "de_cont", "dx_cont", "de_pfx", "dx_pfx",
    )


# Faults of the damaged day files: column -> its text, shared by both dialects.
FAULTS = {
    "date": "CASE WHEN db % 10 = 3 AND speed = 20 THEN 'x' || date ELSE date END",
    "band": "CASE WHEN db % 10 = 4 THEN '?m' ELSE band END",
    "dx": "CASE WHEN db % 10 = 5 AND speed = 22 THEN NULL ELSE dx END",
    "speed": "CASE WHEN db % 10 = 6 AND speed = 24 THEN 'fast' ELSE CAST(speed AS STRING) END",
}


def damage(raw: DataFrame) -> DataFrame:
    """Spots with unreadable times, bands and numbers and missing stations; ``day`` is the file they are in."""
    return raw.withColumn("day", F.substring("date", 1, 10)).withColumns({c: F.expr(e) for c, e in FAULTS.items()})


# DuckDB twins ------------------------------------------------------------------

def sql_raw_logs(contest: str = "cqww", contest_mode: str = "cw") -> str:
    minutes = ("(epoch_us(e.ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 60000000 // 15")
    body = _logs_select(minutes)
    return f"""SELECT '{contest}' AS contest, '{contest_mode}' AS contest_mode, year, mycall, seq,
      frequency, mode,
      (CASE WHEN year = 2023 THEN TIMESTAMP '2023-11-25 00:00:00' ELSE TIMESTAMP '2024-11-23 00:00:00' END)
        + to_minutes(qso_minute) AS datetime,
      myrst, call, rst, myzone, zone, myserial, serial, myexchange, exchange, radio
    FROM ({body}) q"""


def sql_prefixes() -> str:
    return _PREFIXES_SQL


def sql_raw_spots(dense: bool = False) -> str:
    return f"""SELECT callsign, freq, band, dx, mode, db,
      strftime(TIMESTAMP '2023-11-25 00:00:00' + to_seconds(sec), '%Y-%m-%d %H:%M:%S') AS date,
      speed, de_cont, dx_cont, de_pfx, dx_pfx
    FROM ({_spots_sql(dense)}) q"""


# Text logs ---------------------------------------------------------------------
HEADER_LINES = [
    ("START-OF-LOG", "3.0"),
    ("CALLSIGN", None),  # the station's own call
    ("CONTEST", "CQ-WW-CW"),
    ("CATEGORY-OPERATOR", "SINGLE-OP"),
]


def write_log_text(raw: DataFrame, path: str, contest: str = "cqww") -> str:
    """Write each log of ``raw`` as one Cabrillo text file under
    ``path/contest=/contest_mode=/year=/mycall=/``: header lines, one QSO
    line per row in ``seq`` order, END-OF-LOG."""
    from ragchew.sources.cabrillo import format_qso_lines
    key = ["contest", "contest_mode", "year", "mycall"]
    qso = format_qso_lines(raw, contest).select(
        *key, F.lit(1).alias("__part"), F.col("seq").cast("long").alias("__ord"), "line")
    logs = raw.select(*key).distinct()
    head = []
    for i, (k, v) in enumerate(HEADER_LINES):
        value = F.col("mycall") if v is None else F.lit(v)
        head.append(logs.select(*key, F.lit(0).alias("__part"), F.lit(i).cast("long").alias("__ord"),
                                F.concat(F.lit(f"{k}: "), value).alias("line")))
    tail = logs.select(*key, F.lit(2).alias("__part"), F.lit(0).cast("long").alias("__ord"),
                       F.lit("END-OF-LOG:").alias("line"))
    allrows = qso
    for h in head:
        allrows = allrows.unionByName(h)
    allrows = allrows.unionByName(tail)
    # One text value per log (a log is one file, written by one task anyway).
    text = allrows.groupBy(*key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("__part", "__ord", "line"))),
        lambda x: x["line"]), "\n").alias("value"))
    text.write.mode("overwrite").partitionBy(*key).text(path)
    return path


# Index pages in the ARRL form, from the pages: page n is the page of contest
# number n, its plain anchors are log anchors.
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def arrl_year_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One anchor per page: the year 2000 + n % 25 with the number n."""
    n = F.col("page_id")
    html = F.concat(F.lit('<li><a href="publiclogs.php?eid=4&iid='), n.cast("string"), F.lit('">'),
                    (n % 25 + 2000).cast("string"), F.lit("</a></li>"))
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


def arrl_log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its anchors as log anchors (letters in capitals)."""
    html = F.regexp_replace(F.translate("html", _LOWER, _UPPER), '<A HREF="/([A-Z0-9]+)">',
                            '<a href="showpubliclog.php?q=$1" target="_new">')
    return table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("int").alias("iid"),
                                                html.alias("html"))


def cq_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in the CQ form: in capitals, with its plain anchors as year-mode anchors."""
    html = F.regexp_replace(F.translate("html", _LOWER, _UPPER), '<A HREF="/([A-Z0-9]+)">', '<a href="$1/">')
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
