"""Hand-worked micro tables for the operators."""

from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragchew.functions.callsign import callsign_prefix
from ragchew.functions.bands import add_band
from ragchew.operators import calendar
from ragchew.operators.rolling import rolling_sums
from ragchew.operators.scoring import score_logs
from ragchew.plans import activity, snr, tables

LOG = ["contest", "contest_mode", "year", "mycall"]


def _prefixes(spark):
    rows = [
        ("E", False, "SPAIN", 1, 14, 37, "EU", 40.0, -4.0),
        ("EA8", False, "CANARY", 2, 33, 36, "AF", 28.0, -15.0),
        ("K", False, "USA", 3, 5, 8, "NA", 40.0, -100.0),
        ("JA", False, "JAPAN", 4, 25, 45, "AS", 36.0, 138.0),
        ("F", False, "FRANCE", 5, 14, 27, "EU", 46.0, 2.0),
        ("EA3XYZ", True, "USA", 3, 5, 8, "NA", 40.0, -100.0),
    ]
    return spark.createDataFrame(rows, "prefix string, exact boolean, country string, adif int, "
                                       "cqz int, ituz int, continent string, latitude double, longitude double")


def _log(spark, rows, contest="cqww"):
    """rows: (mycall, seq, minute, frequency, call, zone, exchange)."""
    t0 = datetime(2023, 11, 25)
    data = [(contest, "cw", 2023, my, seq, freq, "CW", t0 + timedelta(minutes=m), 599, call, 599,
             14, zone, 1, 1, "14", exch, 0)
            for my, seq, m, freq, call, zone, exch in rows]
    return spark.createDataFrame(data, "contest string, contest_mode string, year int, mycall string, "
                                 "seq long, frequency int, mode string, datetime timestamp_ntz, "
                                 "myrst int, call string, rst int, myzone int, zone int, myserial int, "
                                 "serial int, myexchange string, exchange string, radio int")


@pytest.mark.parametrize("call,expected", [
    ("EA3M", "EA3"), ("F/EA3M", "F"), ("EA3M/P", "EA3"), ("K1ABC/QRP", "K1"),
    ("EA8/DL1ABC", "EA8"), ("VP2E/W1AW", "W1"), ("RA9/M", "RA9"), ("EA3M/PA1", "EA3MA1"),
    ("F/P", "F"),
])
def test_callsign_prefix(spark, call, expected):
    got = spark.createDataFrame([(call,)], "call string").select(callsign_prefix("call")).first()[0]
    assert got == expected


def test_band_edges(spark):
    df = spark.createDataFrame([(f,) for f in [28000, 28074, 28075, 1800, 1874, 1875, 7050]],
                               "frequency int")
    got = [(r.band, r.band_id) for r in add_band(df).collect()]
    assert got == [(10, 0), (10, 0), (-1, -1), (160, 5), (160, 5), (-1, -1), (40, 3)]


@pytest.mark.parametrize("strategy", ["per_log", "chunked"])
def test_cqww_first_occurrence_points_and_totals(spark, strategy):
    # EA3ABC (ES, EU) logs USA, Japan, Spain; a repeat on the same band is not valid
    rows = [
        ("EA3XYZ", 1, 0, 14010, "K1AA", 5, "5"),    # other continent: 3, new dxcc+zone
        ("EA3XYZ", 2, 1, 14011, "K1AA", 5, "5"),    # dupe: 0, no mult
        ("EA3XYZ", 3, 2, 7010, "K1AA", 5, "5"),     # new band: valid, 3, mults on 40
        ("EA3XYZ", 4, 3, 14012, "JA1AA", 25, "25"),  # 3, dxcc+zone
        ("EA3XYZ", 5, 4, 14013, "EA1AA", 14, "14"),  # same continent? mycall exact -> USA/NA
        ("EA3XYZ", 6, 5, 14099, "K2BB", 5, "5"),    # out of band (-1): valid on band -1
    ]
    out = score_logs(_log(spark, rows), "cqww", _prefixes(spark), strategy=strategy,
                     rows_per_chunk=2).orderBy("seq")
    r = out.collect()
    assert [x.is_valid for x in r] == [True, False, True, True, True, True]
    # mycall EA3XYZ is an exact entry -> USA, NA. K: same continent NA -> 2 (NA rule)
    assert [x.qso_points for x in r] == [2, 0, 2, 3, 3, 2]
    assert [x.is_dxcc for x in r] == [1, 0, 1, 1, 1, 1]
    assert [x.is_zone for x in r] == [1, 0, 1, 1, 1, 1]
    assert [x.cum_qso_points for x in r] == [2, 2, 4, 7, 10, 12]
    assert [x.cum_mult for x in r] == [2, 2, 4, 6, 8, 10]
    assert [x.diff_contest_score for x in r] == [0.0, 0.0, 12.0, 26.0, 38.0, 40.0]
    assert r[2].minutes_from_previous_call == 2.0
    assert r[2].band_transition_from_previous_call == "20 → 40"
    assert r[1].band_transition_from_previous_call == "-1 → 20"
    summary = {(x.band): x for x in tables.contest_summary(out, "cqww").collect()}
    assert summary[None].score == 12 * 10
    assert summary[None].qsos == 5 and summary[20].qsos == 3


def test_strategies_agree_on_fixture(spark, small_dir):
    from ragchew import fixtures as fx
    raw = fx.raw_logs(spark, small_dir)
    dim = fx.prefix_dimension(spark, small_dir)
    cols = ["seq", "is_valid", "qso_points", "cum_contest_score", "diff_contest_score",
            "minutes_from_previous_call", "hour"]
    a = score_logs(raw, "cqww", dim, strategy="per_log").select(*cols)
    b = score_logs(raw, "cqww", dim, strategy="chunked", rows_per_chunk=37).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("strategy", ["per_log", "chunked"])
def test_rolling_ties(spark, strategy):
    t0 = datetime(2023, 11, 25)
    mins = [0, 0, 0, 5, 5, 20]
    df = spark.createDataFrame(
        [("c", "m", 2023, "X", i + 1, t0 + timedelta(minutes=m)) for i, m in enumerate(mins)],
        "contest string, contest_mode string, year int, mycall string, seq long, datetime timestamp_ntz")
    out = rolling_sums(df, F.lit(1).cast("long"), {"r10": 10}, strategy=strategy)
    assert [r.r10 for r in out.orderBy("seq").collect()] == [1, 2, 3, 4, 5, 1]


@pytest.mark.parametrize("strategy", ["per_log", "chunked"])
def test_rolling_late_lines_and_null_times(spark, strategy):
    t0 = datetime(2023, 11, 25)
    mins = [0, 5, 30, 6, None, 31, 6]
    df = spark.createDataFrame(
        [("c", "m", 2023, "X", i + 1, None if m is None else t0 + timedelta(minutes=m))
         for i, m in enumerate(mins)],
        "contest string, contest_mode string, year int, mycall string, seq long, datetime timestamp_ntz")
    out = rolling_sums(df, F.lit(1).cast("long"), {"r10": 10, "r1": 1}, strategy=strategy)
    got = out.orderBy("seq").collect()
    assert [r.r10 for r in got] == [1, 2, 1, 3, None, 2, 4]
    assert [r.r1 for r in got] == [1, 1, 1, 1, None, 1, 2]


@pytest.mark.parametrize("alpha", [0.02, 0.3, 1.0])
def test_ewm_for_any_alpha(spark, alpha):
    vals = [float((i * 37) % 23) for i in range(600)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "k string, t int, db double")
    got = [r.db for r in snr.ewm_two_sided(df, ["k"], ["t"], alpha=alpha).orderBy("t").collect()]
    s = pd.Series(vals)
    both = (s.ewm(alpha=alpha).mean() + s.iloc[::-1].ewm(alpha=alpha).mean().iloc[::-1]) / 2
    assert got == pytest.approx(both.tolist(), rel=1e-10)
    for bad in (0.0, -0.1, 1.5):
        with pytest.raises(ValueError):
            snr.ewm_two_sided(df, ["k"], ["t"], alpha=bad)


def test_repeated_prefix_is_an_error(spark):
    from ragchew.operators.lookup import lookup_call
    dim = _prefixes(spark)
    calls = spark.createDataFrame([("K1AA",)], "call string")
    assert lookup_call(calls, "call", dim).count() == 1
    with pytest.raises(ValueError):
        lookup_call(calls, "call", dim.unionByName(dim))


def test_bins_start_at_the_first_midnight(spark):
    from ragchew.operators.timing import add_bin
    t0 = datetime(2023, 11, 25, 0, 3)
    times = [t0 + timedelta(minutes=m) for m in (0, 4, 11, 1440, 2000)]
    df = spark.createDataFrame([("c", "m", t) for t in times],
                               "contest string, contest_mode string, t timestamp_ntz")
    for width in (7, 25, 60):
        got = [r.b for r in add_bin(df, "b", "t", width, ["contest", "contest_mode"]).orderBy("t").collect()]
        want = pd.Series(times).dt.floor("D").min()
        assert got == [(want + pd.Timedelta(minutes=(t - want) // timedelta(minutes=width) * width)).to_pydatetime()
                       for t in times]


def test_centred_rolling_median(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 4, 2, 8, 3])],
                               "k string, t int, db double")
    got = [r.db for r in snr.centred_rolling_median(df, ["k"], "t", 4).orderBy("t").collect()]
    s = pd.Series([5, 1, 4, 2, 8, 3], dtype=float)
    expected = s.rolling(4, min_periods=1, center=True).median().tolist()
    assert got == pytest.approx(expected)


def test_two_sided_ewm_matches_pandas(spark):
    vals = [float((i * 37) % 23) for i in range(300)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "k string, t int, db double")
    got = [r.db for r in snr.ewm_two_sided(df, ["k"], ["t"]).orderBy("t").collect()]
    s = pd.Series(vals)
    fwd = s.ewm(alpha=0.3).mean()
    bwd = s.iloc[::-1].ewm(alpha=0.3).mean().iloc[::-1]
    assert got == pytest.approx(((fwd + bwd) / 2).tolist(), rel=1e-12)


def test_direction_bins(spark):
    rows = [("c", "m", 2023, "X", 1.0, h) for h in [0.0, 10.0, 10.0001, 360.0, 185.0]]
    df = spark.createDataFrame(rows, "contest string, contest_mode string, year int, mycall string, "
                                     "hour double, heading double").withColumn("call", F.lit("Z"))
    out = {r.heading_first: r.qsos for r in activity.qso_direction(df).collect()}
    assert len(out) == 36
    assert out[0.0] == 1 and out[10.0] == 1 and out[350.0] == 1 and out[180.0] == 1
    assert sum(out.values()) == 4


def _iso_weekends(year):
    rows = []
    for w in range(1, 54):
        try:
            sat = date.fromisocalendar(year, w, 6)
        except ValueError:
            continue
        rows.append((w, sat))
    return rows


def test_weekends_against_python_calendar(spark):
    years = spark.createDataFrame([(2021,), (2023,), (2026,)], "year int")
    got = calendar.weekends(years).collect()
    for y in (2021, 2023, 2026):
        mine = sorted((r.week, r.saturday.date()) for r in got if r.year == y)
        assert mine == _iso_weekends(y)


def test_nth_weekend(spark):
    years = spark.createDataFrame([(2023,)], "year int")
    rules = spark.createDataFrame([("x", "cw", 1, 2), ("cqww", "cw", 11, -1)],
                                  "contest string, mode string, month int, week int")
    got = {r.contest: (r.saturday.date(), r.sunday.date())
           for r in calendar.contest_dates(calendar.weekends(years), rules).collect()}
    assert got["x"] == (date(2023, 1, 14), date(2023, 1, 15))
    assert got["cqww"] == (date(2023, 11, 25), date(2023, 11, 26))


def test_summary_properties(spark, small_dir):
    from ragchew import registry
    s = registry.scored(spark, small_dir)
    summ = tables.contest_summary(s, "cqww")
    tot = {(r.year, r.mycall): r for r in summ.where(F.col("band").isNull()).collect()}
    last = (s.groupBy("year", "mycall").agg(F.max_by("cum_contest_score", "seq").alias("x"))
             .collect())
    for r in last:
        assert tot[(r.year, r.mycall)].score == r.x
    # sum of the total rows' points equals the points of all contacts
    pts = s.agg(F.sum("qso_points")).first()[0]
    assert sum(r.qso_points for r in tot.values()) == pts


def test_heatmap_total_and_percent(spark, small_dir):
    from ragchew import registry
    s = registry.scored(spark, small_dir)
    heat = activity.heatmap(s, 1)
    inside = s.where((F.col("hour") >= 0) & (F.col("hour") < 48)).count()
    assert heat.agg(F.sum("qsos")).first()[0] == inside
    sp = registry.spots(spark, small_dir)
    from ragchew.plans import spots as sp_plans
    cond = sp_plans.band_conditions(sp, "EU")
    sums = cond.groupBy("band", "continent", "year").agg(F.sum("percent").alias("p")).collect()
    assert all(abs(r.p - 100.0) < 1e-9 for r in sums)


def test_column_checks_and_paging(spark, small_dir):
    from ragchew import registry
    t = tables.contest_log(registry.scored(spark, small_dir), "cqww")
    tables.check_columns(t, tables.LOG_TABLE_COLUMNS["cqww"])
    with pytest.raises(ValueError):
        tables.check_columns(t.drop("call"), ["call"])
    p0 = tables.page(t, ["mycall", "year", "datetime", "call"], 0, 25).collect()
    p1 = tables.page(t, ["mycall", "year", "datetime", "call"], 1, 25).collect()
    assert len(p0) == 25 and len(p1) == 25 and p0[-1] != p1[0]


def test_fill_gaps(spark):
    t0 = datetime(2023, 11, 25)
    rows = [("c", "m", 2023, "ST0", 20, "EU", "RX1", t0 + timedelta(minutes=m), 7000, v)
            for m, v in [(0, 10.0), (20, 20.0), (30, 30.0), (60, 60.0)]]
    df = spark.createDataFrame(rows, "contest string, contest_mode string, year int, dx string, "
                               "band int, de_cont string, callsign string, datetime timestamp_ntz, "
                               "freq int, db double")
    out = snr.fill_gaps(df, ["contest", "contest_mode", "year", "dx", "band", "de_cont", "callsign"], 10)
    got = [(r.datetime.minute if r.datetime.hour == 0 else 60, r.db) for r in out.orderBy("datetime").collect()]
    # 10 -> (10+20)/2; 40 and 50 have a missing neighbour and are dropped
    assert got == [(0, 10.0), (10, 15.0), (20, 20.0), (30, 30.0), (60, 60.0)]


def test_time_helpers_ignore_session_time_zone(spark):
    from ragchew.functions import timecols
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        df = spark.createDataFrame([("2023-11-25 00:29:00",)], "s string").select(
            F.to_timestamp_ntz("s").alias("t"))
        r = df.select(timecols.minute_bin("t", 60).alias("b"),
                      timecols.dummy_clock(F.lit(1.5)).alias("d")).first()
        assert r.b == datetime(2023, 11, 25, 0, 0)
        assert r.d == datetime(2000, 1, 1, 1, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_contest_modes_listing(spark):
    modes = calendar.contest_modes(calendar.contest_rules(spark))
    got = sorted(tuple(r) for r in modes.collect())
    assert got == [("cqwpx", "cw"), ("cqwpx", "ssb"), ("cqww", "cw"), ("cqww", "ssb"), ("iaru", "mixed")]


def test_header_map_last_value_wins(spark):
    from ragchew.sources.cabrillo import header_map, log_lines, parse_header
    text = "CALLSIGN: EA3XYZ\nCLUB: A\nCLUB: B\nSOAPBOX: a: b\nQSO: x\n"
    lines = log_lines(spark.createDataFrame([("f", text)], "path string, value string"))
    m = header_map(parse_header(lines, ["path"]), ["path"]).first().meta_data
    assert m == {"CALLSIGN": "EA3XYZ", "CLUB": "B"}


def test_lookup_is_the_same_for_any_piece(spark):
    from ragchew.operators.lookup import lookup_call
    dim = _prefixes(spark)
    calls = spark.createDataFrame([("K1AA",), ("K1AA",), (None,), ("",), ("F/EA3M",), ("EA3M/P",), ("QQ9Z",), ("K",)],
                                  "call string")
    want, *others = (lookup_call(calls, "call", dim, piece=n) for n in (1, 2, 5))
    for got in others:
        assert want.columns == got.columns
        assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))


def test_prefix_ranges_against_every_prefix(spark):
    import random
    from ragchew.operators.lookup import ATTRS, lookup_call
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("AB1é") for _ in range(rnd.randint(1, n)))
    prefixes = sorted({word(4) for _ in range(60)})
    keys = sorted({word(6) for _ in range(400)} | set(prefixes) | {"", "Z", "A"})
    dim = spark.createDataFrame([(p, False, p) for p in prefixes] + [("A1", True, "=A1")], "prefix string, exact boolean, country string")
    dim = dim.select("*", *[F.lit(0).alias(a) for a in ATTRS if a != "country"])
    want = {k: max((p for p in prefixes if k.startswith(p)), key=len, default=None) for k in keys} | {"A1": "=A1"}
    for piece in (1, 2, 3):
        found = lookup_call(spark.createDataFrame([(k,) for k in keys], "call string"), "call", dim, plain_key=True, piece=piece)
        assert {r.call: r.country for r in found.collect()} == want


def test_ewm_passes_over_missing_values(spark):
    vals = [None, 3.0, None, None, 7.0, 1.0, None, 4.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "k string, t int, db double")
    got = [r.db for r in snr.ewm_two_sided(df, ["k"], ["t"], alpha=0.4).orderBy("t").collect()]
    s = pd.Series(vals, dtype=float)
    both = (s.ewm(alpha=0.4, ignore_na=True).mean()
            + s.iloc[::-1].ewm(alpha=0.4, ignore_na=True).mean().iloc[::-1]) / 2
    assert got == [None if x != x else pytest.approx(x, rel=1e-12) for x in both]


def test_page_after_walks_all_rows_once(spark):
    from ragchew.plans.tables import page_after
    rows = [(a, b) for a in (None, 1, 2) for b in (None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "a int, b int")
    got, last = [], None
    while part := [r.asDict() for r in page_after(df, ["a", "b"], last, 5).collect()]:
        got += [(r["a"], r["b"]) for r in part]
        last = part[-1]
    assert got == rows
