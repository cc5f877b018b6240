"""What one task holds does not grow with the rows: their number of tasks does."""

import datetime as dt

import pytest

from ragchew import fixtures, session
from ragchew.operators import scoring
from ragchew.plans import activity, snr

DIM = [("F", False, "France", 1, 14, 27, "EU", 46.0, 2.0), ("K", False, "USA", 2, 5, 8, "NA", 37.0, -92.0),
       ("ST", False, "Spain", 3, 14, 37, "EU", 40.0, -4.0)]


def parts(df):
    return df.rdd.getNumPartitions()


@pytest.fixture(scope="module")
def scored(spark):
    mp = pytest.MonkeyPatch()
    mp.setattr(scoring, "CONTACTS_PER_TASK", 50)
    start = dt.datetime(2023, 11, 25)
    raw = [("cqww", "cw", 2023, f"ST{i % 90}", i, 14000 + i % 90, "CW", start + dt.timedelta(minutes=i % 2800), 599,
            f"{'FK'[i % 2]}A{i % 10}X", 599, 14, 14, 1, 1, "1", "1", 0) for i in range(1800)]
    logs = spark.createDataFrame(raw, "contest string, contest_mode string, year int, mycall string, seq long, frequency int, mode string, "
                                 "datetime timestamp_ntz, myrst int, call string, rst int, myzone int, zone int, myserial int, serial int, "
                                 "myexchange string, exchange string, radio int")
    dim = spark.createDataFrame(DIM, "prefix string, exact boolean, country string, adif int, cqz int, ituz int, continent string, "
                                "latitude double, longitude double")
    yield scoring.score_logs(logs, "cqww", dim)
    mp.undo()


def test_input_is_spread_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_PER_SPLIT", 100)
    out = fixtures.spread(spark.range(5000), "id")
    assert parts(out) == 50 and out.distinct().count() == 5000
    assert session.tasks_for(spark, 1, 100) == spark.sparkContext.defaultParallelism


def test_scored_logs(scored):
    assert parts(scored) == 36 and scored.count() == 1800


def test_zero_filled_grid(scored, monkeypatch):
    monkeypatch.setattr(activity, "CELLS_PER_TASK", 1000)
    out = activity.qsos_per_hour(scored)
    assert parts(out) == 31
    assert out.count() % 48 == 0 and out.agg({"qsos": "sum"}).first()[0] == 1800


def test_cells_of_the_grid(spark, monkeypatch):
    start = dt.datetime(2023, 11, 25)
    rows = [("cqww", "cw", 2023, f"RX{r}", 14000.0, 20, "ST0", "CQ", 10 + (r * 7 + m) % 20, 24, "EU", "EU", start + dt.timedelta(minutes=m))
            for r in range(20) for m in range(240)]
    spots = spark.createDataFrame(rows, "contest string, contest_mode string, year int, callsign string, freq double, band int, dx string, "
                                  "mode string, db int, speed int, de_cont string, dx_cont string, datetime timestamp_ntz")
    want = {r.datetime: r.db for r in snr.snr_grid(spots, ["ST0"], 2023).collect()}
    monkeypatch.setattr(snr, "CELLS_PER_TASK", 4)
    out = snr.snr_grid(spots, ["ST0"], 2023)
    assert "hashpartitioning(dx" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 120), REPARTITION_BY_NUM" in plan
    got = {r.datetime: r.db for r in out.collect()}
    assert len(got) == 24 and got == pytest.approx(want)
