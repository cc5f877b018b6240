"""Ingested rows are parsed once and written once; what else is asked of them is read back."""

import pytest
from pyspark.sql import functions as F

from ragchew.plans import ingest
from ragchew.sources import cabrillo, units

CONTEST = "'cqww' AS contest, 'cw' AS contest_mode, 2023 AS year"


@pytest.fixture
def written(monkeypatch):
    seen = []
    for module in (units, ingest, cabrillo):
        def keep(df, what, by=None, real=module.materialize):
            seen.append((what, set(df.columns)))
            return real(df, what, by)
        monkeypatch.setattr(module, "materialize", keep)
    return seen


def test_rows_of_a_unit_are_written_once(spark, tmp_path, written):
    rows = spark.sql(f"SELECT {CONTEST}, 'ST' || id % 3 AS mycall, id AS seq FROM range(30)")
    got = units.put(rows, f"{tmp_path}/t", {"__station": F.col("mycall")}, cluster_by=["mycall"])
    assert sorted(r["__station"] for r in got.collect()) == ["ST0", "ST1", "ST2"]
    assert not any("seq" in columns for _, columns in written)
    assert units.load(spark, f"{tmp_path}/t").count() == 30


def test_replaced_unit_with_a_column_of_another_type(spark, tmp_path):
    first = spark.sql(f"SELECT {CONTEST}, 'ST' || id % 40 AS mycall, id AS seq, id AS points FROM range(400)")
    again = spark.sql(f"SELECT {CONTEST}, 'ST1' AS mycall, id AS seq, CAST(7 AS INT) AS points, 'x' AS more FROM range(5)")
    for df in (first, again):
        units.put(df, f"{tmp_path}/t", {"__station": F.col("mycall")})
    back = units.load(spark, f"{tmp_path}/t")
    assert back.count() == 395 and back.where("mycall = 'ST1'").agg({"points": "sum"}).first()[0] == 35
    assert back.where("more = 'x'").count() == 5 and back.where("mycall <> 'ST1'").agg({"points": "sum"}).first()[0] == sum(
        i for i in range(400) if i % 40 != 1)


def test_spot_lines_are_parsed_once(spark, tmp_path, written):
    day = tmp_path / "d.csv"
    day.write_text("callsign,de_pfx,de_cont,freq,band,dx,dx_pfx,dx_cont,mode,db,date,speed,tx_mode\n"
                   "RX1,FA,EU,14000.0,20m,ST1,KA,NA,CQ,10,2023-11-25 00:01:00,24,CW\n\nRX2,FA,EU,x,20m,ST1,KA,NA,CQ,10,2023-11-25 00:01:00,24,CW\n")
    dim = spark.createDataFrame([("F", False, "France", 1, 14, 27, "EU", 46.0, 2.0)], "prefix string, exact boolean, country string, "
                                "adif int, cqz int, ituz int, continent string, latitude double, longitude double")
    got = ingest.ingest_spots_job(spark, [str(day)], dim, "cqww", "cw", 2023, store_path=f"{tmp_path}/s", rejects_path=f"{tmp_path}/r")
    assert [r.callsign for r in got.collect()] == ["RX1"]
    assert [(r.line_no, r.reason) for r in units.load(spark, f"{tmp_path}/r").collect()] == [(4, "unreadable_record")]
    assert [what for what, columns in written if columns & {"line", "db"}] == ["log-lines"]
