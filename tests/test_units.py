"""Tables of units: one rename changes them; jobs that stop, writers that meet, what is replaced and what stays."""

import pytest
from pyspark.sql import functions as F

from ragchew.registry import _scratch
from ragchew.sources import units

SCHEMA = "contest string, contest_mode string, year int, station string, v int"


def key():
    return {"__station": F.col("station")}


def frame(spark, *rows):
    return spark.createDataFrame([("cq", "a/b c", 2023, s, v) for s, v in rows], SCHEMA)


def content(spark, root, **where):
    return sorted((r.station, r.v) for r in units.load(spark, root, where).collect())


def test_units_are_added_and_replaced(spark):
    root = _scratch(spark, "units")
    assert not units.exists(spark, root) and units.stored_units(spark, root) is None
    units.put(frame(spark, ("x", 1), ("x", 2), ("y", 3)), root, key())
    units.put(frame(spark, ("z", 4)), root, key())
    units.put(frame(spark, ("x", 9)), root, key())
    assert content(spark, root) == [("x", 9), ("y", 3), ("z", 4)]
    assert content(spark, root, contest_mode="a/b c", year=2023) == content(spark, root)
    assert content(spark, root, year=[1999]) == []
    assert sorted(r["__station"] for r in units.stored_units(spark, root).collect()) == ["x", "y", "z"]
    # a named unit without rows is emptied
    units.put(frame(spark, ("z", 5)), root, key(), units=frame(spark, ("y", 0)).withColumns(key()))
    assert content(spark, root) == [("x", 9), ("z", 5)]
    assert sorted(r["__station"] for r in units.stored_units(spark, root).collect()) == ["x", "z"]
    assert sorted((r.station, r.v) for r in units.load(spark, root, number=1).collect()) == [("x", 1), ("x", 2), ("y", 3)]


def test_a_job_that_stops_between_the_writes_changes_nothing(spark, monkeypatch):
    root = _scratch(spark, "units")
    units.put(frame(spark, ("x", 1), ("y", 2)), root, key())

    def stop(*_):
        raise RuntimeError("stopped")
    with monkeypatch.context() as m:
        m.setattr(units, "_publish", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            units.put(frame(spark, ("x", 7), ("z", 8)), root, key())
    assert content(spark, root) == [("x", 1), ("y", 2)]
    units.put(frame(spark, ("x", 7), ("z", 8)), root, key())
    assert content(spark, root) == [("x", 7), ("y", 2), ("z", 8)]
    before = content(spark, root)
    assert units.vacuum(spark, root, keep=1) > 0
    assert content(spark, root) == before and units.vacuum(spark, root, keep=1) == 0


def test_of_two_writers_one_fails_cleanly(spark, monkeypatch):
    root = _scratch(spark, "units")
    units.put(frame(spark, ("x", 1), ("y", 2)), root, key())
    publish = units._publish

    def other_first(*args):
        monkeypatch.setattr(units, "_publish", publish)
        units.put(frame(spark, ("y", 5)), root, key())
        publish(*args)
    monkeypatch.setattr(units, "_publish", other_first)
    with pytest.raises(units.StoreConflict):
        units.put(frame(spark, ("x", 6)), root, key())
    assert content(spark, root) == [("x", 1), ("y", 5)]
    units.put(frame(spark, ("x", 6)), root, key())
    assert content(spark, root) == [("x", 6), ("y", 5)]


def test_first_writers_meet_too(spark, monkeypatch):
    root, publish = _scratch(spark, "units"), units._publish

    def other_first(*args):
        monkeypatch.setattr(units, "_publish", publish)
        units.put(frame(spark, ("y", 5)), root, key())
        publish(*args)
    monkeypatch.setattr(units, "_publish", other_first)
    with pytest.raises(units.StoreConflict):
        units.put(frame(spark, ("x", 6)), root, key())
    assert content(spark, root) == [("y", 5)]


def test_folders_of_a_bucket_are_merged(spark, monkeypatch):
    monkeypatch.setattr(units, "MAX_FOLDERS", 2)
    root = _scratch(spark, "units")
    for i in range(5):
        units.put(frame(spark, (f"s{i}", i)), root, key(), buckets=1)
    assert content(spark, root) == [(f"s{i}", i) for i in range(5)]
    assert len(units._folders(spark, root)) <= 2


def test_new_columns_are_null_in_older_rows(spark):
    root = _scratch(spark, "units")
    units.put(frame(spark, ("x", 1)), root, key())
    units.put(frame(spark, ("y", 2)).withColumn("note", F.lit("n")), root, key())
    units.put(frame(spark, ("x", 3)).withColumn("note", F.lit("m")), root, key())
    units.put(frame(spark, ("w", 4)), root, key())
    got = sorted((r.station, r.v, r.note) for r in units.load(spark, root).collect())
    assert got == [("w", 4, None), ("x", 3, "m"), ("y", 2, "n")]


def test_membership_reads_no_rows(spark):
    from ragchew.sources import store
    root = _scratch(spark, "units")
    df = spark.createDataFrame([("cqww", "cw", 2023, "EA1A", 1)], "contest string, contest_mode string, year int, mycall string, v int")
    store.add_partitioned(df, root, {store.STATION: F.col("mycall")})
    asked = spark.createDataFrame([("cqww", "cw", 2023, "EA1A"), ("cqww", "cw", 2024, "EA1A")],
                                  "contest string, contest_mode string, year int, mycall string")
    stored = store.stored_logs(spark, root)
    assert all("/units/" in f for f in stored.inputFiles())
    assert [tuple(r) for r in store.missing_logs(asked, stored).collect()] == [("cqww", "cw", 2024, "EA1A")]
    assert store.missing_logs(asked, stored, force=True).count() == 2
