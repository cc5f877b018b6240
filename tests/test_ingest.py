"""G10 end to end: text logs -> parse -> score -> store, skip existing."""

from pyspark.sql import functions as F

from ragchew import fixtures as fx
from ragchew.operators.scoring import score_logs
from ragchew.plans.ingest import ingest_logs
from ragchew.registry import _scratch
from ragchew.sources import store


def test_ingest_logs_round_trip(spark, small_dir):
    raw = fx.raw_logs(spark, small_dir)
    text = fx.write_log_text(raw, _scratch(spark, "logtext"))
    dim = fx.prefix_dimension(spark, small_dir)
    target = _scratch(spark, "store")
    scored, rejects, header = ingest_logs(spark, text, "cqww", "cw", dim, store_path=target)
    assert rejects.count() == 0
    assert header.where(F.col("key") == "CALLSIGN").count() == raw.select("mycall", "year").distinct().count()
    direct = score_logs(raw, "cqww", dim)
    cols = ["year", "mycall", "datetime", "call", "is_valid", "qso_points", "cum_contest_score"]
    back = store.load_logs(spark, target).select(*cols)
    assert back.count() == direct.count()
    assert back.exceptAll(direct.select(*cols)).count() == 0
    # a second run finds every log stored and scores nothing
    again, _, _ = ingest_logs(spark, text, "cqww", "cw", dim, store_path=target)
    assert again.count() == 0


def test_spot_day_files_and_batch_ingest(spark, small_dir):
    from ragchew.plans.ingest import spot_day_files, ingest_spots_job
    from ragchew.sources import spots as spot_src
    root = _scratch(spark, "rbn")
    days = spot_day_files(spark, root, "cqww", "cw", [2023, 2024])
    assert days == [f"{root}/20231125.csv", f"{root}/20231126.csv",
                    f"{root}/20241123.csv", f"{root}/20241124.csv"]
    assert spot_day_files(spark, root, "iaru", "mixed", [2023]) == [f"{root}/20230708.csv",
                                                                     f"{root}/20230709.csv"]
    raw = fx.raw_spots(spark, small_dir).withColumn("tx_mode", F.lit("CW"))
    cols = [f.name for f in spot_src.RAW_SPOT_SCHEMA.fields]
    for day in days[:2]:
        raw.where(F.substring("date", 1, 10) == f"{day[-12:-8]}-{day[-8:-6]}-{day[-6:-4]}") \
           .select(*cols).write.option("header", "true").csv(day)
    dim = fx.prefix_dimension(spark, small_dir)
    target = _scratch(spark, "spot-store")
    out = ingest_spots_job(spark, days[:2], dim, "cqww", "cw", 2023, store_path=target)
    direct = spot_src.ingest_spots(fx.raw_spots(spark, small_dir), dim, "cqww", "cw", 2023)
    assert out.count() == direct.count()
    back = store.load_spots(spark, target, "cqww", "cw", [2023]).select(*spot_src.SPOT_COLUMNS)
    assert back.exceptAll(direct.select(*spot_src.SPOT_COLUMNS)).count() == 0
    assert ingest_spots_job(spark, days[:2], dim, "cqww", "ssb", 2023).count() == 0


def test_store_keeps_what_is_not_rewritten(spark, small_dir):
    raw = fx.raw_logs(spark, small_dir)
    dim = fx.prefix_dimension(spark, small_dir)
    target = _scratch(spark, "store")
    parts = [F.col("mycall") == "ST0", F.col("mycall") != "ST0"]
    texts = [fx.write_log_text(raw.where(p), _scratch(spark, "logtext")) for p in parts]
    first, _, _ = ingest_logs(spark, texts[0], "cqww", "cw", dim, store_path=target)
    one = first.count()
    assert one > 0
    second, _, _ = ingest_logs(spark, texts[1], "cqww", "cw", dim, store_path=target)
    assert first.count() == one  # still readable, still the same rows
    total = store.load_logs(spark, target).count()
    assert total == one + second.count() == score_logs(raw, "cqww", dim).count()
    # a forced repeat replaces only its own logs
    again, _, _ = ingest_logs(spark, texts[0], "cqww", "cw", dim, store_path=target, force=True)
    assert again.count() == one
    assert store.load_logs(spark, target).count() == total


def test_unreadable_store_is_not_taken_as_empty(spark, small_dir):
    import pytest
    raw = fx.raw_logs(spark, small_dir).where("mycall = 'ST0'")
    text = fx.write_log_text(raw, _scratch(spark, "logtext"))
    target = _scratch(spark, "store")
    spark.createDataFrame([("x",)], "value string").write.text(f"{target}/contest=cqww/contest_mode=cw/year=2023")
    with pytest.raises(Exception):
        ingest_logs(spark, text, "cqww", "cw", fx.prefix_dimension(spark, small_dir), store_path=target)


def test_headers_follow_their_file_read_in_blocks(spark, small_dir):
    """Files in one folder without log columns, each in several blocks: contacts have the header of their own file."""
    raw = fx.raw_logs(spark, small_dir)
    one, two = "ST0", "A1ZZ"
    raw = raw.withColumn("mycall", F.when(F.col("seq") % 3 == 0, one).otherwise(two))
    text = fx.write_log_text(raw, _scratch(spark, "logtext"))
    flat = _scratch(spark, "flat")
    for call in (one, two):
        spark.read.text(f"{text}/*/*/*/mycall={call}", wholetext=True).write.text(f"{flat}/{call}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        dim, target, heads = fx.prefix_dimension(spark, small_dir), _scratch(spark, "store"), _scratch(spark, "heads")
        scored, rejects, _ = ingest_logs(spark, f"{flat}/*", "cqww", "cw", dim, store_path=target, header_path=heads)
        assert rejects.count() == 0
        got = {(r.mycall, r.call) for r in scored.select("mycall", F.col("meta_data")["CALLSIGN"].alias("call")).distinct().collect()}
        assert got == {(one, one), (two, two)}
        assert scored.count() == score_logs(raw, "cqww", dim).count()
        rows = store.load_logs(spark, heads)
        assert {(r.mycall, r.key, r.value) for r in rows.collect()} >= {(one, "CALLSIGN", one), (two, "CONTEST", "CQ-WW-CW")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
