"""Sources and sinks: generic formats, store loads, metadata rows, catalogue."""

import pytest
from pyspark.sql import functions as F

from ragchew import fixtures as fx
from ragchew.registry import _scratch
from ragchew.sources import catalog, files, store
from ragchew.sources.cabrillo import header_map, parse_header, log_lines, read_log_text


def test_generic_read_write_formats(spark, small_dir):
    df = fx.table(spark, small_dir, "nation")
    for fmt in ("parquet", "csv", "json", "orc"):
        path = _scratch(spark, f"fmt-{fmt}")
        files.write(df, fmt, path, header="true") if fmt == "csv" else files.write(df, fmt, path)
        back = files.read(spark, fmt, path, schema=df.schema,
                          process_result=lambda d: d.where(F.col("n_nationkey") < 10),
                          **({"header": "true"} if fmt == "csv" else {}))
        assert back.count() == 10
    with pytest.raises(NotImplementedError):
        files.read(spark, "pickle", "x")
    with pytest.raises(NotImplementedError):
        files.write(df, "pickle", "x")


def test_store_pairs_and_metadata(spark, small_dir):
    from ragchew import registry
    path = _scratch(spark, "store")
    store.write_partitioned(registry.scored_job(spark, small_dir), path, cluster_by=["mycall"])
    pairs = spark.createDataFrame([("st0", 2023), ("ST0", 2023)], "mycall string, year int")
    got = store.load_logs(spark, path, pairs=pairs)
    assert got.select("mycall", "year").distinct().collect() == [("ST0", 2023)]
    one = store.load_logs(spark, path, contest="cqww", contest_mode="cw", year=2024, callsign="st0")
    assert one.count() == got.count() or one.count() > 0
    text = fx.write_log_text(fx.raw_logs(spark, small_dir), _scratch(spark, "logtext"))
    lines = log_lines(read_log_text(spark, text).drop("path"))
    key = ["contest", "contest_mode", "year", "mycall"]
    rows = store.metadata_rows(header_map(parse_header(lines, key), key), key)
    assert rows.where(F.col("key") == "CONTEST").select("value").distinct().collect() == [("CQ-WW-CW",)]


def test_all_options_joins_pages(spark):
    year_pages = spark.createDataFrame(
        [(1, '<a href="2023cw/">x</a><a href="2022ph/">y</a>')], "page_id long, html string")
    call_pages = spark.createDataFrame(
        [("2023cw", "<td>EA3M</td><td>K1/AA</td><td>K2-BB</td>"), ("2022ph", "<td>DL1X</td>")],
        "page_key string, html string")
    got = sorted(tuple(r) for r in catalog.all_options(year_pages, call_pages, "cqww").collect())
    assert got == [("DL1X", "cqww", "ssb", "2022"), ("EA3M", "cqww", "cw", "2023"),
                   ("K1/AA", "cqww", "cw", "2023")]


def test_malformed_log_lines(spark):
    from ragchew.sources.cabrillo import parse_qso_lines
    text = ("START-OF-LOG: 3.0\nCALLSIGN: EA3XYZ\n"
            "QSO: 14025 CW 2023-11-25 0001 EA3XYZ 599 14 K1AA 599 5 0\r\n"
            "QSO: 14025 CW 2023-11-25 0002 EA3XYZ 599 14 K1AA 599\n"
            "X-QSO: 14025 CW 2023-11-25 0003 EA3XYZ 599 14 K2BB 599 5 0\n"
            "QSO:  7010   CW 2023-11-25 2359 EA3XYZ 599 14 JA1AA 599 25 1\n"
            "QSO: 7010 CW 2023-13-45 2359 EA3XYZ 599 14 JA1AA 599 25 1\n"
            "QSO: 7o10 CW 2023-11-25 2359 EA3XYZ 599 14 JA1AA 599 25 1\n"
            "QSO: 7010 CW 2023-11-25 2359 EA3XYZ 599 14 JA1AA 599 XX 1\n"
            "END-OF-LOG:\n")
    lines = log_lines(spark.createDataFrame([("a.log", text)], "path string, value string"))
    good, bad = parse_qso_lines(lines, "cqww")
    rows = sorted((r.seq, r.call, r.frequency, r.datetime) for r in good.collect())
    assert [(s, c, f) for s, c, f, _ in rows] == [(3, "K1AA", 14025), (6, "JA1AA", 7010)]
    # too few fields, an impossible date, an unreadable frequency or zone
    assert sorted(r.seq for r in bad.collect()) == [4, 7, 8, 9]
    hdr = {r.key: r.value for r in parse_header(lines, ["path"]).collect()}
    assert hdr == {"START-OF-LOG": "3.0", "CALLSIGN": "EA3XYZ"}


def test_lines_of_a_log_read_in_blocks(spark, small_dir):
    from ragchew.sources.cabrillo import read_log_lines
    path = fx.write_log_text(fx.raw_logs(spark, small_dir), _scratch(spark, "logtext"))
    key = ["contest", "contest_mode", "year", "mycall", "seq"]
    # a text value ends with a line break, after which the split has one more, empty line
    want = [tuple(r) for r in log_lines(read_log_text(spark, path).drop("path")).where("line <> ''")
            .orderBy(*key).select(*key, "line").collect()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = read_log_lines(spark, path)
        assert [tuple(r) for r in got.orderBy(*key).select(*key, "line").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stored_options_are_built_once_unless_forced(spark):
    path, built = _scratch(spark, "options"), []

    def build():
        built.append(1)
        return spark.range(len(built))
    assert catalog.stored_options(spark, path, build).count() == 1
    assert catalog.stored_options(spark, path, build).count() == 1
    assert catalog.stored_options(spark, path, build, force=True).count() == 2


def test_only_changed_pages_are_parsed(spark):
    path, seen = _scratch(spark, "options"), []

    def parse(pages):
        seen.append(sorted(r.page_id for r in pages.select("page_id").collect()))
        return catalog.callsigns_from_pages(pages)
    page = lambda *rows: spark.createDataFrame(list(rows), "page_id long, html string")
    options = lambda df: sorted((r.page_id, r.callsign) for r in df.collect())
    one = catalog.refresh_options(spark, path, page((1, ">EA1A<"), (2, ">K2-B<>K2/B<"), (3, "none")), parse, "cqww")
    assert options(one) == [(1, "EA1A"), (2, "K2/B")]
    two = catalog.refresh_options(spark, path, page((1, ">EA1A<"), (2, ">K9<"), (3, "none"), (4, ">DL1<")), parse, "cqww")
    assert options(two) == [(1, "EA1A"), (2, "K9"), (4, "DL1")]
    catalog.refresh_options(spark, path, page((1, ">EA1A<")), parse, "cqww", force=True)
    assert seen == [[1, 2, 3], [2, 4], [1]]
    assert catalog.refresh_options(spark, path, page((1, ">EA5<")), parse, "iaru").count() == 1
    assert options(catalog.kept_options(spark, path, "cqww")) == [(1, "EA1A"), (2, "K9"), (4, "DL1")]


def test_spot_lines_are_stored_or_rejected_with_a_reason(spark):
    from ragchew.sources import spots
    rows = ["heading", "RX1,EA,EU,7000.0,40m,ST1,K,NA,CW,10,2023-11-25 00:01:00,22,CW",
            "RX1,EA,EU,7000.0,40m,,K,NA,CW,10,2023-11-25 00:01:00,22,CW", "RX1,EA,EU,7000.0,70cm,ST1,K,NA,CW,10,2023-11-25 00:01:00,22,CW",
            "RX1,EA,EU,7000.0,m,ST1,K,NA,CW,10,2023-11-25 00:01:00,22,CW", "RX1,EA,EU,7000.0,40m,ST1,K,NA,CW,10,2023-11-25 25:01:00,22,CW",
            "RX1,EA,EU,seven,40m,ST1,K,NA,CW,10,2023-11-25 00:01:00,22,CW", "RX1,EA", "", "\"RX1\",EA,EU,7000.0,6m,ST1,K,NA,CW,,2023-11-25 00:01:00,22,CW"]
    path = f"{_scratch(spark, 'spot-lines')}/day"
    spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1).write.text(path)
    got = {r.line_no: r.reason for r in spots.mark_rejects(spots.read_spot_lines(spark, [path])).collect()}
    assert got == {2: None, 3: "no_station", 4: "band_not_in_metres", 5: "unreadable_band", 6: "unreadable_time",
                   7: "unreadable_record", 8: "unreadable_record", 10: None}
    assert spots.read_spot_lines(spark, [path], "ssb").count() == 0


def test_pages_of_a_table_are_its_order(spark):
    from ragchew.plans import tables
    df = spark.range(1000).selectExpr("id % 7 as a", "cast(null as int) as b", "id % 50 as c")
    path = _scratch(spark, "pages")
    tables.write_pages(df, ["a", "c"], path)
    want = [tuple(r) for r in df.orderBy("a", "c").collect()]
    got = []
    for n in range(0, 1000 // 33 + 1):
        got += [tuple(r) for r in tables.read_page(spark, path, n, 33).collect()]
    assert got == want
    assert tables.read_page(spark, path, 40, 33).count() == 0
    tables.write_pages(df.where("false"), ["a"], path)
    assert tables.read_page(spark, path, 0, 33).count() == 0
