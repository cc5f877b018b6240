"""Contest logs in Cabrillo text.

One file per log. ``spark.read.text(wholetext=True)`` keeps a log in one row
(a log is one small file) and ``posexplode`` numbers its lines (``seq``);
``read_log_lines`` numbers the lines of files of any length. QSO
lines are split on whitespace and typed per contest, header lines become a
key/value map (last value of a key wins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragchew.session import materialize

# Field names after "QSO:" per contest (11 fields each).
QSO_FIELDS = {
    "cqww": ["frequency", "mode", "date", "time", "mycall", "myrst", "myzone", "call", "rst",
             "zone", "radio"],
    "cqwpx": ["frequency", "mode", "date", "time", "mycall", "myrst", "myserial", "call", "rst",
              "serial", "radio"],
    "iaru": ["frequency", "mode", "date", "time", "mycall", "myrst", "myexchange", "call", "rst",
             "exchange", "radio"],
}
# Numbers that the scores depend on; reports and serial numbers may be unreadable (null).
NEEDED_NUMBERS = {"frequency", "zone"}
INT_FIELDS = {"frequency", "myrst", "rst", "radio", "myzone", "zone", "myserial", "serial"}


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, one row per log: ``value`` (text) and ``path`` plus any
    partition columns found in the folder names."""
    return (spark.read.text(path, wholetext=True)
            .withColumn("path", F.input_file_name()))


def log_lines(texts: DataFrame) -> DataFrame:
    """Every line with its 1-based line number ``seq``."""
    keep = [c for c in texts.columns if c != "value"]
    return texts.select(*keep, F.posexplode(F.split(F.col("value"), "\n")).alias("__pos", "line")) \
                .select(*keep, (F.col("__pos") + 1).cast("long").alias("seq"),
                        F.regexp_replace("line", "\r$", "").alias("line"))


def read_log_lines(spark: SparkSession, path: str | list[str], columns: dict[str, Column] | None = None) -> DataFrame:
    """The lines of every log, read line by line: the same rows as
    ``log_lines(read_log_text(...))``, for logs too long for one row.

    A file may be read in several blocks by several tasks. Ids that rise
    within a block place its lines (no line is dropped before they are given);
    the lines of the earlier blocks of the file, summed from one small row a
    block, are added. The numbered lines are written once, as such ids hold
    only within one reading; ``columns`` (expressions over ``line``) are written with them."""
    raw = spark.read.option("lineSep", "\n").text(path)
    keep = [c for c in raw.columns if c != "value"]
    raw = raw.select(*keep, F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("__block"),
                     F.monotonically_increasing_id().alias("__id"),
                     F.regexp_replace("value", "\r$", "").alias("line"))
    lines = materialize(raw.withColumns(columns or {}), "log-lines")
    before = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (lines.groupBy("path", "__block")
              .agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    seq = (F.col("__before") + F.col("__id") - F.col("__first") + 1).cast("long")
    return (lines.join(blocks.drop("__n"), ["path", "__block"])
                 .select(*keep, "path", seq.alias("seq"), "line", *(columns or {})))


def parse_qso_lines(lines: DataFrame, contest: str) -> tuple[DataFrame, DataFrame]:
    """S3 + S5/S6/S7: (typed QSO rows, rejected lines). A QSO line starts
    with ``QSO:`` and has exactly 11 whitespace-separated fields after it, a
    readable time, frequency and (CQWW) zone; any other QSO line is rejected."""
    names = QSO_FIELDS[contest]
    # the fields of the line win over same-named columns (e.g. folder names)
    keep = [c for c in lines.columns if c != "line" and c not in names]
    qso = lines.where(F.col("line").rlike("^QSO:"))
    qso = qso.withColumn("__f", F.split(F.trim(F.regexp_replace("line", "^QSO:", "")), r"\s+"))
    fields = {n: F.get(F.col("__f"), i) for i, n in enumerate(names)}
    when = F.try_to_timestamp(F.concat_ws(" ", fields.pop("date"), fields.pop("time")),
                              F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz")
    cols = {n: v.try_cast("int") if n in INT_FIELDS else v for n, v in fields.items()}
    typed = qso.select(*keep, "line", (F.size("__f") == len(names)).alias("__whole"),
                       *[v.alias(n) for n, v in cols.items()], when.alias("datetime"))
    readable = F.col("__whole")
    for n in ["datetime", *[n for n in cols if n in NEEDED_NUMBERS]]:
        readable = readable & F.col(n).isNotNull()
    good = typed.where(readable).drop("line", "__whole")
    return good, typed.where(~readable).select(*keep, "line")


def parse_header(lines: DataFrame, log_key: list[str]) -> DataFrame:
    """Header lines (no ``QSO:``) that split on ": " into exactly two
    parts -> (key, value); the last occurrence of a key wins."""
    meta = lines.where(~F.col("line").contains("QSO:"))
    parts = F.split(F.col("line"), ": ")
    meta = meta.where(F.size(parts) == 2).select(
        *log_key, "seq", F.get(parts, 0).alias("key"), F.get(parts, 1).alias("value"))
    return meta.groupBy(*log_key, "key").agg(F.max_by("value", "seq").alias("value"))


def header_map(header: DataFrame, log_key: list[str]) -> DataFrame:
    """One row per log with its header as ``MAP<STRING,STRING>``."""
    return header.groupBy(*log_key).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta_data"))


def format_qso_lines(raw: DataFrame, contest: str) -> DataFrame:
    """Inverse of ``parse_qso_lines`` for one QSO per row: the Cabrillo line."""
    names = QSO_FIELDS[contest]
    fields = []
    for n in names:
        if n == "date":
            fields.append(F.date_format("datetime", "yyyy-MM-dd"))
        elif n == "time":
            fields.append(F.date_format("datetime", "HHmm"))
        else:
            fields.append(F.col(n).cast("string"))
    return raw.withColumn("line", F.concat_ws(" ", F.lit("QSO:"), *fields))


__all__ = ["read_log_text", "read_log_lines", "log_lines", "parse_qso_lines", "parse_header", "header_map",
           "format_qso_lines"]
