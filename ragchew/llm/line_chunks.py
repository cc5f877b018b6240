"""Line deduplication by content-defined chunks of lines (DataFrame functions only).

A text is cut into lines, and runs of lines into chunks. A line is a cut where a rolling hash
over the hashes of the last ``WINDOW`` lines is divisible by ``DIVISOR``, or where it equals the two lines before it. Of cuts in a row
every other one ends a chunk, from the first on (a text's first line ends none, nor does the last but one), so that each chunk has two lines at least;
only a text of one line is a chunk of one. Boundaries thus depend on
the lines around them alone, and inserted or deleted lines shift no boundary further on than the next line that is no cut. A chunk of two or more
lines that occurs more than once, in one document or in several, is kept where it occurs
first (by doc_id, then by place) and removed elsewhere. Chunks are found by their hash and
removed only if their bytes are the same as those of the first occurrence.

Rows are grouped by chunk hash with partial sums; a chunk that a third of all documents share
is one row by the time it is shuffled, and its occurrences meet it in a join that Spark may split. Texts are
joined by sorting at every size, as what they are joined with grows with them.

Edge cases: null and empty texts have no lines and stay as they are (the kept text of null is empty); a text
without line ends is one line and is never removed; runs of equal lines are cut into pairs; repeated rows of one id count as one document after the other in
order of their text, equal ones being interchangeable; a null id comes first. Line ends are LF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragchew.llm.common import materialize

WINDOW = 3
DIVISOR = 4
BASE = 31
MODULUS = 2147483647


def line_hash(line: Column) -> Column:
    """28 bits of the MD5 of a line."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def cut(rows: DataFrame, text: str, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``rows`` with the chunks of a text column as an array of (n_lines, body), in column ``chunks``."""
    df = rows.withColumn("_l", F.split(text, "\n", -1)).withColumn("_h", F.transform("_l", line_hash))

    def rolling(i: Column) -> Column:
        value = F.lit(0).cast("long")
        for back in reversed(range(window)):
            value = (value * BASE + F.when(i >= back, F.get("_h", i - back)).otherwise(F.lit(0))) % MODULUS
        return value

    def cuts(i: Column) -> Column:
        same = (F.get("_h", i) == F.get("_h", i - 1)) & (F.get("_h", i) == F.get("_h", i - 2))
        return (rolling(i) % divisor == 0) | ((i >= 2) & F.coalesce(same, F.lit(False)))

    last = F.size("_l") - 1
    df = df.withColumn("_c", F.filter(F.sequence(F.lit(0), last), cuts))
    # places in the array of cuts where a row of cuts begins
    df = df.withColumn("_s", F.filter(F.transform("_c", lambda i, r: F.when(
        (r == 0) | (F.get("_c", r - 1) != i - 1), r)), lambda r: r.isNotNull()))

    def ends(r: Column, j: Column) -> Column:
        """Every other line of a row of cuts."""
        begin = F.get("_c", r)
        stop = begin + F.coalesce(F.get("_s", j + 1), F.size("_c")) - r - 1
        first = begin + F.when(begin == 0, 1).otherwise(0)
        return F.when(first <= stop, F.sequence(first, stop, F.lit(2))).otherwise(F.array().cast("array<int>"))

    df = df.withColumn("_e", F.concat(F.filter(F.flatten(F.transform("_s", ends)), lambda i: i < last - 1), F.array(last)))
    none = F.array().cast("array<struct<n_lines:int,body:string>>")
    return df.withColumn("chunks", F.when(F.col(text) == "", none).otherwise(F.transform(
        "_e", lambda e, k: _chunk(F.when(k > 0, F.get("_e", k - 1) + 1).otherwise(0), e)))).drop("_l", "_h", "_c", "_s", "_e")


def _chunk(first: Column, last: Column) -> Column:
    lines = F.slice("_l", first + 1, last - first + 1)
    return F.struct((last - first + 1).alias("n_lines"), F.array_join(lines, "\n").alias("body"))


KEY = ["_k", "_k0", "key"]


def repeated_chunks(base: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """For each row with repeated chunks: their places, the body that each must equal, and whether the place is where
    that body comes first. Only hashes are grouped; bodies are read for first occurrences alone."""
    hashed = cut(base, "_t", window, divisor).select(*KEY, F.transform(
        "chunks", lambda c: F.struct(c["n_lines"].alias("n"), F.xxhash64(c["body"]).alias("h"))).alias("c"))
    places = materialize(
        hashed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("c").alias("c"))
        .select(*KEY, "copies", F.posexplode("c").alias("place", "c")).where("c.n > 1")
        .select(*KEY, "copies", "place", "c.h"), "chunk-places")
    hot = places.groupBy("h").agg(
        F.sum("copies").alias("n"), F.min(F.struct((~F.col("_k0")).alias("named"), *KEY, "place")).alias("at")).where("n > 1")
    at = F.struct((~F.col("_k0")).alias("named"), *KEY, "place")
    met = materialize(places.join(hot.select("h", "at"), "h").select(
        *KEY, "place", "h", (at == F.col("at")).alias("first")), "chunk-met")
    wanted = met.where("first").groupBy(*KEY).agg(F.collect_list(F.struct("place", "h")).alias("want"))
    bodies = materialize(
        cut(base.join(wanted.hint("merge"), KEY), "_t", window, divisor).select("chunks", F.explode("want").alias("w")).select(
            "w.h", F.get("chunks", F.col("w.place"))["body"].alias("body")).dropDuplicates(["h"]), "chunk-bodies")
    return met.join(bodies, "h").groupBy(*KEY).agg(
        F.collect_list(F.struct("place", "first", "body")).alias("marks"))


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 divisor: int = DIVISOR) -> DataFrame:
    """Every row with its kept text: doc_id, n_lines, n_chunks, n_removed (chunks), n_removed_lines, text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.col(id_col).cast("long")
    base = docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit(0)).alias("_k"), ident.isNull().alias("_k0"),
                       F.xxhash64(text).alias("key"), text.alias("_t"))
    rows = cut(base.join(repeated_chunks(base, window, divisor).hint("merge"), KEY, "left"), "_t", window, divisor)
    # of equal rows, one keeps the first occurrences
    twice = materialize(base.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "chunk-twice")
    spare = F.lit(True) if twice.isEmpty() else F.row_number().over(W.partitionBy(*KEY).orderBy("key")) == 1
    rows = rows.withColumn("spare", spare).withColumn("out", F.transform(F.filter(
        F.coalesce("marks", F.array().cast("array<struct<place:int,first:boolean,body:string>>")),
        lambda m: ~(m["first"] & F.col("spare")) & (F.get("chunks", m["place"])["body"] == m["body"])),
        lambda m: m["place"]))
    rows = rows.withColumn("kept", F.filter("chunks", lambda c, i: ~F.array_contains("out", i)))

    def lines(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, c: s + c["n_lines"])
    return rows.select(
        "doc_id", lines(F.col("chunks")).alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"),
        F.size("out").cast("long").alias("n_removed"),
        (lines(F.col("chunks")) - lines(F.col("kept"))).alias("n_removed_lines"),
        F.array_join(F.transform("kept", lambda c: c["body"]), "\n").alias("text"))
