"""Audit of the filters of a corpus in every order (Lehmer-rank difference arrays).

A document is described by its mask, the set of filters it fails. In a given order of the filters it
goes at the step of the first filter of its mask. Orders that begin alike are neighbours when
orders are numbered lexicographically (their Lehmer rank), so the orders in which a mask goes at a step by a
filter form intervals of ranks: one for each beginning in which only the last filter is of the mask. The counts
of a mask are added at the start of each interval and taken off at its end; a prefix sum over the
ranks gives every order's totals. Documents are counted once, by (part, mask, labels); no document is looked at again
for an order.

Results for odd input. A null text counts as empty. A null part is the part ''. A row without id is never later than another, so
it never fails the filter of repeated texts, and no text is a repeat of its; rows of one id and one text are all first or none. A label
counts if any label row of the id says 1; rows without labels or id are neither good nor toxic. Repeated rows count as often as they
occur. An empty table has no parts, so no rows. Extra columns are not read; only the named columns are.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragchew.llm.common import materialize

SPACES = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "ABCDE"
REPEAT = "E"
MEASURES = ["n", "good", "toxic"]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that one text decides, by letter."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < 100,
        "B": 100 * distinct < 80 * n,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(MARKS),
    }


def bit(name: str, names: str) -> int:
    return 1 << names.index(name)


def lehmer_rank(order: tuple[str, ...], names: str) -> int:
    """Lexicographic rank of the first order of ``names`` that begins with ``order``."""
    left, rank = list(names), 0
    for name in order:
        rank += left.index(name) * factorial(len(left) - 1)
        left.remove(name)
    return rank


def removal_intervals(names: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders in which a document that fails
    just the filters of the mask goes at the step."""
    out = []
    for mask in range(1, 1 << len(names)):
        for step in range(1, len(names) + 1):
            for start in permutations(names, step):
                hit = [bool(mask & bit(f, names)) for f in start]
                if hit[-1] and not any(hit[:-1]):
                    low = lehmer_rank(start, names)
                    out.append((mask, step, low, low + factorial(len(names) - step)))
    return out


def fail_masks(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Counts of documents by (part, mask): ``n``, ``good``, ``toxic``.

    Texts travel as their digest. The first id of each text is a partial aggregate, and only first rows meet it again, on
    (digest, id), so a text with many copies is never one group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    checks = text_filters(F.col("text"))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                    text.alias("text"))
        .select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                sum((F.when(c, bit(k, LETTERS)).otherwise(0) for k, c in checks.items()), F.lit(0)).alias("mask"))
    )
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("is_first", F.lit(True))
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # a repeated row is counted, so one id is never a group of rows
    counted = rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    later = F.col("id").isNotNull() & F.col("is_first").isNull()
    return (
        counted.join(first, ["digest", "id"], "left").join(known, "id", "left")
        .withColumn("mask", F.col("mask") + F.when(later, bit(REPEAT, LETTERS)).otherwise(0))
        .groupBy("part", "mask").agg(F.sum("n").alias("n"),
                                     *[F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    )


def audit_orders(counts: DataFrame, names: str = LETTERS) -> DataFrame:
    """Totals of every order and step from the counts by (part, mask)."""
    spark = counts.sparkSession
    orders = ["".join(p) for p in permutations(names)]
    n_orders, n = len(orders), len(names)
    intervals = spark.createDataFrame(removal_intervals(names), "mask int, step int, low int, high int")
    ends = counts.join(F.broadcast(intervals), "mask").select(
        "part", "step", F.explode(F.array(
            *[F.struct(F.col(at).alias("rank"), *[(sign * F.col(m)).alias(m) for m in MEASURES])
              for at, sign in (("low", 1), ("high", -1))])).alias("e"),
    ).select("part", "step", "e.*")
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    # the cells, all zero, without a join: every part has each step and rank
    cells = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(n_orders - 1))).alias("rank"),
        *[F.lit(0).cast("long").alias(m) for m in MEASURES])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gone = (
        cells.unionByName(ends).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in MEASURES])
        .select("part", "step", "rank", *[F.sum(m).over(along).alias(m) for m in MEASURES])
        .where(F.col("rank") < n_orders)
        .withColumn("filter_order", F.array(*[F.lit(o) for o in orders])[F.col("rank")])
        .withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    )
    fails = (
        counts.select("part", "n", F.explode(F.array(*[
            F.struct(F.lit(f).alias("filter"), F.col("mask").bitwiseAND(bit(f, names)).alias("hit"),
                     (F.col("mask") == bit(f, names)).alias("only")) for f in names])).alias("f"))
        .groupBy("part", F.col("f.filter").alias("filter"))
        .agg(F.sum(F.when(F.col("f.hit") > 0, F.col("n")).otherwise(0)).alias("fails"),
             F.sum(F.when(F.col("f.only"), F.col("n")).otherwise(0)).alias("unique_fails"))
    )
    to_here = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (
        gone.join(fails, ["part", "filter"]).join(parts, "part")
        .withColumns({"kept": F.col("total") - F.sum("n").over(to_here),
                      "shapley": F.sum("n").over(Window.partitionBy("part", "filter"))})
        .select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", F.col("n").alias("removed"),
                (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
                F.col("toxic").alias("toxic_lost"), "shapley")
    )


def audit_filters(spark: SparkSession, docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Totals of the five filters in all 120 orders, for each part."""
    return audit_orders(materialize(fail_masks(docs, labels, part), "filter-masks"))
