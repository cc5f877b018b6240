"""Weekend calendar and contest dates for any set of years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragchew.constants import CONTEST_RULES


def weekends(years: DataFrame, year_col: str = "year") -> DataFrame:
    """For every year, the Saturday/Sunday of each ISO week (weeks 1..53
    that exist), their months, whether the weekend is inside one month, the
    running number of full weekends within (month of Saturday, month of
    Sunday) in week order, and its maximum."""
    jan4 = F.make_date(F.col("year"), F.lit(1), F.lit(4))
    df = (years.select(F.col(year_col).cast("int").alias("year")).distinct()
          .withColumn("__monday1", F.date_sub(jan4, F.weekday(jan4)))
          .withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(53)))))
    sat = F.date_add("__monday1", (F.col("week") - 1) * 7 + 5)
    thu = F.date_add("__monday1", (F.col("week") - 1) * 7 + 3)
    df = df.where(F.year(thu) == F.col("year"))  # the ISO year has this week
    df = df.withColumns({"__sat": sat})
    df = df.withColumns({
        "saturday": F.to_timestamp_ntz(F.col("__sat").cast("string")),
        "sunday": F.to_timestamp_ntz(F.date_add("__sat", 1).cast("string")),
        "month_saturday": F.month("__sat"),
        "month_sunday": F.month(F.date_add("__sat", 1)),
    }).withColumn("is_full_weekend", F.col("month_saturday") == F.col("month_sunday"))
    grp = ["year", "month_saturday", "month_sunday"]
    w_run = (Window.partitionBy(*grp).orderBy("week")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("month_week_number",
                       F.sum(F.col("is_full_weekend").cast("int")).over(w_run))
    df = df.withColumn("month_max_week", F.max("month_week_number").over(Window.partitionBy(*grp)))
    return df.select("year", "week", "saturday", "sunday", "month_saturday", "month_sunday",
                     "is_full_weekend", "month_week_number", "month_max_week")


def contest_rules(spark: SparkSession) -> DataFrame:
    """The calendar rules (contest, mode, month, week; -1 = last)."""
    return spark.createDataFrame(CONTEST_RULES, "contest string, mode string, month int, week int")


def contest_dates(weekend_table: DataFrame, rules: DataFrame) -> DataFrame:
    """The n-th (or last) full weekend of the rule's month, per year."""
    full = weekend_table.where(F.col("is_full_weekend"))
    r = rules.select("contest", "mode", F.col("month").alias("month_saturday"),
                     F.col("week").alias("__rule_week"))
    j = full.join(F.broadcast(r), "month_saturday")
    nth = F.col("__rule_week")
    j = j.where(F.when(nth == -1, F.col("month_week_number") == F.col("month_max_week"))
                .otherwise(F.col("month_week_number") == nth))
    return j.select("contest", "mode", "year", "saturday", "sunday")


def contest_modes(rules: DataFrame) -> DataFrame:
    """Contests and their modes."""
    return rules.select("contest", "mode").distinct()
