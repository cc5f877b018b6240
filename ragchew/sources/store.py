"""The partitioned store of scored logs and spots.

``add_partitioned`` keeps a table of units (``sources/units.py``): single logs or days are added or replaced by one
rename, beside a small table of the units that are stored. ``write_partitioned`` writes a plain
partitioned table, ``contest=/contest_mode=/year=`` (dynamic overwrite of whole partitions). The loads read either. The station is an
ordinary column, so the number of files does not grow with the stations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragchew.constants import LOG_KEY, SPOT_KEY
from ragchew.sources import units
from ragchew.sources.units import PARTITIONS

# Name of the key column of a log's unit.
STATION = "__station"


def write_partitioned(df: DataFrame, path: str, cluster_by: list[str] | None = None) -> None:
    """Write whole partitions: each (contest, contest_mode, year) of ``df``
    replaces the stored one. To add to a partition use ``add_partitioned``.

    ``cluster_by`` (e.g. the station) hashes rows by partition + those
    columns before writing, so a station's log lands in one file while the
    write stays spread over many tasks; without it the rows are written from
    the tasks that hold them (never one task per contest-year)."""
    out = df.repartition(*PARTITIONS, *cluster_by) if cluster_by else df
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS).parquet(path))


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether the store has units. Folders of a plain table are an error: units cannot be replaced in them."""
    if units.exists(spark, path):
        return True
    if any(name.startswith(f"{PARTITIONS[0]}=") for name in units._names(spark, path)):
        raise ValueError(f"{path} is a plain partitioned table: put its rows into a new store with add_partitioned")
    return False


def add_partitioned(df: DataFrame, path: str, key: dict[str, Column],
                    cluster_by: list[str] | None = None, replaced: DataFrame | None = None) -> DataFrame:
    """Put the units of ``df`` into the store and leave every other unit as it is.

    A unit is a partition plus the ``key`` columns (a station for logs, a day for spots) and has no null key. Units that
    are stored already are replaced, those named in ``replaced`` also where ``df`` has no row of them. Writing
    the same units again changes nothing. Readers see the store before or after, and of two writers at once
    one fails (``units.StoreConflict``). Returns the units of ``df``."""
    is_stored(df.sparkSession, path)
    return units.put(df, path, key, cluster_by, replaced)


def _stored_rows(spark: SparkSession, path: str, where: dict | None = None) -> DataFrame:
    """All rows of a store or a plain table; of a store, only the folders of the partition values ``where`` are listed."""
    return units.load(spark, path, where) if units.exists(spark, path) else spark.read.parquet(path)


def load_logs(spark: SparkSession, path: str, contest: str | None = None,
              contest_mode: str | None = None, year: int | None = None,
              callsign: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Scored logs, pruned by partition values; ``pairs`` (mycall,
    year) keeps the asked station-years (callsigns upper case)."""
    asked = {"contest": contest, "contest_mode": contest_mode, "year": year}
    df = _stored_rows(spark, path, {c: v for c, v in asked.items() if v is not None})
    if contest is not None:
        df = df.where(F.col("contest") == contest)
    if contest_mode is not None:
        df = df.where(F.col("contest_mode") == contest_mode)
    if year is not None:
        df = df.where(F.col("year") == int(year))
    if callsign is not None:
        df = df.where(F.col("mycall") == callsign.upper())
    if pairs is not None:
        # no hint: Spark broadcasts the asked pairs if they are small
        df = df.join(pairs.select(F.upper("mycall").alias("mycall"), "year").distinct(),
                     ["mycall", "year"], "left_semi")
    return df


def load_spots(spark: SparkSession, path: str, contest: str, contest_mode: str,
               years: list[int] | None = None) -> DataFrame:
    """Spots of a contest for the given years (partition pruning)."""
    asked = {"contest": contest, "contest_mode": contest_mode, **({"year": years} if years else {})}
    df = (_stored_rows(spark, path, asked).where(F.col("contest") == contest)
          .where(F.col("contest_mode") == contest_mode))
    if years:
        df = df.where(F.col("year").isin([int(y) for y in years]))
    return df


def missing_logs(requested: DataFrame, stored: DataFrame | None, force: bool = False,
                 key: list[str] | None = None) -> DataFrame:
    """Requested logs that are not stored yet (all of them with
    ``force``). Keys compare upper-cased callsigns."""
    k = key or LOG_KEY
    req = requested.select(*k).distinct()
    if force or stored is None:
        return req
    return req.join(stored.select(*k).distinct(), k, "left_anti")


def stored_logs(spark: SparkSession, path: str, contest: str | None = None,
                contest_mode: str | None = None) -> DataFrame | None:
    """The keys of the stored logs, from the table of units: no contact is read. None for an empty store."""
    asked = {"contest": contest, "contest_mode": contest_mode}
    found = units.stored_units(spark, path, {c: v for c, v in asked.items() if v is not None}) if is_stored(spark, path) else None
    return None if found is None else found.select(*PARTITIONS, F.col(STATION).alias("mycall"))


def metadata_rows(headers: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The header map of every log as (key, value) rows."""
    k = key or LOG_KEY
    return headers.select(*k, F.explode("meta_data").alias("key", "value"))


__all__ = ["write_partitioned", "add_partitioned", "is_stored", "load_logs", "load_spots", "missing_logs", "metadata_rows", "stored_logs",
           "SPOT_KEY"]
