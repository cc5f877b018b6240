"""Catalogue of available logs from fetched index pages.

The pages are a table (page id, url, html). All extraction is
``regexp_extract_all`` + ``explode`` per page, so it scales with the pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragchew.session import materialize
from ragchew.sources import units

# --- fixed values: the index-page patterns ---------------------------------
CQ_CALLSIGN_PATTERN = r">([A-Z0-9\/]+)<"
CQ_YEAR_MODE_PATTERN = r"href=\"(\w+)/\""
ARRL_YEAR_PATTERN = r"<a href=\"publiclogs.php\?eid=([0-9]+)&iid=([0-9]+)\">([0-9]+)<"
ARRL_CALL_PATTERN = r"<a href\=\"showpubliclog.php\?q\=(\w+)\" target\=\"_new\">([A-Z0-9\/]+)<"
# --- end of fixed values ------------------------------------------------------


def callsigns_from_pages(pages: DataFrame, pattern: str = CQ_CALLSIGN_PATTERN,
                         keep: list[str] | None = None) -> DataFrame:
    """S17 callsigns: every match, upper case, ``-`` read as ``/``."""
    keep = keep if keep is not None else ["page_id"]
    found = F.explode(F.regexp_extract_all(F.col("html"), F.lit(pattern), 1))
    out = pages.select(*keep, found.alias("callsign"))
    return out.withColumn("callsign", F.replace(F.upper("callsign"), F.lit("-"), F.lit("/")))


def year_modes_from_pages(pages: DataFrame, pattern: str = CQ_YEAR_MODE_PATTERN,
                          keep: list[str] | None = None) -> DataFrame:
    """S17 year-modes: link ``2023cw`` -> year '2023', mode 'cw' (``ph`` is
    read as ``ssb``)."""
    keep = keep if keep is not None else ["page_id"]
    found = F.explode(F.regexp_extract_all(F.col("html"), F.lit(pattern), 1))
    out = pages.select(*keep, found.alias("item"))
    return out.select(*keep, "item",
                      F.replace(F.substring("item", 5, 1 << 20), F.lit("ph"), F.lit("ssb")).alias("mode"),
                      F.substring("item", 1, 4).alias("year"))


def pairs_from_pages(pages: DataFrame, pattern: str, groups: dict[str, int],
                     keep: list[str] | None = None) -> DataFrame:
    """Several groups of the same pattern, matched together (one row per
    match, one column per group)."""
    keep = keep if keep is not None else ["page_id"]
    arrays = [F.regexp_extract_all(F.col("html"), F.lit(pattern), i).alias(name)
              for name, i in groups.items()]
    zipped = F.explode(F.arrays_zip(*arrays)).alias("__m")
    out = pages.select(*keep, zipped)
    return out.select(*keep, *[F.col(f"__m.{name}").alias(name) for name in groups])


def arrl_years(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """S18 years: (year, iid) of every contest-year anchor."""
    out = pairs_from_pages(pages, ARRL_YEAR_PATTERN, {"iid": 2, "year": 3}, keep)
    return out.withColumns({"iid": F.col("iid").try_cast("int"), "year": F.col("year").try_cast("int")})


def arrl_links(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """S18 logs: (callsign, link) of every log anchor."""
    out = pairs_from_pages(pages, ARRL_CALL_PATTERN, {"link": 1, "callsign": 2}, keep)
    return out.select(*(keep if keep is not None else ["page_id"]), "callsign", "link")


def arrl_options(year_pages: DataFrame, call_pages: DataFrame, contest: str) -> DataFrame:
    """S19, ARRL form: for every (year, iid), the logs of the page fetched for that
    ``iid``: callsign, q (the link), contest, year."""
    years = arrl_years(year_pages, keep=[])
    logs = arrl_links(call_pages, keep=["iid"])
    return (logs.join(years, "iid")
                .select("callsign", F.col("link").alias("q"), F.lit(contest).alias("contest"), "year"))


def stored_options(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                   force: bool = False) -> DataFrame:
    """The options kept at ``path``. They are built and written only where
    none are stored yet (a finished write leaves ``_SUCCESS``) or with ``force``."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if force or not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def all_options(year_mode_pages: DataFrame, callsign_pages: DataFrame, contest: str) -> DataFrame:
    """For every (year, mode) index page, its callsigns; pages are joined
    by ``page_key`` (the link item that names the callsign page)."""
    ym = year_modes_from_pages(year_mode_pages, keep=[])
    calls = callsigns_from_pages(callsign_pages, keep=["page_key"])
    return (calls.join(ym, calls["page_key"] == ym["item"])
                 .select("callsign", F.lit(contest).alias("contest"), "mode", "year"))


# S19 kept up to date --------------------------------------------------------------

PAGE_UNIT = "__page"


def refresh_options(spark: SparkSession, path: str, pages: DataFrame, parse: Callable[[DataFrame], DataFrame],
                    contest: str, page_key: str = "page_id", force: bool = False) -> DataFrame:
    """The options of all ``pages``, kept at ``path`` by page with a digest of the page's text. Only pages whose
    digest is new are parsed (all with ``force``), and replace what is kept of them; returns the options now kept.

    ``parse`` takes pages and returns rows with ``page_key``. A page without options keeps a row of its digest."""
    digests = pages.select(page_key, F.md5("html").alias("__digest")).distinct()
    changed = digests
    if units.exists(spark, path) and not force:
        known = units.load(spark, path, {"contest": contest}).select(page_key, "__digest").distinct()
        changed = digests.join(known, [page_key, "__digest"], "left_anti")
    changed = materialize(changed, "changed-pages")
    # the digests are many where most pages changed; Spark picks the join by size
    parsed = parse(pages.join(changed.select(page_key), page_key, "left_semi"))
    options = changed.join(parsed, page_key, "left").withColumn("contest", F.lit(contest))
    units.put(options, path, {PAGE_UNIT: F.col(page_key).cast("string")}, partitions=["contest"])
    return kept_options(spark, path, contest)


def kept_options(spark: SparkSession, path: str, contest: str) -> DataFrame:
    """The options kept for a contest."""
    rows = units.load(spark, path, {"contest": contest})
    given = [c for c in rows.columns if c not in ("contest", "__digest")][1:]
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c in given]).isNotNull()).drop("__digest")


def cq_options(pages: DataFrame) -> DataFrame:
    """S17, CQ form, page by page: the callsigns of a page beside the year-modes it links to, with the fixed patterns."""
    calls = callsigns_from_pages(pages, keep=["page_id"])
    return calls.join(year_modes_from_pages(pages, keep=["page_id"]), "page_id").select("page_id", "callsign", "mode", "year")
