"""Longest-prefix lookup of callsigns in a country-prefix dimension.

All strings that begin with a prefix lie between it and the prefix followed by the greatest code point, so nested prefixes
cut the order of strings into disjoint ranges, each with one answer: from a prefix on, the prefix; from its end on, the
longest prefix around it, or none (``prefix_ranges``). A prepared dimension (``prepare_prefixes``) is that table of range starts with
their answers, written once. The distinct calls and the starts are sorted together, and a call takes the
answer of the last start before it. One plan serves dimensions and calls of any size: nothing is
broadcast by this module, and the rows of the table are joined to the answers by call, where Spark chooses by size.

The sort is cut by the first ``PIECE`` characters. Before its first start, a piece has the answer of the longest prefix that is shorter
than the piece's name and begins it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragchew.functions.callsign import callsign_chunk
from ragchew.session import materialize

ATTRS = ["country", "adif", "cqz", "ituz", "continent", "latitude", "longitude"]
# Characters that say which piece of the sorted order a string lies in.
PIECE = 2
# Greater than every character of a call or prefix.
LAST_CHAR = "\U0010FFFF"


def small_dimension(dim: DataFrame) -> DataFrame:
    """Materialise a dimension once in the checkpoint folder so every lookup
    join reads the same small leaf instead of re-deriving it."""
    return materialize(dim, "dimension")


def check_dimension(dim: DataFrame) -> None:
    """An entry listed twice would multiply the rows that match it, so it is an error."""
    row = dim.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("exact", "prefix").alias("distinct")).first()
    if row["n"] != row["distinct"]:
        raise ValueError(f"prefix dimension: {row['n'] - row['distinct']} entries are repeated or null")


def prefix_ranges(dim: DataFrame) -> DataFrame:
    """Starts of the disjoint ranges of all strings, and the ``prefix`` that answers from there on ('' for none).

    A prefix finds the one around it among its own beginnings: an equi-join of as many rows as the
    prefixes have characters."""
    entries = dim.where(~F.col("exact") & (F.length("prefix") > 0)).select("prefix")
    shorter = entries.select(F.col("prefix").alias("inner"), F.explode(F.transform(
        F.filter(F.sequence(F.lit(1), F.length("prefix")), lambda n: n < F.length("prefix")),
        lambda n: F.substring("prefix", F.lit(1), n))).alias("prefix"))
    around = shorter.join(entries, "prefix").groupBy("inner").agg(F.max_by("prefix", F.length("prefix")).alias("outer"))
    closing = entries.join(around, F.col("prefix") == F.col("inner"), "left").select(
        F.concat("prefix", F.lit(LAST_CHAR)).alias("start"), F.coalesce("outer", F.lit("")).alias("prefix"))
    return entries.select(F.col("prefix").alias("start"), "prefix").unionByName(closing)


@dataclass
class PrefixTable:
    """A dimension made ready for lookups: its exact and its short entries, and the range starts, with attributes."""

    exact: DataFrame
    short: DataFrame
    ranges: DataFrame
    piece: int


def prepare_prefixes(dim: DataFrame | PrefixTable, piece: int = PIECE) -> PrefixTable:
    """Check a dimension and write its ranges; a prepared one is returned as it is."""
    if isinstance(dim, PrefixTable):
        return dim
    dim = small_dimension(dim)
    check_dimension(dim)
    answer = F.struct(*ATTRS)
    plain = dim.where(~F.col("exact")).select("prefix", answer.alias("answer"))
    ranges = prefix_ranges(dim).join(plain, "prefix", "left").select("start", "answer")
    return PrefixTable(dim.where("exact").select(F.col("prefix").alias("__lk_call"), answer.alias("__exact")),
                       plain.where(F.length("prefix").between(1, piece - 1)), materialize(ranges, "prefix-ranges"), piece)


def answer_calls(calls: DataFrame, table: PrefixTable, plain_key: bool = False) -> DataFrame:
    """``calls`` (distinct rows with ``__lk_call``) that an entry matches, an exact one before a prefix, with its
    attributes as the struct ``__answer``."""
    key = F.col("__lk_call") if plain_key else callsign_chunk(F.col("__lk_call"))
    asked = calls.withColumns({"__at": key, "__piece": F.substring(key, 1, table.piece), "__asked": F.lit(1)})
    asked = asked.join(table.exact, "__lk_call", "left")
    begun = F.lit(None).cast(table.short.schema["answer"].dataType)
    for n in range(1, table.piece):  # a longer one wins
        short = table.short.where(F.length("prefix") == n).select(F.col("prefix").alias(f"__p{n}"), F.col("answer").alias(f"__a{n}"))
        # no entry is longer than the piece's name and begins it, so the name itself is left to its start
        asked = asked.join(short, (F.substring("__piece", 1, n) == F.col(f"__p{n}")) & (F.length("__piece") > n), "left").drop(f"__p{n}")
        begun = F.coalesce(F.col(f"__a{n}"), begun)
    asked = asked.withColumn("__begun", begun).drop(*[f"__a{n}" for n in range(1, table.piece)])
    # a start without an answer still ends the range before it
    found = F.struct(F.col("answer").alias("answer"))
    starts = table.ranges.select(F.col("start").alias("__at"), F.substring("start", 1, table.piece).alias("__piece"),
                                 F.lit(0).alias("__asked"), found.alias("__start"))
    both = asked.unionByName(starts, allowMissingColumns=True)
    within = Window.partitionBy("__piece").orderBy("__at", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__start", F.last("__start", ignorenulls=True).over(within)).where(F.col("__asked") == 1)
    answer = F.coalesce("__exact", F.when(F.col("__start").isNotNull(), F.col("__start.answer")).otherwise(F.col("__begun")))
    return both.select(*calls.columns, answer.alias("__answer")).where(F.col("__answer").isNotNull())


def lookup_call(df: DataFrame, call: Column | str, dim: DataFrame | PrefixTable,
                attrs: list[str] | None = None, out_prefix: str = "",
                plain_key: bool = False, piece: int = PIECE) -> DataFrame:
    """Attach the dimension attributes of the longest matching prefix.

    ``exact`` entries match the whole callsign and win over prefixes. Prefixes
    are matched against the location part of the call (suffixes such as /P
    removed; for ``F/EA3M`` the shorter chunk ``F``), or the call itself with ``plain_key``. No match gives nulls.
    The distinct calls (partial aggregates) are answered once (written) and joined back by call. Several lookups share
    one dimension by ``prepare_prefixes``.
    """
    call_c = F.col(call) if isinstance(call, str) else call
    calls = df.select(call_c.alias("__lk_call")).where(F.col("__lk_call").isNotNull()).distinct()
    found = materialize(answer_calls(calls, prepare_prefixes(dim, piece), plain_key), "lookup")
    return with_answers(df, call_c, found, attrs or ATTRS, out_prefix)


def with_answers(df: DataFrame, call: Column, found: DataFrame, attrs: list[str], out_prefix: str = "") -> DataFrame:
    """``df`` with the attributes of its calls' answers. Spark broadcasts the answers or splits skewed
    partitions, by their sizes."""
    side = found.select("__lk_call", *[F.col(f"__answer.{a}").alias(f"{out_prefix}{a}") for a in attrs])
    return df.withColumn("__lk_call", call).join(side, "__lk_call", "left").drop("__lk_call")


def fill_continents(spots: DataFrame, dim: DataFrame | PrefixTable) -> DataFrame:
    """Fill null ``de_cont`` / ``dx_cont`` from the ``*_pfx`` columns by
    looking up ``prefix || '1AA'``; unknown prefixes stay null.

    Only the distinct prefixes of spots that miss a continent are looked up
    (a partial aggregate), once for both ends; each end then is one join on
    the prefix. No hint: the prefixes are few beside the spots, and Spark
    broadcasts or shuffles them by their size. For a stream, call it on each micro-batch."""
    ends = F.array(*[F.when(F.col(f"{end}_cont").isNull(), F.col(f"{end}_pfx")) for end in ("de", "dx")])
    asked = (spots.select(F.explode(ends).alias("__pfx")).where(F.col("__pfx").isNotNull()).distinct()
             .select(F.concat(F.col("__pfx"), F.lit("1AA")).alias("__lk_call")))
    found = materialize(answer_calls(asked, prepare_prefixes(dim), plain_key=True), "lookup")
    out = spots
    for end in ("de", "dx"):
        missing = F.when(F.col(f"{end}_cont").isNull(), F.concat(F.col(f"{end}_pfx"), F.lit("1AA")))
        out = with_answers(out, missing, found, ["continent"], "__")
        out = out.withColumn(f"{end}_cont", F.coalesce(f"{end}_cont", "__continent")).drop("__continent")
    return out
