"""Callsign prefix, and the location chunk used by the country lookup."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragchew.constants import CALL_SUFFIXES


def callsign_chunk(call: Column | str) -> Column:
    """Suffixes removed literally (in order, anywhere), split on '/', and the
    single chunk or the shorter of the first two (a tie takes the second)."""
    c = F.col(call) if isinstance(call, str) else call
    for suffix in CALL_SUFFIXES:
        c = F.replace(c, F.lit(suffix), F.lit(""))
    parts = F.split(c, "/")
    first = F.get(parts, 0)
    second = F.get(parts, 1)
    return (
        F.when(F.size(parts) == 1, first)
        .when(F.length(first) < F.length(second), first)
        .otherwise(second)
    )


def callsign_prefix(call: Column | str) -> Column:
    """Greedy ``(.*\\d)`` of the chunk, or the chunk when it has no digit."""
    chunk = callsign_chunk(call)
    found = F.regexp_extract(chunk, r"(.*\d)", 1)
    return F.when(found == "", chunk).otherwise(found)


def add_prefix(df, call: str = "call"):
    return df.withColumn("prefix", callsign_prefix(call))
