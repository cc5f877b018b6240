"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragchew.session import checkpoint_dir, materialize

__all__ = ["checkpoint_dir", "expand_copies", "free_name", "let", "materialize", "pack", "text_batches", "tidy_id", "uniform"]

SPACES = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (columns compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def uniform(*cols) -> Column:
    """A reproducible number in [0, 1) that depends on ``cols`` only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def expand_copies(df: DataFrame, count: str, number: str, chunk: int = 65536) -> DataFrame:
    """``count`` rows for each row, numbered from 0 in ``number``; rows with a
    count of 0 go. Two explodes, so that no array is longer than ``chunk``."""
    hi = f"{number}_hi"
    n = F.col(count)
    return (
        df.where(n > 0)
        .withColumn(hi, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / chunk))))
        .withColumn(number, F.explode(F.sequence(
            F.col(hi) * chunk, F.least(n, (F.col(hi) + 1) * chunk) - 1)))
        .drop(hi)
    )


def pack(docs: DataFrame, keep: list[str]):
    """``docs`` as the columns ``keep`` (those it has) and one struct ``rest`` of all others, so that columns an operator adds
    meet no other name; and the way back to the columns of ``docs``, untouched and in order."""
    kept = [c for c in docs.columns if c in keep]
    others = [c for c in docs.columns if c not in keep]
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if others else []
    packed = docs.select(*[F.col(f"`{c}`") for c in kept], *rest)

    def unpack(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") if c in kept else F.col("rest").getField(c).alias(c) for c in docs.columns])

    return packed, unpack


def tidy_id(col: str = "doc_id") -> list[Column]:
    """An id as two columns without nulls, for joins: the id, and whether it was null."""
    return [F.coalesce(F.col(col).cast("long"), F.lit(0).cast("long")).alias("k1"),
            F.col(col).isNull().cast("int").alias("k0")]


def text_batches(batches: Iterator[pa.RecordBatch], column: str,
                 limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``limit`` bytes of text each (one row at least), so
    that what a task holds does not depend on the length of the texts."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
        start = 0
        while start < n:
            base = size[start - 1] if start else 0
            end = int(np.searchsorted(size, base + limit, side="right"))
            end = min(n, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end
