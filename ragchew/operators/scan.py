"""Order-dependent scans over a log that stay correct when one log is huge.

* ``first_occurrence``: the row holding the smallest ``seq`` of each key is a
  partial aggregate (map-side combine), so a hot key never lands whole in one
  task; the flags join back on the unique row key ``(log, seq)``.
* ``chunked_running``: running sums in ``seq`` order. Rows are split into
  chunks of ``seq`` values; each chunk is a bounded window, and the chunk
  totals (tiny) give every chunk its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragchew.constants import ROWS_PER_CHUNK


CHUNK = "__chunk"


def add_chunk(df: DataFrame, order: str = "seq", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Tag rows with their chunk of ``order`` values."""
    return df.withColumn(CHUNK, F.floor(F.col(order) / F.lit(rows_per_chunk)).cast("long"))


def chunk_rows(df: DataFrame, log_key: list[str], order: str = "seq",
               rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Tag rows with their chunk and hash them by (log, chunk)."""
    return add_chunk(df, order, rows_per_chunk).repartition(*log_key, CHUNK)


def first_occurrence(df: DataFrame, log_key: list[str], keys: dict[str, list[str]],
                     order: str = "seq", source: DataFrame | None = None,
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add one 0/1 column per entry of ``keys``: 1 on the first row (smallest
    ``order``) of its key within the log. Null keys compare equal.

    When ``df`` carries the chunk column (``chunk_rows``), the flags join back
    on (log, chunk, seq) and keep the (log, chunk) partitioning. ``source``
    (same rows, possibly fewer columns) feeds the aggregates."""
    names = list(keys)
    chunked = CHUNK in df.columns
    row_key = [*log_key, CHUNK, order] if chunked else [*log_key, order]
    flag_sets = []
    src = source if source is not None else df
    for name, cols in keys.items():
        firsts = src.groupBy(*log_key, *cols).agg(F.min(order).alias(order))
        if chunked:
            firsts = firsts.withColumn(CHUNK, F.floor(F.col(order) / F.lit(rows_per_chunk)).cast("long"))
        flag_sets.append(firsts.select(
            *row_key,
            *[F.lit(1 if other == name else 0).alias(other) for other in names]))
    flags = flag_sets[0]
    for extra in flag_sets[1:]:
        flags = flags.unionByName(extra)
    flags = flags.groupBy(*row_key).agg(*[F.max(n).alias(n) for n in names])
    if chunked:
        # (log, chunk) partitioning: the join then needs no other shuffle of
        # the big side than the one the chunk windows need anyway.
        flags = flags.repartition(*log_key, CHUNK)
    out = df.join(flags, row_key, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("int") for n in names})


def chunked_running(df: DataFrame, log_key: list[str], order: str,
                    sums: dict[str, Column], log_mins: dict[str, Column] | None = None,
                    rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Running sums over each log in ``order`` (rows unbounded preceding ..
    current row), plus ``__row_in_log`` (1-based) and per-log minima.

    ``sums`` maps output column -> value column; ``log_mins`` maps output
    column -> column whose per-log minimum is attached to every row.
    """
    log_mins = log_mins or {}
    chunk = CHUNK
    base = df if CHUNK in df.columns else chunk_rows(df, log_key, order, rows_per_chunk)
    base = base.withColumns({f"__v_{name}": value for name, value in sums.items()})

    w_in = (Window.partitionBy(*log_key, chunk).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = base.withColumns({
        "__n_in": F.count(F.lit(1)).over(w_in),
        **{f"__in_{name}": F.sum(f"__v_{name}").over(w_in) for name in sums},
    })

    totals = base.groupBy(*log_key, chunk).agg(
        F.count(F.lit(1)).alias("__t_n"),
        *[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums],
        *[F.min(c).alias(f"__tm_{name}") for name, c in log_mins.items()],
    )
    w_prev = (Window.partitionBy(*log_key).orderBy(chunk)
              .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*log_key)
    offsets = totals.select(
        *log_key, chunk,
        F.coalesce(F.sum("__t_n").over(w_prev), F.lit(0)).alias("__o_n"),
        *[F.coalesce(F.sum(f"__t_{name}").over(w_prev), F.lit(0)).alias(f"__o_{name}")
          for name in sums],
        *[F.min(f"__tm_{name}").over(w_all).alias(name) for name in log_mins],
    )
    out = inner.join(offsets, [*log_key, chunk], "left")
    out = out.withColumns({
        "__row_in_log": F.col("__n_in") + F.col("__o_n"),
        **{name: F.col(f"__in_{name}") + F.col(f"__o_{name}") for name in sums},
    })
    keep = {"__row_in_log", *log_mins, *sums, *([CHUNK] if CHUNK in df.columns else [])}
    drop = [c for c in out.columns if c.startswith("__") and c not in keep]
    return out.drop(*drop)
