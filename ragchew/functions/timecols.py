"""Time helpers: contest hour, dummy clock, time bins."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def ntz_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (NTZ) timestamp; no
    session time zone involved."""
    return F.timestamp_diff("MICROSECOND", _epoch(), _c(ts).cast("timestamp_ntz"))


def micros_to_ntz(us: Column) -> Column:
    """Inverse of ``ntz_micros``."""
    return F.timestamp_add("MICROSECOND", us, _epoch())


def contest_saturday(first_ts: Column | str) -> Column:
    """Saturday 00:00 of the Monday-based week of the first contact's date."""
    d = F.to_date(_c(first_ts))
    return F.to_timestamp_ntz(F.date_add(d, F.lit(5) - F.weekday(d)).cast("string"))


def hours_between(ts: Column | str, origin: Column | str) -> Column:
    """Fractional hours from ``origin`` to ``ts`` (negative before it)."""
    micros = ntz_micros(ts) - ntz_micros(origin)
    return micros / F.lit(3_600_000_000.0)


def dummy_clock(hour: Column | str) -> Column:
    """2000-01-01 00:00 + hour, microsecond resolution (overlays years)."""
    micros = F.round(_c(hour) * F.lit(3_600_000_000.0)).cast("long")
    return micros_to_ntz(micros + F.lit(946_684_800_000_000))


def label_col(call: str = "mycall", year: str = "year") -> Column:
    """Display label ``CALL(YEAR)``."""
    return F.concat(F.col(call), F.lit("("), F.col(year).cast("string"), F.lit(")"))


def minute_bin(ts: Column | str, minutes: int, origin: Column | None = None) -> Column:
    """Start of the ``minutes``-wide bin holding ``ts``.

    Bins are counted from ``origin`` (default: the epoch, which equals the
    midnight-anchored pandas bins whenever the bin size divides a day)."""
    width = minutes * 60_000_000
    if origin is None:
        us = ntz_micros(ts)
        start = F.floor(us / F.lit(width)).cast("long") * F.lit(width)
        return micros_to_ntz(start)
    o = ntz_micros(origin)
    us = ntz_micros(ts) - o
    start = F.floor(us / F.lit(width)).cast("long") * F.lit(width) + o
    return micros_to_ntz(start)


def custom_floor(x: Column | str, precision: float) -> Column:
    """round(p * floor(round(x / p, 2)), 2) with half-even rounding (numpy)."""
    inner = F.bround(_c(x) / F.lit(precision), 2)
    return F.bround(F.lit(precision) * F.floor(inner), 2)
