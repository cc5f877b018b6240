"""G1 geometry as column expressions: grid locator, distance, heading."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragchew.constants import EARTH_RADIUS_KM, EARTH_CIRCUMFERENCE_KM


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _clamp(x: Column, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(hi))


def maidenhead(lat: Column | str, lon: Column | str) -> Column:
    """Six-character Maidenhead locator (upper case)."""
    la = _clamp(_c(lat) + 90.0, 179.999999)
    lo = _clamp(_c(lon) + 180.0, 359.999999)
    a = F.lit(65)
    return F.concat(
        F.chr(a + F.floor(lo / 20)),
        F.chr(a + F.floor(la / 10)),
        F.floor(F.pmod(lo, F.lit(20.0)) / 2).cast("string"),
        F.floor(F.pmod(la, F.lit(10.0))).cast("string"),
        F.chr(a + F.floor(F.pmod(lo, F.lit(2.0)) * 12)),
        F.chr(a + F.floor(F.pmod(la, F.lit(1.0)) * 24)),
    )


def locator_center(loc: Column | str):
    """(lat, lon) of the centre of a six-character locator."""
    s = _c(loc)
    o = lambda i: F.ascii(F.substring(s, i, 1))
    lon = (
        (o(1) - 65) * 20 + (o(3) - 48) * 2 + ((o(5) - 65) + 0.5) / 12.0 - 180.0
    )
    lat = (o(2) - 65) * 10 + (o(4) - 48) + ((o(6) - 65) + 0.5) / 24.0 - 90.0
    return lat.cast("double"), lon.cast("double")


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp = p2 - p1
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def initial_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing from point 1 to point 2, [0, 360)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def long_path_km(short_km: Column) -> Column:
    return F.lit(EARTH_CIRCUMFERENCE_KM) - short_km


def long_path_heading(heading: Column) -> Column:
    return F.pmod(heading + 180.0, F.lit(360.0))
