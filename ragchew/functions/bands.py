"""Band of a contact from its frequency in kHz."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragchew.constants import BANDMAP


def band_col(freq: Column | str) -> Column:
    """Band in metres, -1 outside the six inclusive ranges."""
    f = F.col(freq) if isinstance(freq, str) else freq
    expr = F.lit(-1)
    for band, lo, hi in reversed(BANDMAP):
        expr = F.when(f.between(lo, hi), F.lit(band)).otherwise(expr)
    return expr.cast("int")


def band_id_col(freq: Column | str) -> Column:
    """Position of the band in the band plan (0..5), -1 outside."""
    f = F.col(freq) if isinstance(freq, str) else freq
    expr = F.lit(-1)
    for i in reversed(range(len(BANDMAP))):
        _, lo, hi = BANDMAP[i]
        expr = F.when(f.between(lo, hi), F.lit(i)).otherwise(expr)
    return expr.cast("int")


def add_band(df, freq: str = "frequency"):
    """Attach ``band`` and ``band_id``."""
    return df.withColumn("band", band_col(freq)).withColumn("band_id", band_id_col(freq))
