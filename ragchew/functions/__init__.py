"""Column-expression builders (all JVM-side, codegen friendly)."""

from ragchew.functions.bands import band_col, band_id_col  # noqa: F401
from ragchew.functions.callsign import callsign_chunk, callsign_prefix  # noqa: F401
from ragchew.functions.timecols import (  # noqa: F401
    contest_saturday, dummy_clock, label_col, minute_bin, custom_floor,
)
from ragchew.functions.geo import (  # noqa: F401
    maidenhead, locator_center, great_circle_km, initial_bearing,
)
