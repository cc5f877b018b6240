"""Fixed values that define the results (they must stay exactly as listed)."""

# --- fixed values -----------------------------------------------------------
# Band plan: band in metres -> inclusive frequency range in kHz. band_id is the
# position in this list (0..5); any other frequency has band = band_id = -1.
BANDMAP = [
    (10, 28000, 28074),
    (15, 21000, 21074),
    (20, 14000, 14074),
    (40, 7000, 7074),
    (80, 3500, 3574),
    (160, 1800, 1874),
]
BANDS = [b for b, _, _ in BANDMAP]

# Continents accepted by the continent filters (default: all of them).
CONTINENTS = ["AF", "AN", "AS", "EU", "NA", "OC", "SA"]
# Continents offered by default on the command line of the spot charts.
DEFAULT_RX_CONTINENTS = ["EU", "NA", "AS", "SA", "OC"]

# Callsign suffixes removed (literally, anywhere, in this order) before the
# prefix of a callsign is taken.
CALL_SUFFIXES = ["/QRP", "/P", "/MM", "/M"]

# Contest calendar: (contest, mode, month, week); week -1 = last full weekend.
CONTEST_RULES = [
    ("cqww", "cw", 11, -1),
    ("cqww", "ssb", 10, -1),
    ("cqwpx", "cw", 5, -1),
    ("cqwpx", "ssb", 3, -1),
    ("iaru", "mixed", 7, 2),
]

# Contest length assumed by the charts, in hours.
CONTEST_HOURS = 48

# Score evolution features: name -> (column, aggregation).
EVOLUTION_FEATURES = {
    "valid_qsos": ("cum_valid_qsos", "last"),
    "qso_points": ("cum_qso_points", "last"),
    "multipliers": ("cum_mult", "last"),
    "score": ("cum_contest_score", "last"),
    "points_per_qso": ("cum_points_per_qso", "mean"),
    "diff_contest_score": ("diff_contest_score", "mean"),
    "mult_worth_points": ("mult_worth_points", "mean"),
    "mult_worth_qsos": ("mult_worth_qsos", "mean"),
}

# Exponential smoothing factor of the SNR grid and its fixed parameters.
SNR_ALPHA = 0.3
SNR_SMOOTHING_HOURS = 2
SNR_MIN_RX_SPOTS_PER_HOUR = 2
# --- end of fixed values ----------------------------------------------------

# Our own geometry constants (the reference delegates these to an external
# package that is not available here).
EARTH_RADIUS_KM = 6371.0
EARTH_CIRCUMFERENCE_KM = 40008.0

# Log key: one contest log per (contest, contest_mode, year, mycall).
LOG_KEY = ["contest", "contest_mode", "year", "mycall"]
SPOT_KEY = ["contest", "contest_mode", "year"]

# Rows of a log per chunk for the order-dependent scans (running totals,
# rolling rates). A log larger than this is split over several tasks.
ROWS_PER_CHUNK = 1 << 20
