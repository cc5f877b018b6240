"""DuckDB statements of every registered query (the correctness oracle).

They are written independently of the Spark code: plain SQL windows
(row_number, running sum, lag, RANGE frames) over the same fixture rows.
Tables available in DuckDB: the driver's test tables as views.
"""

from __future__ import annotations

from ragchew import fixtures as fx
from ragchew.constants import BANDMAP, BANDS

L = "contest, contest_mode, year, mycall"


def _band_case(col: str) -> str:
    whens = " ".join(f"WHEN {col} BETWEEN {lo} AND {hi} THEN {b}" for b, lo, hi in BANDMAP)
    return f"CASE {whens} ELSE -1 END"


def _band_id_case(col: str) -> str:
    whens = " ".join(f"WHEN {col} BETWEEN {lo} AND {hi} THEN {i}"
                     for i, (_, lo, hi) in enumerate(BANDMAP))
    return f"CASE {whens} ELSE -1 END"


def _chunk(col: str) -> str:
    c0 = f"replace(replace(replace(replace({col}, '/QRP', ''), '/P', ''), '/MM', ''), '/M', '')"
    parts = f"string_split({c0}, '/')"
    return (f"CASE WHEN len({parts}) = 1 THEN {parts}[1] "
            f"WHEN length({parts}[1]) < length({parts}[2]) THEN {parts}[1] ELSE {parts}[2] END")


def _prefix(col: str) -> str:
    ch = _chunk(col)
    return f"CASE WHEN regexp_extract({ch}, '(.*\\d)', 1) = '' THEN {ch} ELSE regexp_extract({ch}, '(.*\\d)', 1) END"


def _lookup(src: str, keycols: str, call: str, alias: str, attrs: list[str]) -> str:
    """Longest-prefix match by ranking every matching entry of the dimension."""
    sel = ", ".join(f"p.{a} AS {alias}{a}" for a in attrs)
    return f"""(SELECT {keycols}, {sel} FROM (
        SELECT s.{keycols.replace(', ', ', s.')}, p.*, row_number() OVER (
            PARTITION BY s.{keycols.replace(', ', ', s.')}
            ORDER BY p.exact DESC, length(p.prefix) DESC) AS rk
        FROM {src} s JOIN pfx p
          ON (p.exact AND p.prefix = s.{call})
          OR (NOT p.exact AND starts_with({_chunk('s.' + call)}, p.prefix))
      ) p WHERE rk = 1)"""


def _locator(lat: str, lon: str) -> str:
    la = f"least(greatest({lat} + 90.0, 0.0), 179.999999)"
    lo = f"least(greatest({lon} + 180.0, 0.0), 359.999999)"
    return (f"chr(CAST(65 + floor({lo} / 20) AS INT)) || chr(CAST(65 + floor({la} / 10) AS INT)) || "
            f"CAST(CAST(floor(({lo} % 20) / 2) AS BIGINT) AS VARCHAR) || "
            f"CAST(CAST(floor({la} % 10) AS BIGINT) AS VARCHAR) || "
            f"chr(CAST(65 + floor(({lo} % 2) * 12) AS INT)) || chr(CAST(65 + floor(({la} % 1) * 24) AS INT))")


def _center(loc: str):
    o = lambda i: f"ascii(substr({loc}, {i}, 1))"
    lon = f"(({o(1)} - 65) * 20 + ({o(3)} - 48) * 2 + (({o(5)} - 65) + 0.5) / 12.0 - 180.0)"
    lat = f"(({o(2)} - 65) * 10 + ({o(4)} - 48) + (({o(6)} - 65) + 0.5) / 24.0 - 90.0)"
    return lat, lon


def _dist(lat1, lon1, lat2, lon2):
    h = (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
         f"cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"(2 * 6371.0 * asin(sqrt(least({h}, 1.0))))"


def _bearing(lat1, lon1, lat2, lon2):
    dl = f"(radians({lon2}) - radians({lon1}))"
    y = f"(sin({dl}) * cos(radians({lat2})))"
    x = (f"(cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * "
         f"cos(radians({lat2})) * cos({dl}))")
    return f"(((degrees(atan2({y}, {x})) + 360.0) % 360.0 + 360.0) % 360.0)"


CONTEST_SQL = {
    "cqww": {
        "flags": ("row_number() OVER (PARTITION BY {L}, band, call ORDER BY seq) = 1 AS is_valid, "
                  "CAST(row_number() OVER (PARTITION BY {L}, band, country ORDER BY seq) = 1 AS INT) AS is_dxcc, "
                  "CAST(row_number() OVER (PARTITION BY {L}, band, zone ORDER BY seq) = 1 AS INT) AS is_zone"),
        "n_mult": "is_dxcc + is_zone",
        "points": ("CASE WHEN mycontinent IS DISTINCT FROM continent OR mycontinent IS NULL THEN 3 "
                   "WHEN mycontinent = 'NA' THEN 2 "
                   "WHEN country IS DISTINCT FROM mycountry OR mycountry IS NULL THEN 1 ELSE 0 END"),
    },
    "cqwpx": {
        "flags": ("row_number() OVER (PARTITION BY {L}, band, call ORDER BY seq) = 1 AS is_valid, "
                  "CAST(row_number() OVER (PARTITION BY {L}, prefix ORDER BY seq) = 1 AS INT) AS is_mult"),
        "n_mult": "is_mult",
        "points": ("CASE WHEN mycontinent IS DISTINCT FROM continent OR mycontinent IS NULL "
                   "THEN 3 + 3 * CAST(band IN (40, 80, 160) AS INT) "
                   "ELSE 1 + CAST(band IN (40, 80, 160) AS INT) END"),
    },
    "iaru": {
        "flags": ("row_number() OVER (PARTITION BY {L}, band, call ORDER BY seq) = 1 AS is_valid, "
                  "CAST(row_number() OVER (PARTITION BY {L}, band, exchange ORDER BY seq) = 1 AS INT) AS is_mult"),
        "n_mult": "is_mult",
        "points": ("CASE WHEN mycontinent IS DISTINCT FROM continent OR mycontinent IS NULL THEN 5 "
                   "WHEN (myexchange IS DISTINCT FROM exchange OR myexchange IS NULL OR exchange IS NULL) "
                   "AND country = mycountry THEN 1 "
                   "WHEN myexchange IS DISTINCT FROM exchange OR myexchange IS NULL OR exchange IS NULL THEN 3 "
                   "ELSE 1 END"),
    },
}

_ATTRS = ["country", "adif", "cqz", "ituz", "continent", "latitude", "longitude"]


def scored_ctes(contest: str = "cqww") -> str:
    """CTE chain ending in ``scored`` (the enriched, scored log)."""
    c = CONTEST_SQL[contest]
    rk = "contest, contest_mode, year, mycall, seq"
    lat1, lon1 = _center("mylocator")
    lat2, lon2 = _center("locator")
    prefix_col = f", {_prefix('call')} AS prefix" if contest == "cqwpx" else ""
    return f"""
raw AS ({fx.sql_raw_logs(contest)}),
pfx AS ({fx.sql_prefixes()}),
banded AS (SELECT *, {_band_case('frequency')} AS band, {_band_id_case('frequency')} AS band_id FROM raw),
callinfo AS {_lookup('banded', rk, 'call', '', _ATTRS)},
myinfo AS {_lookup('banded', rk, 'mycall', 'my', ['country', 'continent', 'latitude', 'longitude'])},
located AS (
  SELECT b.*, ci.country, ci.adif, ci.cqz, ci.ituz, ci.continent, ci.latitude, ci.longitude,
         mi.mycountry, mi.mycontinent,
         {_locator('ci.latitude', 'ci.longitude')} AS locator,
         {_locator('mi.mylatitude', 'mi.mylongitude')} AS mylocator
  FROM banded b JOIN callinfo ci USING ({rk}) LEFT JOIN myinfo mi USING ({rk})
  WHERE ci.country IS NOT NULL
),
geo AS (
  SELECT *, {_dist(lat1, lon1, lat2, lon2)} AS distance,
         {_bearing(lat1, lon1, lat2, lon2)} AS heading {prefix_col}
  FROM located
),
flagged AS (
  SELECT *, {c['flags'].format(L=L)} FROM geo
),
pointed AS (
  SELECT *, CASE WHEN is_valid THEN {c['points']} ELSE 0 END AS qso_points,
         {c['n_mult']} AS n_mult,
         min(datetime) OVER (PARTITION BY {L}) AS log_start
  FROM flagged
),
running AS (
  SELECT *,
    CAST(sum(qso_points) OVER w AS BIGINT) AS cum_qso_points,
    CAST(sum(n_mult) OVER w AS BIGINT) AS cum_mult,
    CAST(sum(CAST(is_valid AS INT)) OVER w AS BIGINT) AS cum_valid_qsos,
    row_number() OVER w AS rn
  FROM pointed WINDOW w AS (PARTITION BY {L} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
scored0 AS (
  SELECT *,
    CAST(cum_qso_points * cum_mult AS BIGINT) AS cum_contest_score,
    cum_qso_points / NULLIF(cum_valid_qsos, 0) AS cum_points_per_qso,
    cum_qso_points / NULLIF(cum_mult, 0) AS mult_worth_points,
    (epoch_us(datetime) - epoch_us((CAST(CAST(log_start AS DATE) AS TIMESTAMP) + to_days(CAST(5 - (isodow(CAST(log_start AS DATE)) - 1) AS INT))))) / 3600000000.0 AS hour
  FROM running
),
scored1 AS (
  SELECT *,
    CAST(coalesce(cum_contest_score - lag(cum_contest_score) OVER (PARTITION BY {L} ORDER BY seq), 0) AS DOUBLE) AS diff_contest_score,
    mult_worth_points / NULLIF(cum_points_per_qso, 0) AS mult_worth_qsos,
    CASE WHEN is_valid THEN (epoch_us(datetime) - epoch_us(lag(datetime) OVER (PARTITION BY {L}, call, is_valid ORDER BY seq))) / 60000000.0 END AS minutes_from_previous_call,
    CASE WHEN is_valid THEN lag(band) OVER (PARTITION BY {L}, call, is_valid ORDER BY seq) END AS band_from_previous_call
  FROM scored0
),
scored AS (
  SELECT *, CAST(coalesce(band_from_previous_call, -1) AS VARCHAR) || ' → ' || CAST(band AS VARCHAR) AS band_transition_from_previous_call
  FROM scored1
)"""


def _present(cols: list[str]) -> str:
    from ragchew.registry import ROUND6
    out = []
    for c in cols:
        if c == "is_valid":
            out.append("CAST(is_valid AS INT) AS is_valid")
        elif c in ROUND6:
            out.append(f"round(CAST({c} AS DOUBLE), 6) AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


def q_band() -> str:
    return f"""WITH raw AS ({fx.sql_raw_logs()})
SELECT contest, contest_mode, year, mycall, seq, frequency,
       {_band_case('frequency')} AS band, {_band_id_case('frequency')} AS band_id FROM raw"""


def q_score(contest: str) -> str:
    from ragchew.registry import SCORE_COLUMNS
    return f"WITH {scored_ctes(contest)}\nSELECT {_present(SCORE_COLUMNS[contest])} FROM scored"


def q_summary(contest: str) -> str:
    if contest == "cqww":
        aggs = ("CAST(sum(CAST(is_valid AS INT)) AS BIGINT) AS qsos, CAST(sum(is_zone) AS BIGINT) AS zones, "
                "CAST(sum(is_dxcc) AS BIGINT) AS dxcc, CAST(sum(qso_points) AS BIGINT) AS qso_points")
        mult = "(zones + dxcc)"
    else:
        aggs = ("CAST(sum(CAST(is_valid AS INT)) AS BIGINT) AS qsos, CAST(sum(is_mult) AS BIGINT) AS is_mult, "
                "CAST(sum(qso_points) AS BIGINT) AS qso_points")
        mult = "is_mult"
    bands = ", ".join(str(b) for b in BANDS)
    return f"""WITH {scored_ctes(contest)},
per_band AS (SELECT {L}, band, {aggs} FROM scored GROUP BY {L}, band),
per_log AS (SELECT {L}, CAST(NULL AS INT) AS band, {aggs} FROM scored GROUP BY {L})
SELECT *, CAST(NULL AS BIGINT) AS score FROM per_band WHERE band IN ({bands})
UNION ALL
SELECT *, CAST(qso_points * {mult} AS BIGINT) AS score FROM per_log"""


LABEL = "mycall || '(' || CAST(year AS VARCHAR) || ')'"
LOGC = "contest, contest_mode"


def _ws(contest: str, body: str) -> str:
    return f"WITH {scored_ctes(contest)}\n{body}"


def _dummy_us(hour: str = "hour") -> str:
    return f"(946684800000000 + CAST(round({hour} * 3600000000.0) AS BIGINT))"


def _bin_ts(us: str, minutes: int) -> str:
    """Bins from the first midnight of the rows at hand, per contest and mode."""
    w = minutes * 60000000
    if 1440 % minutes:
        day0 = (f"(CAST(floor(min({us}) OVER (PARTITION BY contest, contest_mode) / 86400000000.0) AS BIGINT)"
                " * 86400000000)")
        return f"make_timestamp({day0} + CAST(floor(({us} - {day0}) / {w}.0) AS BIGINT) * {w})"
    return f"make_timestamp(CAST(floor(CAST({us} AS DOUBLE) / {w}) AS BIGINT) * {w})"


def _r6cols(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)


def q_contest_hour() -> str:
    return _ws("cqww", f"SELECT {L}, seq, datetime, round(hour, 6) AS hour FROM scored")


def q_rate(bin_min: int = 60, target: str = "qsos") -> str:
    val = "1" if target == "qsos" else f"CAST({target} AS BIGINT)"
    return _ws("cqww", f"""SELECT {LOGC}, {LABEL} AS callsign_year,
  b AS dummy_datetime, CAST(sum({val}) AS BIGINT) AS {target}_sum
FROM (SELECT *, {_bin_ts(_dummy_us(), bin_min)} AS b FROM scored) GROUP BY ALL""")


def _rolling(value: str, minutes: int) -> str:
    m = "(epoch_us(datetime) // 60000000)"
    return (f"(sum({value}) OVER (PARTITION BY {L} ORDER BY {m} RANGE BETWEEN {minutes - 1} PRECEDING AND CURRENT ROW)"
            f" - coalesce(sum({value}) OVER (PARTITION BY {L}, datetime ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))")


def q_rolling_rate(minutes: int = 60) -> str:
    return _ws("cqww", f"""SELECT {LOGC}, {LABEL} AS callsign_year, seq,
  make_timestamp({_dummy_us()}) AS dummy_datetime, CAST({_rolling('1', minutes)} AS BIGINT) AS qsos_sum
FROM scored""")


def q_log_table(contest: str) -> str:
    from ragchew.plans.tables import LOG_TABLE_COLUMNS
    cols = []
    for c in LOG_TABLE_COLUMNS[contest]:
        if c.startswith("rate_"):
            cols.append(f"CAST({_rolling('CAST(is_valid AS INT)', int(c[5:]))} AS BIGINT) AS {c}")
        else:
            cols.append(c)
    return _ws(contest, f"SELECT {', '.join(cols)} FROM scored")


def q_qsos_hour(bin_min: int = 60, continents=None) -> str:
    from ragchew.constants import CONTINENTS, CONTEST_HOURS
    conts = ", ".join(f"'{c}'" for c in (continents or CONTINENTS))
    p = float(bin_min) / 60
    nb = int(-(-CONTEST_HOURS // p))
    return _ws("cqww", f""",
f AS (SELECT {LOGC}, mycall, year, band, band_id,
        CAST(floor(round_even(hour / {p}, 2)) AS BIGINT) AS hbin, count(call) AS qsos
      FROM scored WHERE continent IN ({conts}) GROUP BY ALL),
t AS (SELECT {LOGC}, mycall, year, hbin, sum(qsos) AS total_qsos FROM f GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT {LOGC}, mycall, year FROM f)
      CROSS JOIN (SELECT DISTINCT band, band_id FROM f)
      CROSS JOIN (SELECT range AS hbin FROM range(0, {nb})))
SELECT g.contest, g.contest_mode, g.mycall, g.year, CAST(g.band AS VARCHAR) AS band, g.band_id,
  round_even(CAST(g.hbin AS DOUBLE) * CAST({p} AS DOUBLE), 2) AS hour_rounded, CAST(coalesce(f.qsos, 0) AS BIGINT) AS qsos,
  CAST(coalesce(t.total_qsos, 0) AS BIGINT) AS total_qsos,
  g.mycall || '(' || CAST(g.year AS VARCHAR) || ')' AS callsign_year
FROM g LEFT JOIN f USING (contest, contest_mode, mycall, year, band, band_id, hbin)
LEFT JOIN t USING (contest, contest_mode, mycall, year, hbin)""").replace("WITH \n", "WITH ").replace("scored AS", "scored AS", 1).replace(")\n,\nf AS", "),\nf AS")


def q_heatmap(bin_min: int = 1, continents=None, hour_step: int = 1) -> str:
    from ragchew.constants import CONTINENTS
    conts = ", ".join(f"'{c}'" for c in (continents or CONTINENTS))
    return _ws("cqww", f""",
d AS (SELECT {LOGC}, {LABEL} AS callsign_year, CAST(floor(hour) AS BIGINT) AS contest_hour,
        {_bin_ts('epoch_us(datetime)', bin_min)} AS b, call, seq
      FROM scored WHERE continent IN ({conts})),
c AS (SELECT {LOGC}, callsign_year, contest_hour, b, count(*) AS qsos FROM d GROUP BY ALL),
fc AS (SELECT {LOGC}, callsign_year, contest_hour, b, call, min(seq) AS fs FROM d GROUP BY ALL),
l AS (SELECT {LOGC}, callsign_year, contest_hour, b, list(call ORDER BY fs) AS calls FROM fc GROUP BY ALL),
f AS (SELECT c.*, l.calls, CAST(minute(c.b) AS BIGINT) AS contest_minute
      FROM c JOIN l USING ({LOGC}, callsign_year, contest_hour, b)),
g AS (SELECT * FROM (SELECT DISTINCT {LOGC}, callsign_year FROM f)
      CROSS JOIN (SELECT range AS contest_hour FROM range(0, 48, {hour_step}))
      CROSS JOIN (SELECT range AS contest_minute FROM range(0, 60, {bin_min})))
SELECT g.contest, g.contest_mode, g.callsign_year, g.contest_hour, g.contest_minute,
  CAST(coalesce(f.qsos, 0) AS BIGINT) AS qsos, coalesce(f.calls, []::VARCHAR[]) AS calls
FROM g LEFT JOIN f USING ({LOGC}, callsign_year, contest_hour, contest_minute)""").replace(")\n,\nd AS", "),\nd AS")


def q_heatmap_pivot() -> str:
    inner = q_heatmap(1)
    cols = ", ".join(f'max(CASE WHEN contest_minute = {m} THEN qsos END) AS "{m}"' for m in range(60))
    return f"""SELECT {LOGC}, callsign_year, contest_hour, {cols}
FROM ({inner}) h GROUP BY {LOGC}, callsign_year, contest_hour"""


def q_frequency() -> str:
    return _ws("cqww", f"""SELECT {LOGC}, {LABEL} AS callsign_year, seq,
  make_timestamp({_dummy_us()}) AS dummy_datetime, frequency, band FROM scored""")


def q_direction(h0=0, h1=23) -> str:
    return _ws("cqww", f""",
f AS (SELECT {LOGC}, {LABEL} AS callsign_year, CAST(ceil(heading / 10) - 1 AS BIGINT) AS b,
        count(call) AS qsos
      FROM scored WHERE hour >= {h0} AND hour < {h1} AND heading > 0 AND heading <= 360 GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT {LOGC}, callsign_year FROM f)
      CROSS JOIN (SELECT range AS b FROM range(0, 36)))
SELECT g.contest, g.contest_mode, g.callsign_year, CAST(g.b * 10 AS DOUBLE) AS heading_first,
  CAST(coalesce(f.qsos, 0) AS BIGINT) AS qsos
FROM g LEFT JOIN f USING ({LOGC}, callsign_year, b)""").replace(")\n,\nf AS", "),\nf AS")


def q_evolution(feature: str, bin_min: int = 60, scope: str = "contest, contest_mode, year") -> str:
    from ragchew.constants import EVOLUTION_FEATURES
    col, how = EVOLUTION_FEATURES[feature]
    agg = (f"CAST(arg_max({col}, seq) FILTER (WHERE {col} IS NOT NULL) AS BIGINT)" if how == "last"
           else f"round(CAST(avg({col}) AS DOUBLE), 6)")
    h = ("(epoch_us(datetime) - epoch_us(CAST(CAST(fst AS DATE) AS TIMESTAMP) + "
         "to_days(CAST(5 - (isodow(CAST(fst AS DATE)) - 1) AS INT)))) / 3600000000.0")
    return _ws("cqww", f""",
e AS (SELECT *, min(datetime) OVER (PARTITION BY {scope}) AS fst FROM scored),
e2 AS (SELECT *, {h} AS h2 FROM e)
SELECT {LOGC}, {LABEL} AS callsign_year, b AS dummy_datetime,
  {agg} AS {col}
FROM (SELECT *, {_bin_ts(_dummy_us('h2'), bin_min)} AS b FROM e2) GROUP BY ALL""").replace(")\n,\ne AS", "),\ne AS")


def q_prev_call() -> str:
    return _ws("cqww", f"""SELECT {L}, seq, call, band, CAST(is_valid AS INT) AS is_valid,
  round(minutes_from_previous_call, 6) AS minutes_from_previous_call, band_from_previous_call,
  band_transition_from_previous_call FROM scored""")


def q_repeat_hist(bin_min: int = 5) -> str:
    return _ws("cqww", f""",
f AS (SELECT {LOGC}, {LABEL} AS callsign_year, band_transition_from_previous_call,
        CAST(floor(minutes_from_previous_call / {bin_min}) AS BIGINT) AS b, count(*) AS qsos
      FROM scored WHERE minutes_from_previous_call IS NOT NULL GROUP BY ALL)
SELECT {LOGC}, callsign_year, band_transition_from_previous_call, CAST(b * {bin_min} AS DOUBLE) AS minutes_bin,
  CAST(qsos AS BIGINT) AS qsos,
  CAST(sum(qsos) OVER (PARTITION BY {LOGC}, callsign_year, band_transition_from_previous_call ORDER BY b
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_qsos
FROM f""").replace(")\n,\nf AS", "),\nf AS")


def spot_ctes(dense: bool = False) -> str:
    """CTE chain ending in ``spots`` (filled and cleaned spot rows)."""
    def pfx_lookup(col):
        return f"""(SELECT k.{col}, p.continent FROM (
            SELECT k.{col}, p.continent, row_number() OVER (PARTITION BY k.{col}
                ORDER BY p.exact DESC, length(p.prefix) DESC) AS rk
            FROM (SELECT DISTINCT {col} FROM rawspots WHERE {col} IS NOT NULL) k JOIN pfx p
              ON (p.exact AND p.prefix = k.{col} || '1AA')
              OR (NOT p.exact AND starts_with(k.{col} || '1AA', p.prefix))) p
            JOIN (SELECT DISTINCT {col} FROM rawspots) k USING ({col}) WHERE rk = 1)"""
    return f"""
rawspots AS ({fx.sql_raw_spots(dense)}),
pfx AS ({fx.sql_prefixes()}),
dep AS {pfx_lookup('de_pfx')},
dxp AS {pfx_lookup('dx_pfx')},
filled AS (
  SELECT r.callsign, r.dx, r.date, r.freq, r.db, r.de_pfx, r.dx_pfx, r.band, r.mode, r.speed,
         coalesce(r.de_cont, dep.continent) AS de_cont, coalesce(r.dx_cont, dxp.continent) AS dx_cont
  FROM rawspots r LEFT JOIN dep ON dep.de_pfx = r.de_pfx LEFT JOIN dxp ON dxp.dx_pfx = r.dx_pfx
),
spots AS (
  SELECT 'cqww' AS contest, 'cw' AS contest_mode, 2023 AS year, callsign, freq,
         CAST(replace(band, 'm', '') AS INT) AS band, dx, mode, db, speed, de_cont, dx_cont,
         strptime(date, '%Y-%m-%d %H:%M:%S') AS datetime
  FROM filled WHERE dx IS NOT NULL AND contains(band, 'm') AND NOT contains(band, 'cm')
)"""


def _wsp(body: str, dense: bool = False) -> str:
    return f"WITH {spot_ctes(dense)}\n{body}"


def q_spot_fill_cont() -> str:
    return _wsp("SELECT callsign, dx, date, freq, db, de_pfx, dx_pfx, de_cont, dx_cont FROM filled")


def q_spot_clean() -> str:
    return _wsp("SELECT * FROM spots")


def q_band_conditions(ref="EU", bin_min=60, conts=("EU", "NA", "AS", "SA", "OC")) -> str:
    cl = ", ".join(f"'{c}'" for c in conts)
    bands = ", ".join(str(b) for b in BANDS)
    return _wsp(f""",
c AS (SELECT *, CASE WHEN dx_cont = '{ref}' THEN de_cont ELSE dx_cont END AS continent FROM spots
      WHERE (dx_cont = '{ref}' OR de_cont = '{ref}') AND band IN ({bands})),
b AS (SELECT *, {_bin_ts('epoch_us(datetime)', bin_min)} AS bin FROM c WHERE continent IN ({cl})),
g AS (SELECT contest, contest_mode, continent, band, year, bin AS datetime,
        count(freq) AS numerator FROM b GROUP BY ALL)
SELECT *, CAST(sum(numerator) OVER (PARTITION BY contest, contest_mode, band, continent, year) AS BIGINT) AS denominator,
  round(100.0 * numerator / sum(numerator) OVER (PARTITION BY contest, contest_mode, band, continent, year), 6) AS percent
FROM g""").replace(")\n,\nc AS", "),\nc AS")


def _spot_station(agg: str, bin_min=60, rx=None, asked="true") -> str:
    where = f"WHERE de_cont IN ({', '.join(repr(c) for c in rx)})" if rx else ""
    h = ("(epoch_us(datetime) - epoch_us(CAST(CAST(fst AS DATE) AS TIMESTAMP) + "
         "to_days(CAST(5 - (isodow(CAST(fst AS DATE)) - 1) AS INT)))) / 3600000000.0")
    return _wsp(f""",
e AS (SELECT *, min(datetime) OVER (PARTITION BY contest, contest_mode, year) AS fst FROM spots WHERE {asked}),
e2 AS (SELECT *, {h} AS hour FROM e)
SELECT contest, contest_mode, dx || '(' || CAST(year AS VARCHAR) || ')' AS callsign_year, band,
  b AS dummy_datetime, {agg}
FROM (SELECT *, {_bin_ts(_dummy_us(), bin_min)} AS b FROM e2 {where}) GROUP BY ALL""").replace(")\n,\ne AS", "),\ne AS")


def q_snr_ctes(calls, rx, bands, bin_min, closed=True, alpha=0.3, keep="true", on_grid="true") -> str:
    q = 1 - alpha
    cl = ", ".join(f"'{c}'" for c in calls)
    rl = ", ".join(f"'{c}'" for c in rx)
    bl = ", ".join(str(b) for b in bands)
    n = len(set(calls))
    k = "contest, contest_mode, year"
    closed_sql = (f"""s1 AS (SELECT * FROM s0 WHERE ({k}, callsign) IN (
        SELECT ({k}, callsign) FROM s0 GROUP BY {k}, callsign HAVING count(DISTINCT dx) = {n})),""")
    return f""",
s0 AS (SELECT contest, contest_mode, year, callsign, dx, band, de_cont, db, datetime,
         date_trunc('hour', datetime) AS hr, CAST(round_even(freq, 0) AS INT) AS freq
       FROM spots WHERE year = 2023 AND ({keep}) AND dx IN ({cl}) AND de_cont IN ({rl})),
{closed_sql if closed else 's1 AS (SELECT * FROM s0),'}
s2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {k}, hr, dx, callsign, band) AS c FROM s1) WHERE c >= 2),
g AS (SELECT {k}, {_bin_ts('epoch_us(datetime)', bin_min)} AS datetime, dx, callsign, freq, band, de_cont,
        avg(db) AS db FROM s2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {k}, dx, band, de_cont, callsign ORDER BY datetime, freq) AS rn
      FROM g WHERE band IN ({bl}) AND {on_grid}),
e AS (SELECT a.contest, a.contest_mode, a.year, a.datetime, a.dx, a.callsign, a.freq, a.band, a.de_cont,
        (sum(CASE WHEN b.rn <= a.rn THEN b.db * pow({q}, a.rn - b.rn) END)
           / sum(CASE WHEN b.rn <= a.rn THEN pow({q}, a.rn - b.rn) END)
         + sum(CASE WHEN b.rn >= a.rn THEN b.db * pow({q}, b.rn - a.rn) END)
           / sum(CASE WHEN b.rn >= a.rn THEN pow({q}, b.rn - a.rn) END)) / 2.0 AS db
      FROM r a JOIN r b ON a.contest = b.contest AND a.contest_mode = b.contest_mode AND a.year = b.year
        AND a.dx = b.dx AND a.band = b.band AND a.de_cont = b.de_cont AND a.callsign = b.callsign
      GROUP BY ALL)"""


def q_snr_smooth(alpha: float = 0.3) -> str:
    return _wsp(q_snr_ctes(["ST0", "ST1", "ST2", "ST3", "ST4"], ["EU", "NA", "AS", "AF"], [10, 15, 20, 40, 80, 160, 6], 10, closed=False, alpha=alpha)
                .replace("WHERE c >= 2", "WHERE c >= 0") + "\nSELECT contest, contest_mode, year, datetime, dx, callsign, freq, band, de_cont, round(db, 6) AS db FROM e", True).replace(")\n,\ns0 AS", "),\ns0 AS")


def q_snr_fill() -> str:
    k = "contest, contest_mode, year, dx, band, de_cont, callsign"
    ctes = q_snr_ctes(["ST0", "ST1", "ST2", "ST3", "ST4"], ["EU", "NA", "AS", "AF"],
                      [10, 15, 20, 40, 80, 160, 6], 10, closed=False).replace("WHERE c >= 2", "WHERE c >= 0")
    return _wsp(ctes + f""",
span AS (SELECT {k}, min(datetime) AS lo, max(datetime) AS hi FROM g GROUP BY ALL),
grid AS (SELECT {k}, unnest(generate_series(lo, hi, INTERVAL 10 MINUTE)) AS datetime FROM span),
dense AS (SELECT grid.*, g.freq, g.db FROM grid LEFT JOIN g USING ({k}, datetime)),
gapless AS (SELECT * REPLACE (coalesce(db, (lag(db) OVER w + lead(db) OVER w) / 2.0) AS db) FROM dense
           WINDOW w AS (PARTITION BY {k} ORDER BY datetime, freq))
SELECT {k}, datetime, freq, round(db, 6) AS db FROM gapless WHERE db IS NOT NULL""", True).replace(")\n,\ns0 AS", "),\ns0 AS")


def q_snr_grid(calls, rx, bands, bin_min, keep="true", on_grid="true") -> str:
    size = max(int(2 * 60 / bin_min), 1)
    before, after = size // 2, size - size // 2 - 1
    k = "contest, contest_mode, year"
    return _wsp(q_snr_ctes(calls, rx, bands, bin_min, keep=keep, on_grid=on_grid) + f""",
m AS (SELECT {k}, datetime, dx, band, de_cont, quantile_cont(db, 0.5) AS db FROM e GROUP BY ALL)
SELECT {k}, datetime, dx, band, de_cont,
  round(quantile_cont(db, 0.5) OVER (PARTITION BY {k}, dx, band, de_cont ORDER BY datetime
        ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING), 6) AS db
FROM m""", True).replace(")\n,\ns0 AS", "),\ns0 AS")


def q_closed_receivers() -> str:
    return _wsp("""SELECT contest, contest_mode, year, callsign FROM spots
WHERE year = 2023 AND de_cont IN ('EU', 'NA', 'AS', 'AF') AND dx IN ('ST0', 'ST1', 'ST2', 'ST3', 'ST4')
GROUP BY ALL HAVING count(DISTINCT dx) = 5""", True)


def q_active_receivers() -> str:
    return _wsp("""SELECT * EXCLUDE (c) FROM (
  SELECT *, count(*) OVER (PARTITION BY contest, contest_mode, year, date_trunc('hour', datetime), dx, callsign, band) AS c
  FROM spots WHERE year = 2023 AND de_cont IN ('EU', 'NA', 'AS', 'AF') AND dx IN ('ST0', 'ST1', 'ST2', 'ST3', 'ST4'))
WHERE c >= 2""", True)


def q_weekends() -> str:
    return """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders),
d AS (SELECT y.year, CAST(g.d AS DATE) AS sat
      FROM y, generate_series(make_date(y.year - 1, 12, 20), make_date(y.year + 1, 1, 10), INTERVAL 1 DAY) g(d)
      WHERE isodow(g.d) = 6 AND isoyear(g.d) = y.year),
w AS (SELECT year, CAST(week(sat) AS INT) AS week, CAST(sat AS TIMESTAMP) AS saturday,
        CAST(sat + 1 AS TIMESTAMP) AS sunday, CAST(month(sat) AS INT) AS month_saturday,
        CAST(month(sat + 1) AS INT) AS month_sunday, month(sat) = month(sat + 1) AS is_full_weekend FROM d),
n AS (SELECT *, CAST(sum(CAST(is_full_weekend AS INT)) OVER (PARTITION BY year, month_saturday, month_sunday ORDER BY week
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS month_week_number FROM w)
SELECT *, max(month_week_number) OVER (PARTITION BY year, month_saturday, month_sunday) AS month_max_week FROM n"""


def q_contest_dates() -> str:
    from ragchew.constants import CONTEST_RULES
    vals = ", ".join(f"('{c}', '{m}', {mo}, {w})" for c, m, mo, w in CONTEST_RULES)
    return f"""WITH wk AS ({q_weekends()}),
rules(contest, mode, month, week) AS (VALUES {vals})
SELECT r.contest, r.mode, k.year, k.saturday, k.sunday FROM wk k JOIN rules r ON k.month_saturday = r.month
WHERE k.is_full_weekend AND ((r.week = -1 AND k.month_week_number = k.month_max_week)
   OR (r.week <> -1 AND k.month_week_number = r.week))"""


def q_prefix_lookup() -> str:
    return f"""WITH raw AS ({fx.sql_raw_logs()}), pfx AS ({fx.sql_prefixes()}),
calls AS (SELECT DISTINCT call FROM raw),
hit AS {_lookup('calls', 'call', 'call', '', _ATTRS)}
SELECT c.call, {', '.join('h.' + a for a in _ATTRS)} FROM calls c LEFT JOIN hit h USING (call)"""


def q_geo() -> str:
    return _ws("cqww", f"""SELECT {L}, seq, locator, mylocator, round(distance, 6) AS distance,
  round(40008.0 - distance, 6) AS distance_lp, round(heading, 6) AS heading,
  round(((heading + 180.0) % 360.0 + 360.0) % 360.0, 6) AS heading_lp FROM scored""")


def q_log_scan(contest: str = "cqww", fields: str = "myzone, call, rst, zone") -> str:
    return f"""WITH raw AS ({fx.sql_raw_logs(contest)})
SELECT contest, contest_mode, year, mycall,
  CAST(4 + row_number() OVER (PARTITION BY contest, contest_mode, year, mycall ORDER BY seq) AS BIGINT) AS seq,
  frequency, mode, myrst, {fields}, radio, datetime FROM raw"""


def q_log_header() -> str:
    return f"""WITH raw AS ({fx.sql_raw_logs()}),
logs AS (SELECT DISTINCT contest, contest_mode, year, mycall FROM raw)
SELECT contest, contest_mode, year, mycall, 'START-OF-LOG' AS key, '3.0' AS value FROM logs
UNION ALL SELECT contest, contest_mode, year, mycall, 'CALLSIGN', mycall FROM logs
UNION ALL SELECT contest, contest_mode, year, mycall, 'CONTEST', 'CQ-WW-CW' FROM logs
UNION ALL SELECT contest, contest_mode, year, mycall, 'CATEGORY-OPERATOR', 'SINGLE-OP' FROM logs"""


def q_catalog_calls() -> str:
    return r"""SELECT page_id, replace(upper(c), '-', '/') AS callsign
FROM (SELECT page_id, unnest(regexp_extract_all(html, '>([A-Z0-9\/]+)<', 1)) AS c FROM pages)"""


def q_catalog_links() -> str:
    return r"""SELECT page_id, item, replace(substr(item, 5), 'ph', 'ssb') AS mode, substr(item, 1, 4) AS year
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/?(\w+)"', 1)) AS item FROM pages)"""


def q_catalog_pairs() -> str:
    return r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/?\w+)">(\w+)<', 1)) AS link,
  unnest(regexp_extract_all(html, '<a href="(/?\w+)">(\w+)<', 2)) AS text FROM pages"""


def q_skip_existing() -> str:
    return f"""WITH raw AS ({fx.sql_raw_logs()})
SELECT DISTINCT contest, contest_mode, year, mycall FROM raw WHERE year <> 2023"""


def q_log_table_page() -> str:
    from ragchew.plans.tables import LOG_TABLE_COLUMNS
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in LOG_TABLE_COLUMNS["cqww"])
    return f"SELECT * FROM ({q_log_table('cqww')}) t ORDER BY {order} LIMIT 250 OFFSET 750"


def q_prefix() -> str:
    return f"""WITH raw AS ({fx.sql_raw_logs()})
SELECT contest, contest_mode, year, mycall, seq, call, {_prefix('call')} AS prefix FROM raw"""


def q_arrl_links() -> str:
    anchor = r"""'<A HREF="/([A-Z0-9]+)">([A-Z0-9/]+)<'"""
    return f"""SELECT CAST(page_id AS INT) AS iid, unnest(regexp_extract_all(h, {anchor}, 2)) AS callsign,
  unnest(regexp_extract_all(h, {anchor}, 1)) AS link
FROM (SELECT page_id, translate(html, '{fx._LOWER}', '{fx._UPPER}') AS h FROM pages)"""


def q_ingest_headers() -> str:
    return _ws("cqww", f""",
logs AS (SELECT {L}, count(*) AS contacts FROM scored GROUP BY ALL),
heads AS ({q_log_header().replace("WITH raw AS", "WITH raw2 AS").replace("FROM raw)", "FROM raw2)").replace("logs", "logs2")})
SELECT h.*, contacts, CAST(1 AS BIGINT) AS header_rows FROM heads h JOIN logs USING ({L})""").replace(")\n,\nlogs AS", "),\nlogs AS")


def q_spot_rejects() -> str:
    bad = ", ".join(f"{e} AS {c}" for c, e in fx.FAULTS.items())
    return f"""WITH rawspots AS ({fx.sql_raw_spots()}),
damaged AS (SELECT * REPLACE ({bad}) FROM rawspots),
told AS (SELECT callsign, CASE WHEN speed = 'fast' THEN 'unreadable_record' WHEN dx IS NULL THEN 'no_station'
    WHEN NOT contains(band, 'm') OR contains(band, 'cm') THEN 'band_not_in_metres' WHEN band = '?m' THEN 'unreadable_band'
    WHEN starts_with(date, 'x') THEN 'unreadable_time' ELSE 'stored' END AS outcome FROM damaged)
SELECT outcome, callsign, count(*) AS lines FROM told GROUP BY ALL"""


def q_cq(anchor: str, name: str) -> str:
    return f"""SELECT page_id, unnest(regexp_extract_all(h, '{anchor}', 1)) AS {name}
FROM (SELECT page_id, translate(html, '{fx._LOWER}', '{fx._UPPER}') AS h FROM pages)"""


def q_cq_options() -> str:
    links, calls = q_cq('<A HREF="/([A-Z0-9]+)">', "item"), q_cq(">([A-Z0-9/]+)<", "callsign")
    return f"""SELECT page_id, callsign, substr(item, 5) AS mode, substr(item, 1, 4) AS year
FROM ({calls}) JOIN ({links}) USING (page_id)"""


def q_log_table_far_page() -> str:
    from ragchew.plans.tables import LOG_TABLE_COLUMNS
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in LOG_TABLE_COLUMNS["cqww"])
    return f"""SELECT * EXCLUDE (nth, total) FROM (
  SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS nth, count(*) OVER () AS total FROM ({q_log_table('cqww')}) t)
WHERE nth >= (total // 7 - 2) * 7 AND nth < (total // 7 - 1) * 7"""


EVEN = "CAST(substr(mycall, 3) AS INT) % 2 = 0"


def _open_oracle() -> dict[str, str]:
    rx = ["EU", "NA", "AS", "SA", "OC"]
    snr = (["ST0", "ST1", "ST2", "ST3", "ST4"], ["EU", "NA", "AS", "AF"], BANDS, 10)
    return {
        "rate_7": q_rate(7),
        "rate_valid": q_rate(60, "is_valid"),
        "heatmap_7": q_heatmap(7),
        "evolution_score_25": q_evolution("score", 25),
        "band_conditions_25": q_band_conditions(bin_min=25),
        "snr_mean_25": _spot_station("round(avg(db), 6) AS db", 25, rx),
        "spot_pairs": _spot_station("round(avg(speed), 6) AS speed", asked="CAST(substr(dx, 3) AS INT) % 2 = 0"),
        "snr_grid_filter": q_snr_grid(*snr, keep="speed >= 24"),
        "snr_smooth_slow": q_snr_smooth(0.05),
        "snr_fill": q_snr_fill(),
        "axis_max": f"SELECT round(CAST(1.05 AS DOUBLE) * max(qsos_sum), 6) AS qsos_sum_axis_max FROM ({q_rate(60)})",
        "log_pairs": f"SELECT * FROM ({q_score('cqww')}) WHERE year = 2024 AND {EVEN}",
        "ingest_two_steps": _ws("cqww", f"""SELECT {L}, datetime, call, band, CAST(is_valid AS INT) AS is_valid,
  qso_points, n_mult, cum_contest_score FROM scored"""),
        "ingest_spot_days": q_spot_clean(),
        "ingest_headers": q_ingest_headers(),
        "spot_rejects": q_spot_rejects(),
        "catalog_cq_links": f"SELECT page_id, item, substr(item, 5) AS mode, substr(item, 1, 4) AS year FROM ({q_cq('<A HREF=\"/([A-Z0-9]+)\">', 'item')})",
        "catalog_cq_options": q_cq_options(),
        "log_table_far_page": q_log_table_far_page(),
        "snr_grid_query": q_snr_grid(*snr, keep="(speed >= 22 OR db = 7) AND band IN (10, 20, 40) AND NOT starts_with(callsign, 'RX3') AND db <> 9"),
        "snr_grid_template": q_snr_grid(["ST0", "ST1"], ["EU", "NA", "AS", "AF"], [10, 20, 40], 5,
                                        on_grid="(epoch_us(datetime) - (SELECT min(epoch_us(datetime)) FROM g)) % 600000000 = 0"),
        "generic_csv": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'",
        "generic_parquet": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'",
        "rollup_rate": q_rate(60),
        "rollup_rate_points": q_rate(30, "qso_points"),
        "rollup_evolution_score": q_evolution("score", 60),
        "rollup_evolution_points_per_qso": q_evolution("points_per_qso", 60),
        "rollup_band_conditions": q_band_conditions(),
        "rollup_cw_speed": _spot_station("round(avg(speed), 6) AS speed"),
        "rollup_spot_counts": _spot_station("count(db) AS counts", rx=rx),
        "rollup_snr_mean": _spot_station("round(avg(db), 6) AS db", 25, rx),
        "spot_years": _wsp("SELECT * REPLACE (2024 AS year) FROM spots WHERE datetime >= TIMESTAMP '2023-11-26'"),
        "log_scan_cqwpx": q_log_scan("cqwpx", "myserial, call, rst, serial"),
        "log_scan_iaru": q_log_scan("iaru", "myexchange, call, rst, exchange"),
        "log_metadata": q_log_header(),
        "generic_io": "SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus FROM orders",
        "prefix_lookup_shuffled": q_prefix_lookup(),
        "log_scan_lines": q_log_scan(),
        "catalog_arrl_years": "SELECT page_id, CAST(page_id AS INT) AS iid, CAST(page_id % 25 + 2000 AS INT) AS year FROM pages",
        "catalog_arrl_links": q_arrl_links(),
        "catalog_arrl_options": f"SELECT callsign, link AS q, 'iaru' AS contest, CAST(iid % 25 + 2000 AS INT) AS year FROM ({q_arrl_links()})",
        "contest_modes": f"SELECT DISTINCT contest, mode FROM ({q_contest_dates()})",
        "transition_labels": _ws("cqww", """SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INT) AS position,
  t AS band_transition_from_previous_call FROM (SELECT DISTINCT band_transition_from_previous_call AS t FROM scored
  WHERE minutes_from_previous_call IS NOT NULL)"""),
        "column_check": q_summary("iaru"),
        "score_page_after": f"SELECT * FROM ({q_score('cqww')}) ORDER BY contest, contest_mode, year, mycall, seq LIMIT 250 OFFSET 500",
    }


def _spot_oracle() -> dict[str, str]:
    rx = ["EU", "NA", "AS", "SA", "OC"]
    return {
        "spot_fill_cont": q_spot_fill_cont(),
        "spot_clean": q_spot_clean(),
        "band_conditions": q_band_conditions(),
        "cw_speed": _spot_station("round(avg(speed), 6) AS speed"),
        "spot_counts": _spot_station("count(db) AS counts", rx=rx),
        "snr_mean": _spot_station("round(avg(db), 6) AS db", rx=rx),
        "closed_receivers": q_closed_receivers(),
        "active_receivers": q_active_receivers(),
        "snr_smooth": q_snr_smooth(),
        "snr_grid": q_snr_grid(["ST0", "ST1", "ST2", "ST3", "ST4"], ["EU", "NA", "AS", "AF"], BANDS, 10),
        "snr_grid_5": q_snr_grid(["ST0", "ST1"], ["EU", "NA", "AS", "AF"], [10, 20, 40], 5),
        "weekends": q_weekends(),
        "contest_dates": q_contest_dates(),
        "prefix_lookup": q_prefix_lookup(),
        "geo": q_geo(),
        "log_scan": q_log_scan(),
        "log_header": q_log_header(),
        "catalog_calls": q_catalog_calls(),
        "catalog_links": q_catalog_links(),
        "catalog_pairs": q_catalog_pairs(),
        "skip_existing": q_skip_existing(),
        "store_reload": q_score("cqww"),
        "prefix": q_prefix(),
        "log_table_page": q_log_table_page(),
        "evolution_score_one_clock": q_evolution("score", 60, "contest, contest_mode"),
        "heatmap_10_stepped": q_heatmap(10, None, 10),
        "direction_12_36": q_direction(12, 36),
        "band_conditions_na": q_band_conditions("NA", 30, ("EU", "AS", "SA", "OC", "AF")),
        "score_cqww_chunked": q_score("cqww"),
        "log_table_cqww_chunked": q_log_table("cqww"),
    }


def oracle_sql() -> dict[str, str]:
    from ragchew.constants import EVOLUTION_FEATURES
    out = {
        "contest_hour": q_contest_hour(),
        "rate": q_rate(60),
        "rate_points": q_rate(30, "qso_points"),
        "rolling_rate": q_rolling_rate(60),
        "log_table_cqww": q_log_table("cqww"),
        "log_table_cqwpx": q_log_table("cqwpx"),
        "log_table_iaru": q_log_table("iaru"),
        "qsos_hour": q_qsos_hour(60),
        "qsos_hour_30": q_qsos_hour(30, ["EU", "NA", "AS", "SA", "OC"]),
        "heatmap": q_heatmap(1),
        "heatmap_10": q_heatmap(10, ["EU", "NA", "AS", "SA", "OC"]),
        "heatmap_pivot": q_heatmap_pivot(),
        "frequency": q_frequency(),
        "direction": q_direction(0, 23),
        "prev_call": q_prev_call(),
        "repeat_hist": q_repeat_hist(5),
    }
    out.update({f"evolution_{f}": q_evolution(f, 60) for f in EVOLUTION_FEATURES})
    out.update(_base_oracle())
    out.update(_spot_oracle())
    out.update(_open_oracle())
    return out


def _base_oracle() -> dict[str, str]:
    return {
        "band": q_band(),
        "score_cqww": q_score("cqww"),
        "summary_cqww": q_summary("cqww"),
        "score_cqwpx": q_score("cqwpx"),
        "summary_cqwpx": q_summary("cqwpx"),
        "score_iaru": q_score("iaru"),
        "summary_iaru": q_summary("iaru"),
    }
