"""Enrichment and scoring of contest logs, all logs at once.

``score_logs(raw, contest, prefixes)`` is the whole ingest feature pipeline:
band -> country lookup (and drop unknown calls) -> geometry -> contest hour ->
(prefix for CQWPX) -> first-occurrence flags -> points -> running totals ->
previous contact with the same call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragchew.constants import LOG_KEY, ROWS_PER_CHUNK
from ragchew.functions.bands import add_band
from ragchew.functions.callsign import callsign_prefix
from ragchew.functions import geo
from ragchew.functions.timecols import contest_saturday, hours_between, ntz_micros
from ragchew.operators.lookup import ATTRS, PrefixTable, answer_calls, prepare_prefixes, with_answers
from ragchew.session import configure, materialize, tasks_for
from ragchew.operators.scan import first_occurrence, chunked_running, add_chunk, CHUNK

LOW_BANDS = [40, 80, 160]


def _ne(a: str, b: str) -> Column:
    """pandas ``!=``: true when either side is missing."""
    return ~F.col(a).eqNullSafe(F.col(b)) | F.col(a).isNull() | F.col(b).isNull()


# --- scoring rules (G2-G4) ---------------------------------------------------

def cqww_points() -> Column:
    """Other continent 3; else own continent NA 2; else other country 1; else 0."""
    return (F.when(_ne("mycontinent", "continent"), 3)
            .when(F.col("mycontinent") == "NA", 2)
            .when(_ne("country", "mycountry"), 1)
            .otherwise(0))


def cqwpx_points() -> Column:
    """Other continent 3 (6 on 40/80/160); same continent 1 (2 on 40/80/160)."""
    low = F.col("band").isin(LOW_BANDS).cast("int")
    return F.when(_ne("mycontinent", "continent"), 3 + 3 * low).otherwise(1 + low)


def iaru_points() -> Column:
    """Other continent 5; other exchange & same country 1; other exchange 3; else 1."""
    diff_ex = _ne("myexchange", "exchange")
    return (F.when(_ne("mycontinent", "continent"), 5)
            .when(diff_ex & (F.col("country") == F.col("mycountry")), 1)
            .when(diff_ex, 3)
            .otherwise(1))


CONTESTS = {
    "cqww": {
        "mults": {"is_valid": ["band", "call"], "is_dxcc": ["band", "country"],
                  "is_zone": ["band", "zone"]},
        "mult_cols": ["is_dxcc", "is_zone"],
        "points": cqww_points,
        "needs_prefix": False,
    },
    "cqwpx": {
        "mults": {"is_valid": ["band", "call"], "is_mult": ["prefix"]},
        "mult_cols": ["is_mult"],
        "points": cqwpx_points,
        "needs_prefix": True,
    },
    "iaru": {
        "mults": {"is_valid": ["band", "call"], "is_mult": ["band", "exchange"]},
        "mult_cols": ["is_mult"],
        "points": iaru_points,
        "needs_prefix": False,
    },
}


# --- enrichment ----------------------------------------------------------------

STATION_ATTRS = ["country", "continent", "latitude", "longitude"]


def call_answers(raw: DataFrame, prefixes: DataFrame | PrefixTable) -> tuple[DataFrame, DataFrame]:
    """J5 + J6: the answers for the distinct worked calls and for the distinct own calls of ``raw`` with the number of
    their contacts, looked up together and written once, a folder each: a filter on one column that Spark carries over to its answers must not meet the other's calls."""
    ends = F.array(*[F.struct(F.col(c).alias("__lk_call"), F.lit(c).alias("__end")) for c in ("call", "mycall")])
    calls = raw.select(F.explode(ends).alias("e")).select("e.*").where(F.col("__lk_call").isNotNull())
    calls = calls.groupBy("__lk_call", "__end").agg(F.count(F.lit(1)).alias("__contacts"))
    found = materialize(answer_calls(calls, prepare_prefixes(prefixes)), "lookup", ["__end"])
    return tuple(found.where(F.col("__end") == c).drop("__end") for c in ("call", "mycall"))


def add_call_info(df: DataFrame, answers: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Country data of the worked station; unknown calls are dropped."""
    return with_answers(df, F.col("call"), answers[0], ATTRS).where(F.col("country").isNotNull())


def add_station_info(df: DataFrame, answers: tuple[DataFrame, DataFrame]) -> DataFrame:
    """J6 + G1: own-station country data, grid locators, distances and
    headings (short and long path)."""
    out = with_answers(df, F.col("mycall"), answers[1], STATION_ATTRS, "my")
    out = out.withColumns({
        "locator": geo.maidenhead("latitude", "longitude"),
        "mylocator": geo.maidenhead("mylatitude", "mylongitude"),
    })
    lat1, lon1 = geo.locator_center(F.col("mylocator"))
    lat2, lon2 = geo.locator_center(F.col("locator"))
    out = out.withColumns({"distance": geo.great_circle_km(lat1, lon1, lat2, lon2),
                           "heading": geo.initial_bearing(lat1, lon1, lat2, lon2)})
    out = out.withColumns({"distance_lp": geo.long_path_km(F.col("distance")),
                           "heading_lp": geo.long_path_heading(F.col("heading"))})
    return out.drop("mylatitude", "mylongitude")


def add_dxcc_info(df: DataFrame, prefixes: DataFrame | PrefixTable) -> DataFrame:
    """J5 + J6 + G1: country data of both stations, unknown calls dropped,
    locators, distances and headings (short and long path)."""
    configure(df.sparkSession)
    answers = call_answers(df, prefixes)
    return add_station_info(add_call_info(df, answers), answers)


# Hash columns of the per-log plan.
PER_LOG_HASH = ["mycall", "year"]
# Contacts of a task of the per-log plan; they are wide, and its windows hold two sorts of them.
CONTACTS_PER_TASK = 64_000


def score_logs(raw: DataFrame, contest: str, prefixes: DataFrame | PrefixTable,
               log_key: list[str] | None = None, strategy: str = "per_log",
               rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The full enrichment + scoring pipeline for every log in ``raw``.

    ``strategy``: ``per_log`` hashes the contacts by log once and computes
    every per-log step with window functions (one shuffle); ``chunked``
    splits logs into chunks of ``seq`` so no task holds a whole log (for
    logs too large for one task). Both give the same rows; a contest lasts
    two days, so ``per_log`` is the default.
    """
    if strategy not in ("per_log", "chunked"):
        raise ValueError(f"unknown strategy: {strategy}")
    rules = CONTESTS[contest]
    key = log_key or LOG_KEY
    configure(raw.sparkSession)
    answers = call_answers(raw, prefixes)
    df = add_call_info(add_band(raw), answers)
    if rules["needs_prefix"]:
        df = df.withColumn("prefix", callsign_prefix("call"))
    if strategy == "per_log":
        return _score_per_log(df, rules, key, answers)
    return _score_chunked(df, rules, key, answers, rows_per_chunk)


def _finish(df: DataFrame) -> DataFrame:
    prev_score = ((F.col("cum_qso_points") - F.col("qso_points"))
                  * (F.col("cum_mult") - F.col("n_mult")))
    score = F.col("cum_qso_points") * F.col("cum_mult")
    per_qso = F.col("cum_qso_points") / F.nullif(F.col("cum_valid_qsos"), F.lit(0))
    worth = F.col("cum_qso_points") / F.nullif(F.col("cum_mult"), F.lit(0))
    return df.withColumns({
        "hour": hours_between("datetime", contest_saturday("__log_start")),
        "cum_contest_score": score,
        "cum_points_per_qso": per_qso,
        "diff_contest_score": F.when(F.col("__row_in_log") == 1, F.lit(0))
                               .otherwise(score - prev_score).cast("double"),
        "mult_worth_points": worth,
        "mult_worth_qsos": worth / F.nullif(per_qso, F.lit(0.0)),
    }).drop("__log_start", "__row_in_log")


def _sums(contest_rules) -> dict[str, Column]:
    sums = {
        "cum_qso_points": F.col("qso_points").cast("long"),
        "cum_mult": F.col("n_mult").cast("long"),
        "cum_valid_qsos": F.col("is_valid").cast("long"),
    }
    if "is_dxcc" in contest_rules["mults"]:
        sums["cum_dxcc"] = F.col("is_dxcc").cast("long")
        sums["cum_zone"] = F.col("is_zone").cast("long")
    return sums


def _score_per_log(df, rules, key, answers) -> DataFrame:
    """One shuffle by log; flags, running totals, log start and the previous
    contact with the same call are windows over that partitioning.

    The shuffle hashes (station, year): a subset of every window's keys, so
    all windows reuse it (constant key columns are dropped from window keys
    by the optimizer and would break the match)."""
    contacts = answers[0].agg(F.sum("__contacts")).first()[0] or 0  # those of unknown calls are dropped
    if contacts > CONTACTS_PER_TASK:
        df = df.repartition(tasks_for(df.sparkSession, contacts, CONTACTS_PER_TASK), *PER_LOG_HASH)
    else:
        df = df.repartition(*PER_LOG_HASH)
    df = add_station_info(df, answers)
    df = df.withColumn("__potential", rules["points"]())
    df = df.withColumns({
        name: (F.row_number().over(Window.partitionBy(*key, *cols).orderBy("seq")) == 1).cast("int")
        for name, cols in rules["mults"].items()})
    df = df.withColumns({
        "is_valid": F.col("is_valid") == 1,
        "qso_points": F.when(F.col("is_valid") == 1, F.col("__potential")).otherwise(0),
        "n_mult": sum((F.col(c) for c in rules["mult_cols"]), F.lit(0)),
    }).drop("__potential")
    run = (Window.partitionBy(*key).orderBy("seq")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumns({
        **{name: F.sum(value).over(run) for name, value in _sums(rules).items()},
        "__row_in_log": F.row_number().over(Window.partitionBy(*key).orderBy("seq")),
        "__log_start": F.min("datetime").over(Window.partitionBy(*key)),
    })
    df = _finish(df)
    w = Window.partitionBy(*key, "call", "is_valid").orderBy("seq")
    minutes = (ntz_micros("datetime") - ntz_micros(F.lag("datetime").over(w))) / F.lit(60_000_000.0)
    df = df.withColumns({
        "minutes_from_previous_call": F.when(F.col("is_valid"), minutes),
        "band_from_previous_call": F.when(F.col("is_valid"), F.lag("band").over(w)),
    })
    return df.withColumn(
        "band_transition_from_previous_call",
        F.concat(F.coalesce(F.col("band_from_previous_call"), F.lit(-1)).cast("string"),
                 F.lit(" → "), F.col("band").cast("string")))


def _score_chunked(df, rules, key, answers, rows_per_chunk=ROWS_PER_CHUNK) -> DataFrame:
    """Skew-proof plan: flags from partial aggregates joined back on the row
    key, running totals per chunk plus chunk offsets."""
    # The enriched rows feed the flag aggregates, the main branch and the
    # chunk totals: write them once to the shared checkpoint folder; every
    # branch scans only the columns it needs.
    df = materialize(add_chunk(df, rows_per_chunk=rows_per_chunk), "enriched")
    flags_input = df
    df = add_station_info(df, answers)
    df = df.withColumn("__potential", rules["points"]())
    df = first_occurrence(df, key, rules["mults"], source=flags_input,
                          rows_per_chunk=rows_per_chunk)
    df = df.withColumns({
        "is_valid": F.col("is_valid").cast("boolean"),
        "qso_points": F.when(F.col("is_valid") == 1, F.col("__potential")).otherwise(0),
        "n_mult": sum((F.col(c) for c in rules["mult_cols"]), F.lit(0)),
    }).drop("__potential")
    df = chunked_running(df, key, "seq", _sums(rules), log_mins={"__log_start": F.col("datetime")},
                         rows_per_chunk=rows_per_chunk)
    df = _finish(df).drop(CHUNK)
    return add_previous_call_info(df, key)


def add_previous_call_info(df: DataFrame, log_key: list[str] | None = None) -> DataFrame:
    """For valid rows, minutes since the same call's previous valid contact,
    that contact's band and the text ``prev → band`` (-1 when none).

    Valid rows are unique per (log, band, call), so a (log, call) window holds
    at most one of them per band. Rows that are not valid are kept apart by their number, one to a window.
    """
    key = log_key or LOG_KEY
    apart = F.when(F.col("is_valid"), F.lit(-1).cast("long")).otherwise(F.col("seq").cast("long"))
    w = Window.partitionBy(*key, "call", apart).orderBy("seq")
    out = df.withColumns({
        "minutes_from_previous_call":
            (ntz_micros("datetime") - ntz_micros(F.lag("datetime").over(w))) / F.lit(60_000_000.0),
        "band_from_previous_call": F.lag("band").over(w),
    })
    return out.withColumn(
        "band_transition_from_previous_call",
        F.concat(F.coalesce(F.col("band_from_previous_call"), F.lit(-1)).cast("string"),
                 F.lit(" → "), F.col("band").cast("string")))
