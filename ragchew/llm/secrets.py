"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

The pattern spans are the base. Beyond them, a candidate is a maximal run of token characters. Its character class (hexadecimal,
letters and digits, or base64) sets the window and the least entropy. A window slides over the candidate; as a
character enters and one leaves, two counts change, and with them the sum of c * log2(c) over the counts, from which the
entropy follows. The sums are integers (units of 2**-20), so they carry no rounding from one window to the next. Windows at or above the class's limit
that touch or overlap become one span. Candidates that an allow-list pattern or value matches are suppressed, and so are spans within a base span.

All of it is one expression on the row: no shuffle, no user-defined function, and memory in proportion to one text.

Results for odd input. A null text counts as empty; an empty text has no spans. Offsets are code points, the end exclusive. Long
texts are read whole. Repeated rows and rows without id are scanned like others. An empty table gives no rows. The user's columns
come back untouched: if ``secrets`` is taken, the result column gets underscores until its name is free.
"""

from __future__ import annotations

from math import ceil, floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragchew.llm.common import free_name, let


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed patterns, in the order of ties; the number is the group whose length counts.
NAMES = "|".join([either_case("password"), either_case("passwd"), either_case("secret"), either_case("token"),
                  either_case("api") + "_?" + either_case("key")])
PATTERNS = {
    "assign": (rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs of 24 and more: the shorter runs of [0-9a-f]+ are dropped anyway
}
BASE = tuple(PATTERNS)

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# kind: (what the whole candidate matches, alphabet, window, least entropy in bits); the first class that matches holds
CLASSES = {
    "entropy_hex": (r"^[0-9A-Fa-f]+$", DIGITS + LOWER[:6], 16, 2.75),
    "entropy_alnum": (r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, 20, 3.6),
    "entropy_base64": (r"^[A-Za-z0-9+/_-]+$", DIGITS + UPPER + LOWER + "+/_-", 20, 3.8),
}
# Candidates that are no secrets: words, numbers and words with a number behind them, alone or joined (no letter follows a
# digit), UUIDs, runs of the alphabet, samples.
ALLOW = (
    r"^(?!.*[0-9][A-Za-z])",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"0123456789|abcdefgh|ABCDEFGH",
    r"EXAMPLE|[Ee]xample|[Xx]{6}",
)
UNIT = 1 << 20
PREFIX_BLOCK = 256


def weight(count: int) -> int:
    """c * log2(c) in units."""
    return round(count * log2(count) * UNIT) if count else 0


def most_weight(window: int, bits: float) -> int:
    """The largest sum of weights of a window whose entropy is at least ``bits``."""
    return floor(window * (log2(window) - bits) * UNIT)


def running_starts(sizes: Column) -> Column:
    """For an array of sizes, the sum of those before each. Blocks keep the arrays that grow short."""
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")

    def inside(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")),
                           lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
                           lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / PREFIX_BLOCK).cast("int")),
                         lambda b: F.slice(sizes, b * PREFIX_BLOCK + 1, F.lit(PREFIX_BLOCK)))
    nested = F.aggregate(
        blocks, F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda a, block: F.struct((a["at"] + F.aggregate(block, zero, lambda t, x: t + x)).alias("at"),
                                  F.concat(a["out"], F.array(inside(block, a["at"]))).alias("out")),
        lambda a: a["out"])
    return F.flatten(nested)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value, part), where part is the group."""
    def place(found: Column) -> Column:
        sizes = F.zip_with(found["gaps"], found["values"],  # as many gaps as matches, and one more
                           lambda g, v: (F.length(g) + F.coalesce(F.length(v), F.lit(0))).cast("long"))
        return let(F.struct(found["gaps"].alias("gaps"), found["values"].alias("values"), found["parts"].alias("parts"),
                            running_starts(sizes).alias("starts")), lambda f: F.transform(
            f["values"], lambda v, i: F.struct(
                (f["starts"][i] + F.length(f["gaps"][i])).alias("start"),
                (f["starts"][i] + F.length(f["gaps"][i]) + F.length(v)).alias("end"),
                v.alias("value"), f["parts"][i].alias("part"))))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else values
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), values.alias("values"), parts.alias("parts"))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string,part:string>>")
    return F.when(text.rlike(pattern), let(found, place)).otherwise(nothing)


def entropy_spans(value: Column, alphabet: str, window: int, bits: float) -> Column:
    """Spans (start, end) of ``value`` covered by windows of at least ``bits`` of entropy."""
    weights = F.array(*[F.lit(weight(c)).cast("long") for c in range(window + 1)])
    limit = most_weight(window, bits)

    def step(codes: Column, a: Column, i: Column) -> Column:
        enters, leaves = codes[i], F.when(i >= window, F.get(codes, i - window)).otherwise(0)
        grown, shrunk = a["counts"][enters - 1], F.get(a["counts"], leaves - 1)
        change = (weights[grown + 1] - weights[grown]
                  + F.when(leaves > 0, weights[shrunk - 1] - weights[shrunk]).otherwise(0))
        total = F.when(enters == leaves, a["total"]).otherwise(a["total"] + change)
        counts = F.when(enters == leaves, a["counts"]).otherwise(F.transform(a["counts"], lambda c, j: (
            c + F.when(j == enters - 1, 1).when(j == leaves - 1, -1).otherwise(0))))
        begin = i - (window - 1)
        high = (begin >= 0) & (total <= limit)
        joins = a["end"] >= begin  # the open span, if any, reaches the window
        closes = high & ~joins & (a["end"] > 0)
        return F.struct(
            counts.alias("counts"), total.alias("total"),
            F.when(closes, F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))))
            .otherwise(a["done"]).alias("done"),
            F.when(high & ~(joins & (a["end"] > 0)), begin).otherwise(a["start"]).alias("start"),
            F.when(high, i + 1).otherwise(a["end"]).alias("end"))

    def slide(codes: Column) -> Column:
        zero = F.lit(0).cast("int")
        start = F.struct(
            F.array_repeat(zero, len(alphabet)).alias("counts"), F.lit(0).cast("long").alias("total"),
            F.array().cast("array<struct<start:int,end:int>>").alias("done"), zero.alias("start"), zero.alias("end"))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1), start, lambda a, i: step(codes, a, i),
            lambda a: F.when(a["end"] > 0, F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))))
            .otherwise(a["done"]))

    folded = value if len(alphabet) > 16 else F.lower(value)
    codes = F.transform(F.split(folded, ""), lambda c: F.instr(F.lit(alphabet), c))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    # an entropy of b bits takes 2**b different characters
    return let(codes, lambda c: F.when(
        (F.size(c) >= window) & (F.size(F.array_distinct(c)) >= ceil(2 ** bits - 1e-9)), slide(c)).otherwise(nothing))


def high_entropy(text: Column, allow: tuple[str, ...] = ALLOW, allowed: tuple[str, ...] = ()) -> Column:
    """Spans of high entropy in the candidates of a text that the allow-list does not hold."""
    def suppressed(v: Column) -> Column:
        out = v.isin(list(allowed)) if allowed else F.lit(False)
        for pattern in allow:
            out = out | v.rlike(pattern)
        return out

    def of(c: Column) -> Column:
        found = None
        for kind, (whole, alphabet, window, bits) in CLASSES.items():
            made = F.transform(entropy_spans(c["value"], alphabet, window, bits), _lift(c, kind))
            found = F.when(c["value"].rlike(whole), made) if found is None else found.when(c["value"].rlike(whole), made)
        return found

    candidates = F.filter(matches(text, CANDIDATE), lambda c: ~suppressed(c["value"]))
    return F.flatten(F.transform(candidates, of))


def _lift(candidate: Column, kind: str):
    """A span of the candidate as a span of the text."""
    def lift(s: Column) -> Column:
        return F.struct((candidate["start"] + s["start"]).alias("start"), F.lit(list(PATTERNS | CLASSES).index(kind)).alias("nr"),
                        (candidate["start"] + s["end"]).alias("end"), F.lit(kind).alias("kind"),
                        F.substring(candidate["value"], s["start"] + 1, s["end"] - s["start"]).alias("value"))
    return lift


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns."""
    def of(nr: int, kind: str) -> Column:
        pattern, group, least = PATTERNS[kind]
        return F.transform(
            F.filter(matches(text, pattern, group), lambda m: F.length(m["part"]) >= least),
            lambda m: F.struct(m["start"].alias("start"), F.lit(nr).alias("nr"), m["end"].alias("end"), F.lit(kind).alias("kind"),
                               m["value"].alias("value")))

    return F.concat(*[of(nr, kind) for nr, kind in enumerate(BASE)])


def find_secrets(df: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ALLOW, allowed: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``secrets``: all spans (start, nr, end, kind, value) by start, then kind as listed.

    ``allow`` are patterns and ``allowed`` whole values of candidates that are no secrets; base spans are not suppressed.
    """
    out, text, base = free_name(df, "secrets"), free_name(df, "secrets_text"), free_name(df, "secrets_base")
    scanned = df.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    scanned = scanned.withColumn(base, base_spans(F.col(text)))
    added = F.filter(high_entropy(F.col(text), allow, allowed), lambda s: ~F.exists(
        F.col(base), lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return scanned.withColumn(out, F.array_sort(F.concat(F.col(base), added))).drop(text, base)


def digest_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, their digest and all spans of every document."""
    found = find_secrets(docs.select(id_col, text_col), text_col)
    s = F.col("secrets")
    return found.select(
        id_col, *[F.size(F.filter(s, lambda x: x["nr"] == nr)).cast("long").alias(f"n_{kind}") for nr, kind in enumerate(BASE)],
        F.sha2(digest_text(F.filter(s, lambda x: x["nr"] < len(BASE))), 256).alias("base_sha256"), digest_text(s).alias("spans"))
