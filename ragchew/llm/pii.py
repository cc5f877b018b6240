"""Personal data by candidate spans and gradient boosting.

Fixed rules find the base spans (``base_spans``); they always stay. Around digits and at signs,
generators of high recall propose further spans of every document, which may overlap. Boosted trees score each
by its format and its context, and a threshold for each kind, calibrated on documents that the trees have not seen, selects
what to redact: best score first, without overlaps among themselves or with base spans.

The trees learn from the proposals of all documents, as Spark jobs: a level of a tree is one pass of sums over the
distinct binned examples (``histograms``). Examples are labelled by their
normal form (``normal_form``: words for signs as in "(at)" and "(dot)" read as signs, the dialling prefix 00 as +, separators of a card
number dropped): a proposal whose normal form is personal data by the fixed rules is positive, any other negative. So the spans
that come beside the base are those written in a way the fixed rules do not read. Training and calibration share no document.

Edge cases: null and empty texts have no spans; places are code points, ends exclusive; without examples
of both classes nothing is added to the base spans, and to a kind whose calibration does not reach ``PRECISION`` neither; rows
that repeat are treated alike, each by itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragchew.llm.common import materialize, text_batches

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.95
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 16
# Parts of one in which gradients are added, and in which scores are compared with thresholds.
STEP, GRID = 1 << 20, 1 << 14
LIMIT = 4 << 20

# The base patterns (possessive where that cannot change a match).
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SEED = re.compile(r"[0-9@]")
# what the generators propose around seeds, by kind
GENERATORS = [
    (0, re.compile(r"[^\s@<>()\"']{1,64}\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]{1,64}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,64}){1,4}")),
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,128}[A-Za-z0-9]")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){2,4}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,21}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])")),
    (3, re.compile(r"(?:\+|\b00)[0-9][ ().0-9-]{4,24}[0-9]")),
    (3, re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ ./-]?[0-9]{2,5}(?![0-9A-Za-z])")),
]
REACH = 72


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and not overlapping within a kind."""
    if not text:
        return []
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if _octets(m.group()):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def proposals(text: str | None) -> list[tuple[int, int, int]]:
    """Distinct (kind, start, end) of all generators, in order; they may overlap."""
    if not text:
        return []
    found, begin, end = set(), None, None

    def search(a: int, b: int) -> None:
        for kind, pattern in GENERATORS:
            for m in pattern.finditer(text, max(a - REACH, 0), min(b + REACH, len(text))):
                found.add((kind, m.start(), m.end()))
    for m in SEED.finditer(text):
        p = m.start()
        if begin is None:
            begin = end = p
        elif p - end <= REACH:
            end = p
        else:
            search(begin, end)
            begin = end = p
    if begin is not None:
        search(begin, end)
    return sorted(found)


WORD_AT = re.compile(r"\s?(?:\(at\)|\[at\])\s?")
WORD_DOT = re.compile(r"\s?(?:\(dot\)|\[dot\])\s?")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def normal_form(kind: int, span: str) -> str:
    """A span as the fixed rules would have it."""
    if kind == 0:
        return WORD_DOT.sub(".", WORD_AT.sub("@", span))
    if kind == 2:
        return "".join(c for c in span if "0" <= c <= "9")
    if kind == 3 and span.startswith("00"):
        return "+" + span[2:]
    return span


def is_personal(kind: int, span: str) -> bool:
    """Whether the normal form of a span is personal data of its kind, all of it."""
    form = normal_form(kind, span)
    if kind == 0:
        return EMAIL.fullmatch(form) is not None
    if kind == 1:
        return IP.fullmatch(form) is not None and _octets(form)
    if kind == 2:
        return CARD.fullmatch(form) is not None and 13 <= len(form) <= 19 and luhn(form)
    return PHONE.fullmatch(form) is not None and 9 <= sum("0" <= c <= "9" for c in form) <= 15


def _octets(span: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of a span and its surroundings as numbers."""
    span = text[start:end]
    before, after = text[max(start - 24, 0):start], text[end:end + 12]
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g] or [0]
    prev, nxt = (before[-1:] or " "), (after[:1] or " ")

    def char(c: str) -> float:
        return 0.0 if c.isspace() else 1.0 if c.isalpha() else 2.0 if "0" <= c <= "9" else 3.0
    word = re.search(r"([^\W\d_]+)\W*$", before)
    number = "".join(c for c in span if "0" <= c <= "9")
    parts = [int(g) for g in re.split(r"[^0-9]+", span) if 0 < len(g) < 10]
    return [float(12 < digits < 20 and luhn(number)), float(min(max(parts, default=0), 1000)), float(span.startswith("00")),
            float("(at)" in span or "[at]" in span), float(span.count("@")), float(span[-1].isalnum()),
            float(kind), float(end - start), float(digits), float(letters), float(len(groups)), float(groups[0]),
            float(groups[-1]), float(max(groups)), float(min(groups)), float(span.count(".")), float(span.count("-")),
            float(span.count(" ")), float(span.count("(")), float(span[0] == "+"), float("@" in span),
            float(span.rsplit(".", 1)[-1].isalpha()) if "." in span else -1.0, char(prev), char(nxt),
            float(prev in ".-+@/"), float(nxt in ".-@/%"), float(len(word.group(1))) if word else 0.0,
            float(sum("0" <= c <= "9" for c in before)), float(sum("0" <= c <= "9" for c in after)),
            float(before.rstrip().endswith((":", "=", "#")))]


class Boosted:
    """Boosted trees of logistic loss over binned features; trees are full, of fixed depth."""

    def __init__(self, trees: list, cuts: list, prior: float):
        self.trees, self.cuts, self.prior = trees, cuts, prior

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v) for c, v in zip(self.cuts, x.T)], 1)

    def logits(self, b: np.ndarray) -> np.ndarray:
        f = np.full(len(b), self.prior)
        for splits, leaves in self.trees:
            f += leaves[descend(b, splits)]
        return f

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(self.bins(x))))


def descend(b: np.ndarray, splits: list) -> np.ndarray:
    """The node of each binned row below the given levels of a tree."""
    node = np.zeros(len(b), np.int64)
    for feature, cut in splits:
        node = node * 2 + (b[np.arange(len(b)), feature[node]] > cut[node])
    return node


def quantiles(value: np.ndarray, n: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between ``bins`` parts of equal size of ``value`` (ascending), each of which is there ``n`` times."""
    upto = np.cumsum(n)
    at = np.rint((upto[-1] - 1) * np.linspace(0, 1, bins + 1)[1:-1]).astype(np.int64)
    return np.unique(value[np.searchsorted(upto, at, side="right")])


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The proposals of all documents as distinct rows of kind and features (x), label (y), whether their documents
    calibrate (held: a fourth of them, by a hash of id and text), and how many there are (n)."""
    def run(batches):
        for batch in text_batches(batches, "text", LIMIT):
            rows, label, held = [], [], []
            for text, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = set(base_spans(text))
                for kind, start, end in proposals(text):
                    rows.append([float(kind), *features(text, kind, start, end)])
                    label.append(int((kind, start, end) in base or is_personal(kind, text[start:end])))
                    held.append(o // 7 % 4 == 0)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(label, pa.int32()),
                                              pa.array(held, pa.bool_())], ["x", "y", "held"])

    h = F.pmod(F.xxhash64(id_col, text_col, F.lit(23)), F.lit(1 << 30))
    spans = docs.select(F.col(text_col).alias("text"), h.alias("o")).mapInArrow(run, "x array<double>, y int, held boolean")
    return spans.groupBy("x", "y", "held").agg(F.count(F.lit(1)).alias("n"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def binned(train: DataFrame, cuts: list) -> DataFrame:
    """The distinct binned rows (b, a byte a feature) with their label y and number n."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                b = Boosted([], cuts, 0.0).bins(_matrix(batch.column(0))[:, 1:]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), batch.column(1), batch.column(2)],
                                                 ["b", "y", "n"])
    return train.select("x", "y", "n").mapInArrow(run, "b binary, y int, n long").groupBy("b", "y").agg(F.sum("n").alias("n"))


def histograms(rows: DataFrame, model: Boosted, splits: list, width: int, bins: int = BINS) -> np.ndarray:
    """Sums of gradient and curvature of all rows by node of the level below ``splits``, feature and bin, in whole numbers of
    1 / ``STEP``, so that they do not depend on the order of adding. Each task sends its sums; their size depends on
    the tree alone."""
    n = 1 << len(splits)

    def run(batches):
        total = np.zeros((2, n, width, bins + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int64)
            y, times = (np.asarray(batch.column(i), dtype=np.int64) for i in (1, 2))
            p = 1 / (1 + np.exp(-model.logits(b)))
            node = descend(b, splits)
            for sums, value in zip(total, (y - p, p * (1 - p))):
                whole = np.rint(value * STEP).astype(np.int64) * times
                for j in range(width):
                    np.add.at(sums, (node, j, b[:, j]), whole)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = np.zeros((2, n, width, bins + 1), np.int64)
    for part in rows.mapInArrow(run, "sums binary").collect():
        total += np.frombuffer(part.sums, np.int64).reshape(total.shape)
    return total / STEP


def grow(rows: DataFrame, model: Boosted, width: int, depth: int = DEPTH, rate: float = RATE, bins: int = BINS,
         ridge: float = 5.0) -> tuple[list, np.ndarray]:
    """The next tree of ``model``, level by level from sums over all rows: its splits and leaves."""
    splits: list = []
    for _ in range(depth):
        g, h = histograms(rows, model, splits, width, bins)
        n = len(g)
        gs, hs = g.cumsum(2), h.cumsum(2)
        gt, ht = gs[:, :, -1:], hs[:, :, -1:]
        won = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
        feature, cut = np.zeros(n, np.int64), np.full(n, bins + 1)
        left = np.stack([gt[:, 0, 0], ht[:, 0, 0]], 1)
        right = np.zeros((n, 2))
        for k in range(n):
            j, c = np.unravel_index(won[k].argmax(), won[k].shape)
            if won[k, j, c] > 1e-9:
                feature[k], cut[k], left[k] = j, c, (gs[k, j, c], hs[k, j, c])
                right[k] = gt[k, j, 0] - gs[k, j, c], ht[k, j, 0] - hs[k, j, c]
        splits.append((feature, cut))
    ends = np.stack([left, right], 1).reshape(-1, 2)
    return splits, rate * ends[:, 0] / (ends[:, 1] + ridge)


def thresholds(counts: list, precision: float = PRECISION) -> list[float]:
    """For each kind the least score from which on ``precision`` of the examples are positive; 2 if there is none.
    ``counts``: rows of kind, score in steps of 1 / ``GRID`` (rounded down), examples and positive ones."""
    out = []
    for k in range(len(KINDS)):
        most = sorted(((s, n, good) for kind, s, n, good in counts if kind == k), reverse=True)
        n, good = (np.cumsum([row[i] for row in most]) for i in (1, 2))
        last = np.flatnonzero(good >= precision * n)
        out.append(float(max(most[last[-1]][0] / GRID, 0.5)) if len(last) else 2.0)
    return out


def calibrate(test: DataFrame, model: Boosted) -> list[float]:
    """The thresholds of all held rows: they are counted by kind and score, on the grid of scores."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                both = _matrix(batch.column(0))
                step = np.floor(model.score(both[:, 1:]) * GRID).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].astype(np.int32)), pa.array(step), batch.column(1), batch.column(2)],
                                                 ["kind", "step", "y", "n"])
    counts = test.select("x", "y", "n").mapInArrow(run, "kind int, step long, y int, n long").groupBy("kind", "step").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good"))
    return thresholds([tuple(r) for r in counts.collect()])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> dict | None:
    """Trees and thresholds from the proposals of all documents. The driver sees sums and counts only: of values by feature,
    of gradients by node, feature and bin, of held examples by kind and score."""
    spans = materialize(examples(docs, id_col, text_col), "pii-spans")
    size = {(r.held, r.y): r.n for r in spans.groupBy("held", "y").agg(F.sum("n").alias("n")).collect()}
    if any((False, y) not in size for y in (0, 1)) or not any(held for held, _ in size):
        return None
    train = spans.where(~F.col("held"))
    # few values a feature: all are lengths and counts within a span and its surroundings
    values = train.select(F.posexplode("x").alias("j", "v"), "n").groupBy("j", "v").agg(F.sum("n").alias("n"))
    values = values.toPandas().sort_values(["j", "v"])
    cuts = [quantiles(v.v.to_numpy(), v.n.to_numpy()) for j, v in values.groupby("j") if j]
    rows = materialize(binned(train, cuts), "pii-bins")
    mean = size[False, 1] / (size[False, 0] + size[False, 1])
    model = Boosted([], cuts, float(np.log((mean + 1e-6) / (1 - mean + 1e-6))))
    for _ in range(trees):
        model.trees.append(grow(rows, model, len(cuts)))
    return {"trees": model.trees, "cuts": cuts, "prior": model.prior, "least": calibrate(spans.where("held"), model)}


def select_spans(text: str | None, model: Boosted | None, least: list[float]):
    """Base spans, and all spans in order of kind and start."""
    base = base_spans(text)
    if model is None:
        return base, base
    known = set(base)
    more = [s for s in proposals(text) if s not in known]
    if not more:
        return base, base
    score = model.score(np.array([features(text, *s) for s in more]))
    every = list(base)
    for i in sorted(range(len(more)), key=lambda i: (-score[i], more[i])):
        kind, start, end = more[i]
        if score[i] >= least[kind] and not any(a < end and start < z for _, a, z in every):
            every.append(more[i])
    return base, sorted(every)


def find_spans(docs: DataFrame, fitted: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and selected spans of every row: doc_id, text, base and spans (arrays of kind, start, end)."""
    box = docs.sparkSession.sparkContext.broadcast(fitted)
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        got = box.value
        model = Boosted(got["trees"], got["cuts"], got["prior"]) if got else None
        least = got["least"] if got else [2.0]
        for batch in text_batches(batches, "text", LIMIT):
            both = [select_spans(t, model, least) for t in batch.column(1).to_pylist()]
            out = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans[i]] for spans in both], pa.list_(kind))
                   for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], ["doc_id", "text", "base", "spans"])

    spans = "array<struct<kind:int,start:int,end:int>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id long, text string, base {spans}, spans {spans}")


def redact(docs: DataFrame, **options) -> DataFrame:
    """Every row with its spans and its text with each span replaced by its kind: doc_id, base, spans, redacted."""
    found = find_spans(docs, fit(docs, **options))
    def cut(s, x):
        return F.struct(F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))),
                                 F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), F.lit(">")).alias("text"),
                        F.greatest(s["at"], x["end"]).alias("at"))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                                   x["kind"].alias("kind"))))
    walk = F.aggregate(ordered, F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), cut,
                       lambda s: F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return found.withColumn("redacted", walk).drop("text")


def detect(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of the base spans, and all spans as text."""
    found = find_spans(docs, fit(docs, **options))

    def joined(spans: str):
        name = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(len(KINDS))],
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
