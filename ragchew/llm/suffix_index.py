"""Removing long repeated byte strings with a logarithmic family of suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed. Suffixes are
sampled so that no repeat is missed: in each window of ``LENGTH`` bytes the run of ``GRAM`` bytes
with the least hash (the last of equals) is its anchor, and equal windows have equal anchors in
equal places. All windows with one anchor form a *stretch*: the bytes from the
first window's start to the last one's end.

* Stretches are dealt to tasks by the hash of their anchor, which is a range of the whole
  suffix index. In a task, each batch of documents gets a sorted array of its suffixes (anchor, stretch). It is
  merge-scanned against the arrays of the levels that exist, for anchors in common, and becomes a level of its
  own; two levels of the same size class are merged into one of the next, so that n batches leave about log n levels.
* An anchor that holds one suffix in ``2 * HOT`` or more is dealt to ``SALTS`` tasks, by text and place. Such a
  task sees a part of its places, so it takes the anchor as one with different stretches. Which anchors these are is counted
  first, from all texts: batches report those with a ``2 * HOT``-th of their suffixes, so one with a ``HOT``-th of all is
  reported with half of its places at least, and no more than ``2 * HOT`` can reach that.
* An anchor in one place only: none of its windows repeats. The same whole stretch in another place: all its windows repeat.
* Anchors with different stretches (where texts part) leave windows to be told apart one by one: their
  hashes are counted by Spark. Of equal stretches one speaks for all.

Windows are told apart by 64-bit hashes. The tasks read suffixes in order and hold a slice of them (cut
between anchors, or within an anchor that fills more than a slice), never all places of a frequent anchor.

Edge cases: null and empty texts keep nothing and remove nothing; texts shorter than ``LENGTH`` stay whole;
rows equal in id and text are separate documents that repeat each other; a null id is an id like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragchew.llm.common import materialize, text_batches
from ragchew.llm.hashing import RangeHash, U, column_bytes, mix

LENGTH = 200
GRAM = 100
BATCHES = 8
SLICE = 1 << 18
LIMIT = 1 << 20
HOT = 256
SALTS = 32
KEY = ["k", "k0", "t"]


def _anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Stretches of a batch: text, first window, number of windows, anchor place; starts are places in the batch."""
    h = RangeHash(raw)
    n = len(raw) - gram + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return h, none, none, none, none
    at = np.arange(n)
    # order by 32 bits of the hash, then the later place, which fills the low bits
    low = U((1 << 32) - 1)
    score = (mix(h.of(at, at + gram)) & ~low) | (low - at.astype(U))
    width = length - gram + 1  # runs in a window
    best, span = score, 1
    while span * 2 <= width:
        best = np.minimum(best[:len(best) - span], best[span:]) if len(best) > span else best[:0]
        span *= 2
    if span < width and len(best):
        best = np.minimum(best[:max(len(best) - (width - span), 0)], best[width - span:])
    windows = len(best)
    size = np.diff(offsets)
    per = np.maximum(size - length + 1, 0)
    if not windows or not per.sum():
        none = np.zeros(0, np.int64)
        return h, none, none, none, none
    text = np.repeat(np.arange(len(size)), per)
    start = np.repeat(offsets[:-1], per) + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    place = (low - (best[start] & low)).astype(np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(text)))
    return h, text[first], start[first], count, place[first]


def _frequent(length: int, gram: int):
    """(anchor, suffixes) of the frequent anchors of each batch, and with a null anchor all its suffixes."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches, "text", LIMIT):
            raw, offsets = column_bytes(batch.column(0))
            h, _, _, _, place = _anchors(raw, offsets, length, gram)
            if not len(place):
                continue
            value, n = np.unique(mix(h.of(place, place + gram), 1).view(np.int64), return_counts=True)
            often = n * 2 * HOT >= len(place)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*value[often].tolist(), None], pa.int64()), pa.array([*n[often].tolist(), len(place)], pa.int64())],
                ["anchor", "n"])
    return run


def hot_anchors(texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """The anchors of ``texts`` (a column text) that are dealt to several tasks, ``2 * HOT`` at most, in order."""
    counts = texts.select("text").mapInArrow(_frequent(length, gram), "anchor long, n long")
    counts = materialize(counts.groupBy("anchor").agg(F.sum("n").alias("n")), "repeat-frequent")
    total = counts.where("anchor is null").first()
    often = counts.where(F.col("n") * 2 * HOT >= total["n"]).where("anchor is not null").collect() if total else []
    return np.array(sorted(r["anchor"] for r in often), np.int64)


def _suffixes(length: int, gram: int, batches_n: int, hot: np.ndarray):
    """(anchor, salt, stretch, batch, key of the text, first window, windows) of all stretches; salt is 0 but for hot anchors."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches, "text", LIMIT):
            raw, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
            h, text, start, count, place = _anchors(raw, offsets, length, gram)
            if not len(text):
                continue
            key = {c: np.asarray(batch.column(batch.schema.get_field_index(c))) for c in KEY}
            stretch = mix(h.of(start, start + count - 1 + length), 2) ^ mix((place - start).astype(U), 3)
            ident = key["k"].astype(np.int64).view(U)
            number = (mix(ident, 5) % U(batches_n)).astype(np.int32)
            anchor = mix(h.of(place, place + gram), 1).view(np.int64)
            first = (start - offsets[text]).astype(np.int32)
            salt = np.zeros(len(anchor), np.int32)
            many = np.isin(anchor, hot)
            salt[many] = 1 + (mix(mix(ident[text[many]], 6) ^ first[many].astype(U), 7) % U(SALTS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(salt), pa.array(stretch.view(np.int64)),
                 pa.array(number[text]), *[pa.array(key[c][text]) for c in KEY],
                 pa.array(first), pa.array(count.astype(np.int32))],
                ["anchor", "salt", "stretch", "batch", *KEY, "first", "windows"])
    return run


class Family:
    """Suffix arrays of one slice: levels of sorted row numbers, merged geometrically."""

    def __init__(self, anchor: np.ndarray, stretch: np.ndarray):
        self.anchor, self.stretch = anchor, stretch
        self.levels: dict[int, np.ndarray] = {}
        self.shared = np.zeros(len(anchor), bool)  # the anchor stands elsewhere too
        self.same = np.zeros(len(anchor), bool)    # the whole stretch does
        self.parts = np.zeros(len(anchor), bool)   # the anchor has other stretches

    def _sorted(self, rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort((self.stretch[rows], self.anchor[rows]))]

    def insert(self, rows: np.ndarray) -> None:
        """A new batch: its suffix array is scanned by itself and against every level, then merged in."""
        array = self._sorted(rows)
        self._scan(array)
        for level in self.levels.values():
            self._meet(array, level)
        size = 0
        while size in self.levels:
            array = self._sorted(np.concatenate([self.levels.pop(size), array]))
            size += 1
        self.levels[size] = array

    def _scan(self, array: np.ndarray) -> None:
        a, s = self.anchor[array], self.stretch[array]
        near = a[1:] == a[:-1]
        equal = near & (s[1:] == s[:-1])
        for where, flag in ((near, self.shared), (equal, self.same)):
            flag[array[1:][where]] = True
            flag[array[:-1][where]] = True
        if len(a):
            begin = np.flatnonzero(np.concatenate([[True], ~near]))
            mixed = np.minimum.reduceat(s, begin) != np.maximum.reduceat(s, begin)
            self.parts[array[np.repeat(mixed, np.diff(np.append(begin, len(a))))]] = True

    def _meet(self, array: np.ndarray, level: np.ndarray) -> None:
        """One merge of two sorted arrays: marks what has a partner in the other."""
        both = self._sorted(np.concatenate([level, array]))
        a = self.anchor[both]
        begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        new = np.zeros(len(self.anchor), bool)
        new[array] = True
        n = np.diff(np.append(begin, len(a)))
        fresh = np.add.reduceat(new[both].astype(np.int64), begin) if len(a) else n
        met = np.repeat((fresh > 0) & (fresh < n), n)
        self._scan(both[met])


def _merge_scan(batches: Iterator[pa.RecordBatch]):
    """Rows in order of (anchor, stretch): those whose anchor stands elsewhere, with what that means:
    kind 2: all windows repeat; 1: all repeat, and the row's windows are to be counted for others; 0: to be counted."""
    def judge(t: pa.Table, split: bool, held_same: bool):
        anchor, stretch = (np.asarray(t.column(c)).view(U) for c in ("anchor", "stretch"))
        number = np.asarray(t.column("batch"))
        family = Family(anchor, stretch)
        for b in np.unique(number):
            family.insert(np.flatnonzero(number == b))
        hot = np.asarray(t.column("salt")) > 0  # other tasks have places of it too
        family.shared |= hot
        family.parts |= hot
        if split:  # an anchor that goes on in the next slice, or came from the last
            ends = (anchor == anchor[0]) | (anchor == anchor[-1])
            family.shared |= ends
            family.parts |= ends
        if held_same:
            family.same[0] = True
        return family

    def emit(t: pa.Table, family: Family, lead: np.ndarray):
        kind = np.where(family.same, np.where(family.parts & lead, 1, 2), 0).astype(np.int32)
        keep = family.shared & (family.same | family.parts)
        if keep.any():
            mask = pa.array(keep)
            t = t.append_column("kind", pa.array(kind)).filter(mask).select([*KEY, "first", "windows", "kind"])
            yield from t.combine_chunks().to_batches()

    def slices():
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= SLICE:
                anchor = np.asarray(held.column("anchor"))
                cut = int(np.searchsorted(anchor, anchor[-1]))
                split = cut == 0  # one anchor fills the slice: hold back its last row for the next
                cut = held.num_rows - 1 if split else cut
                yield held.slice(0, cut), split
                held = held.slice(cut)
                if held.num_rows < SLICE:
                    break
        if held is not None and held.num_rows:
            yield held, False

    last, came_split = None, False
    for t, split in slices():
        anchor, stretch = (np.asarray(t.column(c)) for c in ("anchor", "stretch"))
        now = (anchor[0], stretch[0])
        family = judge(t, split or came_split, last == now)
        lead = np.ones(len(anchor), bool)
        lead[1:] = (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
        yield from emit(t, family, lead)
        came_split, last = split, (anchor[-1], stretch[-1]) if split else None


def _windows(length: int):
    """(hash, key, place, weight) of the windows to be counted; a stretch that stands for several weighs two."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches, "text", LIMIT // 2):
            raw, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
            h = RangeHash(raw)
            marks = batch.column(batch.schema.get_field_index("marks"))
            per = np.diff(np.asarray(marks.offsets))
            flat = marks.flatten()
            text = np.repeat(np.arange(batch.num_rows), per)
            first, windows, kind = (np.asarray(flat.field(c)).astype(np.int64) for c in ("first", "windows", "kind"))
            step = 1 << 13  # stretches at a time
            for a in range(0, len(text), step):
                n = windows[a:a + step]
                row = np.repeat(text[a:a + step], n)
                place = np.repeat(first[a:a + step] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                start = offsets[row] + place
                out = [pa.array(mix(h.of(start, start + length), 4).view(np.int64))]
                for c in KEY:
                    out.append(pa.array(np.asarray(batch.column(batch.schema.get_field_index(c)))[row]))
                out += [pa.array(place.astype(np.int32)), pa.array(np.repeat(np.where(kind[a:a + step] == 1, 2, 1), n).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["w", *KEY, "place", "weight"])
    return run


def _repeats(batches: Iterator[pa.RecordBatch]):
    """Of rows in order of their hash: the places whose window stands elsewhere too."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        w, weight = np.asarray(t.column("w")), np.asarray(t.column("weight"))
        near = w[1:] == w[:-1]
        many = weight > 1
        many[1:] |= near
        many[:-1] |= near
        # the last row may have its partner in the next batch; it goes on with what is known of it
        many &= weight != 2  # those of weight 2 are known to repeat as parts of their stretch
        yield from t.slice(0, len(w) - 1).filter(pa.array(many[:-1])).select([*KEY, "place"]).combine_chunks().to_batches()
        held = t.slice(len(w) - 1)
        if many[-1]:
            held = held.set_column(held.schema.get_field_index("weight"), "weight", pa.array([3], pa.int32()))
    if held is not None and held.column("weight")[0].as_py() > 2:
        yield from held.select([*KEY, "place"]).combine_chunks().to_batches()


def _removal(length: int):
    """What is left of each text without the windows of its marks."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches, "text", LIMIT * 4):
            raw, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
            marks = batch.column(batch.schema.get_field_index("marks"))
            out = [[], [], [], []]
            for i in range(batch.num_rows):
                text = raw[offsets[i]:offsets[i + 1]]
                cover = np.zeros(len(text) + 1, np.int64)
                if marks[i].is_valid and len(marks[i]):
                    first = np.asarray(marks[i].values.field("first")).astype(np.int64)
                    n = np.asarray(marks[i].values.field("windows")).astype(np.int64)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + n - 1 + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                left = text[~gone].tobytes()
                out[0].append(len(text))
                out[1].append(int(gone.sum()))
                out[2].append(int((gone[1:] & ~gone[:-1]).sum() + bool(len(gone) and gone[0])))
                out[3].append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]],
                 pa.array([hashlib.sha256(x).hexdigest() for x in out[3]]), pa.array(out[3], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``KEY``, doc_id and text (bytes, null as empty) of every row."""
    ident = F.col(id_col).cast("long")
    return docs.select(
        F.coalesce(ident, F.lit(0)).alias("k"), ident.isNull().cast("int").alias("k0"), F.hash(text_col).alias("t"),
        ident.alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))


def repeated(suffixes: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows (``KEY``, first, windows) that the stretches ``suffixes`` of ``texts`` have among them."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(
        suffixes.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "stretch").mapInArrow(
            _merge_scan, "k long, k0 int, t int, first int, windows int, kind int"), "repeat-found")
    marks = F.collect_list(F.struct("first", "windows", "kind")).alias("marks")
    open_marks = found.where("kind < 2").groupBy(*KEY).agg(marks)
    windows = texts.join(open_marks.hint("merge"), KEY).select(*KEY, "doc_id", "text", "marks").mapInArrow(
        _windows(length), "w long, k long, k0 int, t int, place int, weight int")
    single = windows.repartition(parts, "w").sortWithinPartitions("w").mapInArrow(
        _repeats, "k long, k0 int, t int, place int")
    whole = found.where("kind > 0").select(*KEY, "first", "windows")
    return whole.unionByName(single.select(*KEY, F.col("place").alias("first"), F.lit(1).alias("windows")))


def without(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """``texts`` less the windows of ``runs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    every = runs.groupBy(*KEY).agg(F.collect_list(F.struct("first", "windows")).alias("marks"))
    return texts.join(every.hint("merge"), KEY, "left").select("doc_id", "text", "marks").mapInArrow(
        _removal(length),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Every row without its repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    # both joins of the texts read the same exchange, so these are shuffled once
    texts = keyed(docs, id_col, text_col)
    suffixes = texts.select(*KEY, "text").mapInArrow(
        _suffixes(length, gram, batches, hot_anchors(texts, length, gram)),
        "anchor long, salt int, stretch long, batch int, k long, k0 int, t int, first int, windows int")
    return without(texts, repeated(suffixes, texts, length), length)
