"""Near duplicates by a signature-coordinate inverted join.

A document's set holds its distinct five-word shingles, its signature the least
value of the set under each of ``COORDINATES`` hash functions. Documents with the
same set form a class, and one row stands for it. Classes are posted under each (coordinate, value)
pair of their signature. Two sets of similarity ``s`` agree in a coordinate with probability ``s``, so links
are looked for among pairs that agree in ``agree`` coordinates or more, the most that a pair at the threshold
reaches with a chance of all but ``MISS`` (29 of 48 at 0.85, 25 at 0.8):

* *skip*: values that occur once are dropped, and with them classes that keep fewer than ``agree``;
* *prefix*: of the values that a class keeps, the ``agree - 1`` most frequent are not
  searched, as a pair that agrees in ``agree`` agrees in one of the others too;
* shingles that only one of the searched sets has can't be shared: a pair of sizes ``n`` and ``m`` has
  similarity ``c / (n + m - c)`` at most, where ``c`` is the lesser number of other shingles; at the
  end ``c`` is bounded by ``GROUPS`` groups of shingles (by hash), each by its lesser number. Sets and pairs below the threshold by that bound are not searched, which is what thins
  out large groups of texts that were edited independently;
* collisions of a candidate pair are counted over both whole signatures;
* links are confirmed on the whole sets.

A posting list is not multiplied out. In each of ``STARS`` rounds its members meet one
central member (the one whose values are the most frequent ones), and whatever gets
linked to the same component need not meet any more. At the end all members of a list that are still
in different components do meet, so no link between components is lost.

Components come from links by passing the least label on, with shortcuts, in rounds over tables.

Edge cases: null or empty texts, and those without words, have an empty set and are linked with nothing;
rows that share a doc_id are one node of the graph when their texts agree and separate nodes with the same
label when they don't; rows without doc_id take part, but never name a component unless
all its rows are without, when its id is null. Very long texts are whole sets too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragchew.llm.common import free_name, materialize, text_batches
from ragchew.llm.hashing import U, mix, shingle_hashes, word_hashes

COORDINATES = 48
MISS = 1e-5
STARS = 2
SHINGLE = 5
GROUPS = 32
LIMIT = 2 << 20


def _distinct(batch: pa.RecordBatch, text: str, n: int):
    """Distinct shingle hashes of each text, ordered within texts, and n + 1 offsets."""
    words, firsts = word_hashes(batch.column(batch.schema.get_field_index(text)))
    shingles, starts = shingle_hashes(words, firsts, n)
    per = np.diff(starts)
    of = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((shingles, of))
    shingles = shingles[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1])
    return shingles[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(per)))])


def _sketch(text: str, ident: str, n: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches, text, LIMIT):
            sets, at = _distinct(batch, text, n)
            size = np.diff(at)
            some = np.flatnonzero(size)
            sums = [np.zeros(len(size), U) for _ in range(2)]
            signature = np.zeros((len(some), coordinates), np.int32)
            if len(some):
                with np.errstate(over="ignore"):
                    for k in range(2):
                        sums[k][some] = np.add.reduceat(mix(sets, 101 + k), at[some])
                    for k in range(coordinates):
                        odd = U(int(mix(np.array([k], U), 7)[0]) | 1)
                        low = np.minimum.reduceat((sets ^ (sets >> U(29))) * odd, at[some])
                        signature[:, k] = (mix(low, k) >> U(32)).astype(np.uint32).view(np.int32)
            rows = np.zeros(len(size), np.int64)
            rows[some] = coordinates
            offsets = pa.array(np.concatenate([[0], np.cumsum(rows)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(ident)), pa.array(size),
                 pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(signature.reshape(-1)))],
                ["doc_id", "n_shingles", "cid", "cid2", "signature"])
    return run


def _whole_sets(text: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in text_batches(batches, text, LIMIT):
            sets, at = _distinct(batch, text, n)
            size = np.diff(at)
            some = np.flatnonzero(size)
            sums = np.zeros(len(size), U)
            if len(some):
                with np.errstate(over="ignore"):
                    sums[some] = np.add.reduceat(mix(sets, 101), at[some])
            of = np.repeat(np.arange(len(size)), size)
            groups = np.bincount(of * GROUPS + (sets % U(GROUPS)).astype(np.int64), minlength=len(size) * GROUPS)
            ends = np.arange(len(size) + 1, dtype=np.int32) * GROUPS
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(groups.astype(np.int32)))],
                ["cid", "shingles", "groups"])
    return run


def agree_for(similarity: tuple[int, int], coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most coordinates that a pair at the threshold agrees in with a chance of ``1 - miss`` or more (1 at least)."""
    p, fewer = similarity[0] / similarity[1], 0.0
    for agree in range(1, coordinates + 1):
        fewer += comb(coordinates, agree - 1) * p ** (agree - 1) * (1 - p) ** (coordinates - agree + 1)
        if fewer > miss:
            return max(1, agree - 1)
    return coordinates


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, the class (two sums over the set) and the signature of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _sketch("text", "doc_id", shingle, coordinates),
        "doc_id long, n_shingles long, cid long, cid2 long, signature array<int>")


def posting_lists(classes: DataFrame, agree: int) -> DataFrame:
    """(value, cid, centre): the searched part of each class's postings; ``centre`` grows with how
    frequent all its values are."""
    posts = classes.select("cid", F.posexplode("signature").alias("k", "v")).select(
        "cid", F.xxhash64("k", "v").alias("value"))
    often = posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    kept = posts.join(often, "value").groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    kept = kept.where(F.size("values") >= agree)
    centre = F.aggregate("values", F.lit(0.0), lambda a, x: a + F.log2(x["df"].cast("double")))
    return kept.withColumn("centre", F.round(centre, 6)).select(
        "cid", "centre", F.explode(F.slice("values", F.lit(1), F.size("values") - (agree - 1))).alias("x")).select(
        F.col("x.value").alias("value"), "cid", "centre")


def bounds(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Each listed set's size ``n``, the number ``own`` of shingles that no other listed set has, and its
    other shingles by group; without sets that cannot reach the threshold with any other."""
    tokens = sets.select("cid", F.explode("shingles").alias("s"))
    single = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("cid")).where("n = 1")
    own = single.groupBy("cid", F.pmod("s", F.lit(GROUPS)).cast("int").alias("g")).agg(
        F.count(F.lit(1)).cast("int").alias("n")).groupBy("cid").agg(
        F.sum("n").alias("own"), F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("by"))
    n, mine = F.size("shingles").cast("long"), F.coalesce("own", F.lit(0)).cast("long")
    rest = F.transform("groups", lambda x, g: x - F.coalesce(F.element_at("by", g), F.lit(0)))
    return sets.select("cid", "shingles", "groups").join(own, "cid", "left").select(
        "cid", n.alias("n"), mine.alias("own"), rest.alias("groups")).where(
        F.lit(den) * (F.col("n") - F.col("own")) >= F.lit(num) * F.col("n"))


def possible(a: str, b: str, num: int, den: int) -> Column:
    """Whether the bound lets the sets of two postings (structs with n and own) be similar."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.own"), m - F.col(f"{b}.own"))
    return (F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)) & (
        F.lit(den) * rest >= F.lit(num) * (n + m - rest))


def similar(a: Column, b: Column, num: int, den: int) -> Column:
    """Whether den * |intersection| >= num * |union| of two arrays of distinct values."""
    both = F.size(F.array_intersect(a, b)).cast("long")
    return F.lit(den) * both >= F.lit(num) * (F.size(a) + F.size(b) - both)


def confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, agree: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that agree in ``agree`` coordinates and are similar as whole sets."""
    sig = classes.select("cid", "signature")
    left = sig.select(F.col("cid").alias("a"), F.col("signature").alias("sa"))
    right = sig.select(F.col("cid").alias("b"), F.col("signature").alias("sb"))
    met = F.size(F.filter(F.arrays_zip("sa", "sb"), lambda x: x["sa"] == x["sb"]))
    likely = materialize(pairs.join(left, "a").join(right, "b").where(met >= agree).select("a", "b"), "near-likely")
    return likely.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("xa")), "a").join(
        sets.select(F.col("cid").alias("b"), F.col("shingles").alias("xb")), "b").where(
        similar(F.col("xa"), F.col("xb"), num, den)).select("a", "b")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(cid, root): the least cid that each node of ``links`` (a, b) is connected with.

    Each round, nodes take the least label among themselves and their neighbours, then the
    label of that label; partial minima keep hubs from meeting in one task. The rounds end
    when no label changes.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = edges.groupBy(F.col("a").alias("cid")).agg(F.min(F.least("a", "b")).alias("root"))
    labels = materialize(labels, f"{name}-labels")
    while True:
        near = edges.join(labels.select(F.col("cid").alias("b"), F.col("root").alias("other")), "b").groupBy(
            F.col("a").alias("cid")).agg(F.min("other").alias("other"))
        step = labels.join(near, "cid").select("cid", F.col("root").alias("old"), F.least("root", "other").alias("root"))
        jump = labels.select(F.col("cid").alias("root"), F.col("root").alias("far"))
        # a root's own label may be lower by now: take it too
        step = step.join(jump, "root", "left").select(
            "cid", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        step = materialize(step, f"{name}-labels")
        labels = step.select("cid", "root")
        if step.where(F.col("old") != F.col("root")).isEmpty():
            return labels


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _star(lists: DataFrame, labels: DataFrame | None, rank: int, num: int, den: int) -> DataFrame:
    """Pairs of one member of each list with its others: first the most central member, later the most
    central one of a component picked by hash."""
    one = F.struct("centre", "cid", "n", "own").alias("hub")
    if rank == 1:
        top = lists.groupBy("value").agg(F.max(one).alias("hub"), F.count(F.lit(1)).alias("many"))
    else:
        top = lists.join(labels, "cid", "left").groupBy("value", F.coalesce("root", "cid").alias("root")).agg(
            F.max(one).alias("hub")).groupBy("value").agg(
            F.max_by("hub", F.xxhash64("root", F.lit(rank))).alias("hub"), F.count(F.lit(1)).alias("many"))
    member = lists.select("value", F.struct("cid", "n", "own").alias("x"))
    return member.join(top.where("many > 1").select("value", "hub"), "value").where(
        (F.col("hub.cid") != F.col("x.cid")) & possible("hub", "x", num, den)).select(
        *_pair(F.col("hub.cid"), F.col("x.cid"))).distinct()


def _rest(lists: DataFrame, labels: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of members of a list that are in different components and may be similar."""
    member = lists.join(labels, "cid", "left").select(
        "value", F.struct("cid", "n", "own", F.coalesce("root", "cid").alias("root")).alias("x"))
    several = member.groupBy("value").agg(F.min("x.root").alias("lo"), F.max("x.root").alias("hi")).where(
        "lo < hi").select("value")
    member = member.join(several, "value")
    member = materialize(member.join(facts.select(F.col("cid").alias("c"), "groups"), F.col("x.cid") == F.col("c"))
                         .select("value", "x", "groups"), "near-open")
    shared = reduce(add, [F.least(F.get("groups", F.lit(g)), F.get("groups2", F.lit(g))) for g in range(GROUPS)])
    total = F.col("x.n") + F.col("y.n")
    return member.join(member.select("value", F.col("x").alias("y"), F.col("groups").alias("groups2")), "value").where(
        (F.col("x.root") < F.col("y.root")) & possible("x", "y", num, den)
        & (F.lit(den) * shared >= F.lit(num) * (total - shared))).select(
        *_pair(F.col("x.cid"), F.col("y.cid"))).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    left = labels.select(F.col("cid").alias("a"), F.col("root").alias("ra"))
    right = labels.select(F.col("cid").alias("b"), F.col("root").alias("rb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").where(
        F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id",
                    text_col: str = "text", shingle: int = SHINGLE, coordinates: int = COORDINATES,
                    agree: int | None = None, stars: int = STARS) -> DataFrame:
    """Near-duplicate components of ``docs``: doc_id, n_shingles, component_id, kept, a row per input row."""
    num, den = similarity
    agree = agree or agree_for(similarity, coordinates)
    rows = materialize(sketches(docs, id_col, text_col, shingle, coordinates), "near-rows")
    full = rows.where(F.col("n_shingles") > 0)
    classes = materialize(full.groupBy("cid").agg(
        F.min("doc_id").alias("least"), F.first("signature").alias("signature")), "near-classes")
    lists = materialize(posting_lists(classes, agree), "near-lists")
    # whole sets of the classes that are in any list, from one row of each
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("k0")]
    wanted = full.join(lists.select("cid").distinct(), "cid").groupBy("cid").agg(F.min("doc_id").alias("doc_id")).select(
        *key).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(*key, "text")
    sets = texts.join(wanted, ["k", "k0"], "left_semi").select("text").mapInArrow(
        _whole_sets("text", shingle), "cid long, shingles array<long>, groups array<int>")
    sets = materialize(sets.dropDuplicates(["cid"]), "near-sets")

    facts = materialize(bounds(sets, num, den), "near-bounds")
    lists = materialize(lists.join(facts.select("cid", "n", "own"), "cid"), "near-bounded")

    links, labels = None, None
    for rank in range(1, stars + 2):
        pairs = _star(lists, labels, rank, num, den) if rank <= stars else _rest(lists, labels, facts, num, den)
        if labels is not None:
            pairs = _apart(pairs, labels)
        found = materialize(confirm(pairs, classes, sets, agree, num, den), f"near-links{rank}")
        links = found if links is None else links.union(found)
        if rank > 1 and found.isEmpty():
            continue
        labels = components(links, f"near{rank}")
    label = labels.select("cid", "root")
    ids = classes.join(label, "cid", "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    named = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ids.join(named, "root").select("cid", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", "cid").join(named, "cid", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id, the least text where an id repeats. Rows with an
    empty set stay; so do rows without id, of each text once, where no row of their component has an id."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    k, k0, n, t, r = (free_name(docs, f"__near_{x}") for x in ("id", "no_id", "n", "text", "nth"))
    found = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "near-found")
    key = docs.select(*names, F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(k),
                      F.col(id_col).isNull().alias(k0))
    # ids of rows that stay: representatives, and those that only empty sets or nulls speak for
    stays = found.where(F.col("kept") | F.col("component_id").isNull()).select(
        F.coalesce("doc_id", F.lit(0)).alias(k), F.col("doc_id").isNull().alias(k0))
    count = materialize(stays.groupBy(k, k0).agg(F.count(F.lit(1)).alias(n)), "near-stays")
    once = key.join(count.where(F.col(n) == 1).select(k, k0), [k, k0], "left_semi").select(*names)
    more = count.where(F.col(n) > 1)
    if more.isEmpty():
        return once
    # ids that several rows bear: one row of each text; empty texts of an id are one too
    rest = key.join(more.select(k, k0), [k, k0], "left_semi").withColumn(
        t, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    first = rest.withColumn(r, F.row_number().over(W.partitionBy(k, k0, t).orderBy(*names)))
    return once.unionByName(first.where(F.col(r) == 1).select(*names))
