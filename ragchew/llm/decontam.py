"""Benchmark decontamination with a BM25 index of the test items.

Every training text is cut into overlapping passages, and every passage is a query against an inverted
index of the test items. An item's BM25 score is taken relative to the score that its own
whole text would get, so one threshold serves items of any length. All items at or above it
are retrieved, by block-max WAND:

* an item's terms of least weight, which cannot lift it to the threshold by ``SLACK`` alone, are not looked up;
* postings are grouped in blocks of items, each with its largest weight; a term has one list of them;
* a passage's lists stand at their first block. In the order of the blocks they stand at, the largest weights of whole
  lists are summed until the threshold can be reached, at the pivot. Lists before the pivot move on to its block at once, past
  all between; where the first list stands at the pivot's block too, the block's own largest weights decide
  whether its items are scored. A passage whose lists left cannot reach the threshold is done. All passages of a
  batch take their steps together;
* items of the blocks left are scored in full.

A retrieved item counts as leaked if enough of the word trigrams of its question and of
its answer stand in the passage. The answer is the last sentence, the question what comes before; an item
of one sentence has its last quarter as answer.

A passage is two strides long. Items are dealt to classes by their length, in the words that passages are cut in, and the stride of a
class is ``STRIDE`` doubled until no item of the class is longer. So any item that a text holds whole stands whole in one of the
passages it is looked for in, and how wide these are depends on the item alone.

The index is made by Spark jobs and cut into shards of one class and at most ``SHARD_ROWS`` postings. As many shards as
hold that many postings together are broadcast at a time; texts pass them one after another, without a shuffle.

Edge cases: null or empty texts and items have no words, no passage and match nothing; repeated items are
items each, with their ids; an item id of null is reported as null; a text shorter than a passage is one passage;
an empty table of items leaves all texts clean. ``n_passages`` counts the passages of the least stride. The
columns of the texts come back untouched: where one of them has the name of a new column, the new one gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ragchew.llm.common import free_name, materialize, text_batches
from ragchew.llm.hashing import PLAIN, U, shingle_hashes, word_hashes

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SLACK = 0.25
OVERLAP = 0.5
BLOCK = 8
STRIDE = 64
GRAM = 3
SHARD_ROWS = 2_000_000
LIMIT = 2 << 20


def _item_rows(batches: Iterator[pa.RecordBatch]):
    """(row, item, term, tf, length) of every item."""
    for batch in text_batches(batches, "text", LIMIT):
        words, firsts = word_hashes(batch.column(batch.schema.get_field_index("text")), PLAIN, fold=True)
        n = np.diff(firsts)
        of = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((words, of))
        words, of = words[order], of[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(words)))
        key = np.asarray(batch.column(batch.schema.get_field_index("row")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[of[at]]), pa.array(words[at].view(np.int64)), pa.array(tf.astype(np.int64)),
             pa.array(n[of[at]].astype(np.int64))], ["row", "term", "tf", "length"])


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    cut = max(text.rstrip(" .!?\n").rfind(c) for c in ".!?\n") + 1
    if cut <= 0 or not text[:cut].strip():
        words = text.split()
        cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
        return " ".join(words[:cut]), " ".join(words[cut:])
    return text[:cut], text[cut:]


def length_class(length: Column, stride: int = STRIDE) -> Column:
    """How often ``stride`` is doubled for an item of ``length`` words."""
    over = F.floor((F.greatest(length, F.lit(1)) - 1) / stride).cast("long")
    return F.when(over < 1, 0).otherwise(F.length(F.bin(over))).cast("int")


def build_index(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                shard_rows: int = SHARD_ROWS, stride: int = STRIDE) -> list[list[dict]]:
    """The shards of the index, as dicts of arrays, in groups that are broadcast together. Statistics are those of all items."""
    rows = materialize(items.select(F.col(id_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                       .withColumn("row", F.xxhash64("item", "text", F.monotonically_increasing_id())), "leak-items")
    posts = materialize(rows.select("row", "text").mapInArrow(_item_rows, "row long, term long, tf long, length long"),
                        "leak-postings")
    size = posts.agg(F.count(F.lit(1)), F.count_distinct("row")).first()
    if not size[0]:
        return []
    mean = posts.select("row", "length").distinct().agg(F.avg("length")).first()[0]
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(float(size[1])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    posts = materialize(posts.join(df, "term").select("row", "term", weight.alias("weight"),
                                                      length_class(F.col("length"), stride).alias("class")), "leak-weights")
    groups, room = [], 0
    for wide, count in sorted(tuple(r) for r in posts.groupBy("class").count().collect()):
        shards = -(-count // shard_rows)
        mine = posts.where(F.col("class") == wide)
        for s in range(shards):
            part = mine.where(F.pmod(F.col("row"), F.lit(shards)) == s).drop("class")
            if not groups or room + count // shards > shard_rows:
                groups.append([])
                room = 0
            room += count // shards
            groups[-1].append(_shard(part.toArrow(), rows.join(part.select("row").distinct(), "row", "left_semi").toArrow(),
                                     stride << wide))
    return groups


def _shard(posts: pa.Table, items: pa.Table, stride: int) -> dict:
    ids, texts = items.column("item").to_pylist(), items.column("text").to_pylist()
    keys = items.column("row").to_numpy()
    order = np.argsort(keys, kind="stable")
    ids, texts, keys = [ids[i] for i in order], [texts[i] for i in order], keys[order]
    n = len(ids)
    item = np.searchsorted(keys, posts.column("row").to_numpy())
    term = posts.column("term").to_numpy().view(U)
    weight = posts.column("weight").to_numpy()
    weight = weight / np.bincount(item, weight, n)[item]
    # of each item, the terms of least weight that together stay below the threshold by SLACK
    order = np.lexsort((weight, item))
    item, term, weight = item[order], term[order], weight[order]
    run = np.cumsum(weight)
    first = np.searchsorted(item, np.arange(n))
    run -= np.repeat(run[first] - weight[first], np.diff(np.append(first, len(item))))
    light = run <= THRESHOLD - SLACK
    free = np.bincount(item[light], weight[light], n)
    blocks = -(-n // BLOCK)
    block_free = np.zeros(blocks)
    np.maximum.at(block_free, np.arange(n) // BLOCK, free)
    # looked-up postings by (term, block) with the block's largest weight
    heavy = np.flatnonzero(~light)
    order = heavy[np.lexsort((item[heavy] // BLOCK, term[heavy]))]
    t, b, w = term[order], item[order] // BLOCK, weight[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (b[1:] != b[:-1])
    most = np.maximum.reduceat(w, np.flatnonzero(new)) if len(t) else w
    t, b = t[new], b[new]
    terms, start = np.unique(t, return_index=True)
    start = np.append(start, len(t))
    ends = np.searchsorted(item, np.arange(n), side="right")
    parts = []
    for text in texts:
        # each half as its trigrams, or as its words where it has too few for them
        grams = []
        for part in halves(text):
            h, f = word_hashes(pa.array([part]), PLAIN, fold=True)
            grams.append((len(h) >= GRAM, np.unique(shingle_hashes(h, f, GRAM)[0]) if len(h) >= GRAM else np.sort(h)))
        parts.append(grams)
    return {"ids": ids, "terms": terms, "start": start, "block": b, "most": most, "free": block_free, "n": n,
            # the largest weight of a whole list, and list and block as one ascending number
            "top": np.maximum.reduceat(most, start[:-1]) if len(t) else most,
            "place": np.repeat(np.arange(len(terms)), np.diff(start)) * np.int64(blocks) + b,
            "item_terms": [term[a:z] for a, z in zip(first, ends)],
            "item_weights": [weight[a:z] for a, z in zip(first, ends)], "parts": parts, "stride": stride}


def overlaps(words: np.ndarray, parts: list, least: float = OVERLAP) -> bool:
    """Whether enough of an item's question and of its answer stands in a passage."""
    grams = shingle_hashes(words, np.array([0, len(words)]), GRAM)[0]
    return all(not len(part) or np.isin(part, grams if long else words).mean() >= least for long, part in parts)


def pivot_blocks(index: dict, p: np.ndarray, t: np.ndarray, seen: list | None = None) -> np.ndarray:
    """Pairs (passage * blocks + block) whose block may hold an item at the threshold, for the terms ``t`` of passages
    ``p``. ``seen`` gets the numbers of postings that the lists come to stand at."""
    blocks, least = np.int64(len(index["free"])), THRESHOLD - 1e-9
    slack = index["free"].max(initial=0.0)
    at, end = index["start"][t].copy(), index["start"][t + 1]
    seen, out = [] if seen is None else seen, []
    seen.append(len(at))
    while len(p):
        here = index["block"][at]
        order = np.lexsort((here, p))
        p, t, at, end, here = p[order], t[order], at[order], end[order], here[order]
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        size = np.diff(np.append(first, len(p)))
        run = np.cumsum(index["top"][t])
        run -= np.repeat(run[first] - index["top"][t[first]], size)
        reach = run + slack >= least
        # the first list at which the passage can reach the threshold; without one it is done
        pivot = np.minimum.reduceat(np.where(reach, np.arange(len(p)), len(p)), first)
        going = pivot < len(p)
        target = np.where(going, here[np.minimum(pivot, len(p) - 1)], 0)
        level = going & (here[first] == target)
        own = np.repeat(np.arange(len(first)), size)
        on = level[own] & (here == target[own])  # lists at the pivot's block
        bound = np.bincount(own[on], index["most"][at[on]], len(first)) + index["free"][target]
        hit = level & (bound >= least)
        out.append(p[first[hit]] * blocks + target[hit])
        stood = at
        at = np.where(on, at + 1, at)
        behind = np.flatnonzero(going[own] & ~level[own] & (here < target[own]))
        at[behind] = np.searchsorted(index["place"], t[behind] * blocks + target[own[behind]])
        left = going[own] & (at < end)
        seen.append(int((left & (at != stood)).sum()))
        p, t, at, end = p[left], t[left], at[left], end[left]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def retrieve(index: dict, words: np.ndarray, firsts: np.ndarray, stride: int, seen: list | None = None):
    """(text, begin, end, item, score) of all passages and items at or above the threshold."""
    count = np.diff(firsts)
    per = np.maximum(-(-count // stride) - 1, (count > 0).astype(np.int64))  # a passage is two strides long
    first_passage = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(words)) - firsts[text]
    at = np.minimum(np.searchsorted(index["terms"], words), max(len(index["terms"]) - 1, 0))
    hit = np.flatnonzero(index["terms"][at] == words) if len(index["terms"]) else np.zeros(0, np.int64)
    if not len(hit):
        return
    # each word is in the passage that its stride begins and in the one before
    seg = place[hit] // stride
    p = np.concatenate([np.minimum(seg, per[text[hit]] - 1), seg - 1])
    h = np.concatenate([hit, hit])
    ok = p >= 0  # the last passage has what is left over, so the two may be the same
    ok[len(hit):] &= p[len(hit):] < p[:len(hit)]
    p, h = (p + first_passage[text[h]])[ok], h[ok]
    # a term counts once in a passage
    key = np.unique(p * np.int64(len(index["terms"])) + at[h])
    pair = pivot_blocks(index, key // len(index["terms"]), key % len(index["terms"]), seen)
    blocks = len(index["free"])
    for q in np.unique(pair // blocks):
        x = int(np.searchsorted(first_passage, q, side="right") - 1)
        begin = int(firsts[x] + (q - first_passage[x]) * stride)
        last = q == first_passage[x + 1] - 1
        end = int(firsts[x + 1]) if last else min(begin + 2 * stride, int(firsts[x + 1]))
        inside = np.unique(words[begin:end])
        for block in pair[pair // blocks == q] % blocks:
            for i in range(int(block) * BLOCK, min(int(block + 1) * BLOCK, index["n"])):
                s = float(index["item_weights"][i][np.isin(index["item_terms"][i], inside)].sum())
                if s >= THRESHOLD:
                    yield x, begin, end, i, s


NEW = ["leak_items", "n_passages", "n_retrieved"]


def mark_leaks(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text",
               doc_text: str = "text", stride: int = STRIDE) -> DataFrame:
    """``docs`` and behind its columns leak_items (ids of leaked items, in order), n_passages and n_retrieved, named by
    ``free_name``."""
    new = [free_name(docs, c) for c in NEW]
    docs = docs.withColumns(dict(zip(new, (F.array().cast("array<long>"), F.lit(0).cast("long"), F.lit(0).cast("long")))))
    schema = StructType([*[StructField(f.name, f.dataType) for f in docs.schema.fields[:-3]],
                         StructField(new[0], ArrayType(LongType())), StructField(new[1], LongType()),
                         StructField(new[2], LongType())])
    names = schema.names

    def pass_through(box):
        def run(batches):
            for batch in text_batches(batches, doc_text, LIMIT):
                words, firsts = word_hashes(batch.column(batch.schema.get_field_index(doc_text)), PLAIN, fold=True)
                count = np.diff(firsts)
                leaks = [set(x or ()) for x in batch.column(len(names) - 3).to_pylist()]
                retrieved = np.array(batch.column(len(names) - 1))  # a copy
                passages = np.maximum(-(-count // stride) - 1, (count > 0).astype(np.int64))
                for index in box.value:
                    for x, begin, end, i, _ in retrieve(index, words, firsts, index["stride"]):
                        retrieved[x] += 1
                        if overlaps(words[begin:end], index["parts"][i]):
                            leaks[x].add(index["ids"][i])
                ordered = [sorted(x, key=lambda v: (v is None, v)) for x in leaks]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-3], pa.array(ordered, pa.list_(pa.int64())), pa.array(passages), pa.array(retrieved)],
                    names)
        return run

    for group in build_index(items, id_col, text_col, stride=stride):
        box = docs.sparkSession.sparkContext.broadcast(group)
        docs = docs.mapInArrow(pass_through(box), schema)
    return docs


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Every document with the test items that it leaks: doc_id, n_passages, n_retrieved, leak_items, contaminated."""
    marked = mark_leaks(docs.select("doc_id", "text"), items, **options)
    return marked.select("doc_id", "n_passages", "n_retrieved", "leak_items",
                         (F.size("leak_items") > 0).alias("contaminated"))
