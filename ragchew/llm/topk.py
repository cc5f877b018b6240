"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block. The k-th best score of a
query is located without sorting scores: each block counts its scores by
histogram bin, counts are summed over the blocks, and the bin that holds the k-th score
is split again in the next pass until it is one score wide. A last
pass keeps what is above that score and, of the rows equal to it, those with
the smallest ids.

A block needs to report only bins down to its own k-th score: the global one
is not below it. So it sends at most k counts and k rows per query, ties of
any number included.

Queries are a fixed share of the rows, so they are cut into blocks too. Blocks of rows are dealt to cells, and each block of
queries meets each cell in one task, by an equi-join on the numbers of cell and query block: a block of rows is sent once per
block of queries, a block of queries once per cell, and there are about as many cells as blocks of queries (more where these are
few, to keep all tasks busy). Nothing is broadcast.

Edge cases: vectors that are null, or hold null or non-finite components, take
no part; vectors of other lengths than the query's are no candidates for it; an empty vector
scores 0; rows with the query's id are its own and never candidates; a query id that occurs in
several rows is searched once for each different vector; rows that repeat
are candidates each. Scores are exact while components and scores stay below 2**62 in size; what is beyond
counts as 2**62 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragchew.llm.common import materialize

BLOCK = 4096
QUERY_BLOCK = 8192
SLICE = 512
BITS = 16
CELLS = 4  # cells of row blocks for each shuffle partition, at least
# Components and scores beyond this count as this; twice it is still a 64-bit number.
MOST = (1 << 62) - 1


def integer_vector(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as doubles are floored."""
    def whole(x: Column) -> Column:
        return F.least(F.greatest(x.cast("double") * F.lit(float(scale)), F.lit(-float(1 << 62))), F.lit(float(1 << 62)))
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(whole(x)), F.lit(MOST)), F.lit(-MOST)))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (
        F.abs(x.cast("double")) == F.lit(float("inf"))))


def _blocks(rows: DataFrame, size: int, total: int) -> DataFrame:
    """Rows packed into blocks (dim, block, ids, flat) of about ``size``; rows that share
    an id are spread by their number within a partition."""
    n = max(1, -(-total // size))
    block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id() % 64), F.lit(n)).cast("int")
    packed = rows.withColumn("block", block).groupBy("dim", "block").agg(
        F.collect_list(F.struct("id", "v")).alias("rows"))
    return packed.select("dim", "block", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))


def _pairs(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(batch.schema.get_field_index(c))[i]
            dim = get("dim").as_py()
            ids = get("ids").values.to_numpy(zero_copy_only=False)
            qids = get("qids").values.to_numpy(zero_copy_only=False)
            qkeys = get("qkeys").values.to_numpy(zero_copy_only=False)
            rows = get("flat").values.to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            asked = get("qflat").values.to_numpy(zero_copy_only=False).reshape(len(qids), dim)
            parts = {c: get(c).values.to_numpy(zero_copy_only=False) for c in ("lows", "widths")}
            most = int(np.abs(rows).max(initial=0)) * int(np.abs(asked).max(initial=0)) * max(dim, 1)
            kind = np.float64 if most < 2 ** 53 else np.int64 if most < 2 ** 63 else object  # exact in each
            right = rows.astype(kind).T
            for a in range(0, len(qids), SLICE):  # so many scores a time
                z = a + SLICE
                scores = asked[a:z].astype(kind) @ right
                if kind is object:
                    scores = np.clip(scores, -MOST, MOST)
                yield ({c: v[a:z] for c, v in parts.items()}, ids, qkeys[a:z],
                       scores.astype(np.int64).reshape(len(qkeys[a:z]), len(ids)), qids[a:z, None] == ids[None, :])


def _count(k: int, bits: int):
    """Counts by bin of the scores in each query's present range, from the top down to the
    bin of the block's own k-th score."""
    schema = ["qkey", "bin", "n", "low", "width"]

    def run(batches):
        for state, ids, qkeys, scores, own in _pairs(batches):
            out = [[], [], [], [], []]
            for q in range(len(qkeys)):
                s = scores[q][~own[q]]
                if not len(s):
                    continue
                low, width = int(state["lows"][q]), int(state["widths"][q])
                s = s[(s >= low) & ((s - low) // width < (1 << bits))]
                if len(s) > k:
                    s = s[s >= (np.partition(s, len(s) - k)[len(s) - k] - low) // width * width + low]
                bins, n = np.unique((s - low) // width, return_counts=True)
                out[0] += [qkeys[q]] * len(bins)
                out[1] += bins.tolist()
                out[2] += n.tolist()
                out[3] += [low] * len(bins)
                out[4] += [width] * len(bins)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema)
    return run


def _select(k: int):
    """Rows above the k-th score; of those equal to it the k smallest ids."""
    def run(batches):
        for state, ids, qkeys, scores, own in _pairs(batches):
            out = [[], [], []]
            for q in range(len(qkeys)):
                s, at = scores[q][~own[q]], ids[~own[q]]
                low = int(state["lows"][q])
                tie = np.sort(at[s == low], kind="stable")[:k]
                up = s > low
                out[0] += [qkeys[q]] * int(up.sum() + len(tie))
                out[1] += at[up].tolist() + tie.tolist()
                out[2] += s[up].tolist() + [low] * len(tie)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["qkey", "id", "score"])
    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS,
          block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` rows of largest inner product for each query, ties to smaller ids.

    Both inputs have ``id`` and ``v`` (array of long). Returns query_id, rank, id and score.
    """
    def sized(df: DataFrame) -> DataFrame:
        return df.where("v is not null and not exists(v, x -> x is null)").select(
            F.col("id").cast("long").alias("id"), "v", F.size("v").alias("dim"))

    rows = materialize(sized(rows), "topk-rows")
    asked = materialize(sized(queries).distinct().withColumn("qkey", F.xxhash64("id", "v")), "topk-queries")
    n_rows, n_asked = rows.count(), asked.count()
    q_blocks = max(1, -(-n_asked // query_block))
    r_blocks = materialize(_blocks(rows, block, n_rows), "topk-blocks")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = min(max(1, -(-n_rows // block)), max(q_blocks, CELLS * parts))
    # the range of all possible scores, from the largest component on either side
    top = [df.agg(F.max(F.expr("aggregate(v, 0L, (a, x) -> greatest(a, abs(x)))")), F.max("dim")).first()
           for df in (rows, asked)]
    bound = min(max(1, (top[0][0] or 0) * (top[1][0] or 0) * max(top[0][1] or 1, 1)), MOST)
    width = 1
    while width << bits <= 2 * bound:
        width <<= bits
    state = asked.select("qkey", F.lit(-bound).cast("long").alias("low"), F.lit(width).cast("long").alias("width"),
                         F.lit(k).cast("long").alias("want"))

    def meet(state: DataFrame) -> DataFrame:
        q = asked.join(state, "qkey").withColumn("qblock", F.pmod("qkey", F.lit(q_blocks)).cast("int"))
        q = q.groupBy("dim", "qblock").agg(F.collect_list(F.struct("id", "qkey", "v", "low", "width")).alias("q")).select(
            "dim", "qblock", F.col("q.id").alias("qids"), F.col("q.qkey").alias("qkeys"),
            F.flatten("q.v").alias("qflat"), F.col("q.low").alias("lows"), F.col("q.width").alias("widths"))
        q = q.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        r = r_blocks.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        # one exchange brings both sides to their pair's task
        return r.withColumn("cell", F.pmod("block", F.lit(cells))).join(q.hint("merge"), ["dim", "cell", "qblock"])

    step = 0
    while True:
        bins = meet(state).mapInArrow(_count(k, bits), "qkey long, bin long, n long, low long, width long")
        bins = bins.groupBy("qkey", "low", "width", "bin").agg(F.sum("n").alias("n"))
        from_top = W.partitionBy("qkey").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
        found = bins.join(state.select("qkey", "want"), "qkey").withColumn("upto", F.sum("n").over(from_top))
        # the bin with the k-th score; the lowest one where there are fewer than k
        found = found.groupBy("qkey", "low", "width", "want").agg(
            F.max(F.when(F.col("upto") >= F.col("want"), F.struct("bin", "upto", "n"))).alias("hit"),
            F.min(F.struct("bin", "upto", "n")).alias("least"))
        hit = F.coalesce("hit", "least")
        state = found.select(
            "qkey", (F.col("low") + hit["bin"] * F.col("width")).alias("low"),
            F.greatest(F.floor(F.col("width") / F.lit(1 << bits)), F.lit(1)).cast("long").alias("width"),
            F.greatest(F.col("want") - (hit["upto"] - hit["n"]), F.lit(1).cast("long")).alias("want"))
        state = materialize(state, f"topk-state{step}")
        step += 1
        if width == 1:
            break
        width = max(1, width >> bits)
    best = meet(state).mapInArrow(_select(k), "qkey long, id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(
        W.partitionBy("qkey").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.join(asked.select("qkey", F.col("id").alias("query_id")), "qkey").select(
        "query_id", "rank", "id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 10, every: int = 100, **options) -> DataFrame:
    """Query the rows whose vec_id is divisible by ``every`` against all others."""
    rows = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").alias("id"), integer_vector(F.col("embedding")).alias("v"))
    found = top_k(rows, rows.where(F.col("id") % every == 0), k, **options)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
