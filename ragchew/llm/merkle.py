"""Merkle manifest of a dataset (bitmap-rank indexing, keyed slot arrays).

Leaves are digests of rows. A leaf's place in its group (source) is the number of smaller ids there, which a
bitmap of the group's ids answers: ids are merged by OR into 64-bit words (map-side combine), words
into buckets of 65536 ids that keep only non-empty words, with a summary bitmap and running popcounts; buckets get
their offset from two levels of totals. The rank of an id is then one lookup of its bucket, a popcount of the summary and one of its
word. Leaves are not sorted.

The tree has 16 children a node. Three levels are reduced at a time: nodes are keyed by (group, place / 4096) and put in an
array by their slot, so a task holds 4096 digests at most, whatever the size of a group. The roots
of these blocks are the next nodes; the groups' roots are the last tree's leaves. On the way down every block gets its own path to the
root once, and its leaves' proofs are made in the block.

Results for odd input. A null source is a group of its own, the first one; it differs from the source ''. A null id comes before all
others of its group and is never altered by the tampering. Rows of one group and id are ordered by their leaf; equal
rows get neighbouring places in any order, so each is a leaf with a proof of its own. Null fields are '-' and differ
from empty ones. An empty table has no rows. Extra columns are not part of a leaf and are not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragchew.llm.common import expand_copies, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, LEVELS = 16, 3
BLOCK = FANOUT ** LEVELS
HEX = 64
ID_BITS, WORD_BITS, SUPER_BITS = 16, 6, 12
NULL_BUCKET = -(1 << 47) - 1  # below the bucket of every 64-bit id
TAMPER_EVERY = 5


def field_text(value: Column) -> Column:
    """A value as it enters a leaf: '-' for null, else byte count, ':' and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def group_key(source: Column) -> Column:
    """The group as bytes without null; their order is null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")).cast("binary"), F.lit(b""))


def leaves_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id, grp, leaf, altered``: the digest of each row, and of the tampered row."""
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % TAMPER_EVERY == 0, F.lit(False))
    changed = [F.when(hit, lowered).otherwise(F.col(text_col)) if f == text_col else F.col(f) for f in FIELDS]
    leaf = leaf_digest([F.col(f) for f in FIELDS])
    return docs.select(
        F.col(id_col).cast("long").alias("id"), group_key(F.col(source_col)).alias("grp"), leaf.alias("leaf"),
        F.when(hit, leaf_digest(changed)).otherwise(leaf).alias("altered"))


def id_parts(df: DataFrame) -> DataFrame:
    """An id as ``bucket`` (ascending with the id), ``word`` and ``at`` (bit of the word)."""
    low = F.coalesce(F.col("id").bitwiseAND((1 << ID_BITS) - 1), F.lit(0))
    return df.withColumns({
        "bucket": F.coalesce(F.shiftright("id", ID_BITS), F.lit(NULL_BUCKET)),
        "word": F.shiftright(low, WORD_BITS).cast("int"),
        "at": low.bitwiseAND((1 << WORD_BITS) - 1).cast("int"),
    })


def low_bits(n: Column) -> Column:
    """A word whose first ``n`` bits (0 to 63) are set."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n))


def one_bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def rank_index(leaves: DataFrame) -> DataFrame:
    """One row per (grp, bucket): ``offset`` (rows of smaller buckets), ``summary`` (16 words that mark the
    non-empty words), ``skip`` (popcounts before each summary word) and ``words`` (bits, rows before the word in
    the bucket, and for repeated ids the surplus rows by bit)."""
    ids = id_parts(leaves.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("n")))
    words = ids.groupBy("grp", "bucket", "word").agg(
        F.bit_or(one_bit(F.col("at"))).alias("bits"), F.sum("n").alias("n"),
        F.collect_list(F.when(F.col("n") > 1, F.struct("at", (F.col("n") - 1).alias("more")))).alias("more"))
    parts = words.groupBy("grp", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits", "n", "more"))).alias("w"), F.sum("n").alias("n"))
    def mark(i: int) -> Column:
        """Word ``i`` of the summary: which of 64 words are non-empty."""
        return F.aggregate(F.filter("w", lambda x: F.shiftright(x["word"], WORD_BITS) == i), F.lit(0).cast("long"),
                           lambda a, x: a.bitwiseOR(one_bit(x["word"].bitwiseAND(63))))

    parts = parts.select(
        "grp", "bucket", "n", F.array(*[mark(i) for i in range(1 << (ID_BITS - 2 * WORD_BITS))]).alias("summary"),
        F.aggregate(  # rows before each word
            "w", F.struct(F.lit(0).cast("long").alias("sum"), F.expr(
                "cast(array() as array<struct<bits:bigint,before:bigint,more:array<struct<at:int,more:bigint>>>>)").alias("out")),
            lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.concat(a["out"], F.array(F.struct(
                x["bits"].alias("bits"), a["sum"].alias("before"), x["more"].alias("more")))).alias("out")),
            lambda a: a["out"]).alias("words"))
    parts = parts.withColumn("skip", F.transform(F.sequence(F.lit(0), F.size("summary") - 1), lambda i: F.aggregate(
        F.slice("summary", 1, i), F.lit(0), lambda a, x: a + F.bit_count(x))))
    parts = materialize(parts.withColumn("super", F.shiftright("bucket", SUPER_BITS)), "merkle-buckets")
    supers = parts.groupBy("grp", "super").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("grp").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("grp", "super", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                           F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    inside = Window.partitionBy("grp", "super").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.select("grp", "super", "bucket", "n").join(supers, ["grp", "super"])
               .select("grp", "bucket", "total", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("offset")))
    return parts.drop("n", "super").join(offsets, ["grp", "bucket"])


def add_places(leaves: DataFrame) -> DataFrame:
    """Leaves with ``pos``, their place in the group (from 0), and ``total``, the group's leaves."""
    found = id_parts(leaves).join(rank_index(leaves), ["grp", "bucket"])
    s = F.shiftright("word", WORD_BITS)
    number = F.col("skip")[s] + F.bit_count(F.col("summary")[s].bitwiseAND(low_bits(F.col("word").bitwiseAND(63))))
    found = found.withColumn("hit", F.col("words")[number])
    more = F.col("hit.more")
    place = (F.col("offset") + F.col("hit.before") + F.bit_count(F.col("hit.bits").bitwiseAND(low_bits(F.col("at"))))
             + F.aggregate(more, F.lit(0).cast("long"), lambda a, x: a + F.when(x["at"] < F.col("at"), x["more"]).otherwise(0)))
    placed = materialize(found.select(
        "id", "grp", "leaf", "altered", "total", place.alias("pos"),
        F.exists(more, lambda x: x["at"] == F.col("at")).alias("shared")), "merkle-places")
    return placed.where("NOT shared").drop("shared").unionByName(place_copies(placed.where("shared").drop("shared")))


def place_copies(shared: DataFrame) -> DataFrame:
    """Rows of one group and id get places side by side, by leaf. Equal rows are counted first and made again last; the
    different leaves of an id are numbered within their first four digits, and those by their totals."""
    kinds = shared.withColumn("head", F.substring("leaf", 1, 4)).groupBy(*shared.columns, "head").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = kinds.groupBy("grp", "id", "head").agg(F.sum("n").alias("n")).select(
        "grp", F.coalesce("id", F.lit(0)).alias("id0"), F.col("id").isNull().alias("no_id"), "head",
        F.coalesce(F.sum("n").over(before.partitionBy("grp", "id")), F.lit(0)).alias("base"))
    inside = Window.partitionBy("grp", "id", "head").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    kinds = (kinds.withColumns({"nth": F.coalesce(F.sum("n").over(inside), F.lit(0)), "no_id": F.col("id").isNull(),
                                "id0": F.coalesce("id", F.lit(0))})
             .join(heads, ["grp", "id0", "no_id", "head"]))
    return expand_copies(kinds, "n", "copy").select(
        *[c for c in shared.columns if c != "pos"], (F.col("pos") + F.col("base") + F.col("nth") + F.col("copy")).alias("pos"))


def _levels(digests: bytes, several: bool) -> list[bytes]:
    """The nodes of a block, level by level, as hexadecimal digests one after another. A block of several climbs all
    its levels; the only one of a group stops at its root."""
    levels = [digests]
    while len(levels) <= LEVELS if several else len(levels[-1]) > HEX:
        below = levels[-1]
        levels.append("".join(
            hashlib.sha256(below[i:i + FANOUT * HEX]).hexdigest() for i in range(0, len(below), FANOUT * HEX)).encode())
    return levels


def _slots(table: pa.Table) -> tuple[np.ndarray, bytes, bool]:
    """Rows in the order of their slots, the digests in that order, and whether the group has more blocks."""
    pos = table.column("pos").to_numpy() % BLOCK
    order = np.empty(len(pos), np.int64)
    order[pos] = np.arange(len(pos))
    digests = "".join(table.column("digest").take(pa.array(order)).to_pylist()).encode()
    return order, digests, table.column("total")[0].as_py() > BLOCK


def _block_root(key: tuple, table: pa.Table) -> pa.Table:
    _, digests, several = _slots(table)
    return pa.table({"grp": pa.array([key[0].as_py()], pa.binary()), "pos": pa.array([key[1].as_py()], pa.int64()),
                     "digest": [_levels(digests, several)[-1].decode()],
                     "total": pa.array([-(-table.column("total")[0].as_py() // BLOCK)], pa.int64())})


def _steps(levels: list[bytes], slot: int) -> tuple[list[int], list[str]]:
    """The path from a slot to the block's root: its place in each run, and its siblings."""
    own, others = [], []
    for level in levels[:-1]:
        run = level[slot // FANOUT * FANOUT * HEX:(slot // FANOUT + 1) * FANOUT * HEX]
        at = slot % FANOUT
        own.append(at)
        others.append((run[:at * HEX] + run[(at + 1) * HEX:]).decode())
        slot //= FANOUT
    return own, others


def _paths(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
    """The path to the root of each node of a block."""
    order, digests, several = _slots(table)
    levels = _levels(digests, several)
    up_own, up_others = above.column("own")[0].as_py(), above.column("others")[0].as_py()
    found = [_steps(levels, slot) for slot in range(len(order))]
    picked = table.take(pa.array(order))
    return pa.table({
        "grp": picked.column("grp"), "pos": picked.column("pos"),
        "own": pa.array([o + up_own for o, _ in found], pa.list_(pa.int32())),
        "others": pa.array([s + up_others for _, s in found], pa.list_(pa.string())),
        "subroot": pa.array([above.column("subroot")[0].as_py()] * len(order), pa.string())})


def fold(digest: str, own: list[int], others: list[str]) -> str:
    """The root that follows from a digest and the path's siblings."""
    for at, sibs in zip(own, others):
        digest = hashlib.sha256((sibs[:at * HEX] + digest + sibs[at * HEX:]).encode()).hexdigest()
    return digest


def _proofs(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
    """Proof and folded root of each leaf of a block."""
    order, digests, several = _slots(table)
    levels = _levels(digests, several)
    up_own, up_others = above.column("own")[0].as_py(), above.column("others")[0].as_py()
    picked = table.take(pa.array(order))
    proofs, folded = [], []
    climbed: dict[tuple[int, str], str] = {}
    for slot, altered in enumerate(picked.column("altered").to_pylist()):
        own, others = _steps(levels, slot)
        own, others = own + up_own, others + up_others
        proofs.append(hashlib.sha256("".join(others).encode()).hexdigest())
        if len(levels) == 1:  # a lone leaf: the whole path lies above
            folded.append(fold(altered, own, others))
            continue
        node = fold(altered, own[:1], others[:1])  # the rest of the path is the run's
        if (slot // FANOUT, node) not in climbed:
            climbed[slot // FANOUT, node] = fold(node, own[1:], others[1:])
        folded.append(climbed[slot // FANOUT, node])
    return pa.table({"doc_id": picked.column("id"), "leaf": picked.column("digest"),
                     "subroot": pa.array([above.column("subroot")[0].as_py()] * len(order), pa.string()),
                     "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})


NODES = "grp binary, pos long, digest string, total long"
PATHS = "grp binary, pos long, own array<int>, others array<string>, subroot string"
PROOFS = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def in_blocks(df: DataFrame):
    return df.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).groupBy("grp", "block")


def climb(nodes: DataFrame, what: str) -> list[DataFrame]:
    """Nodes (grp, pos, digest, total) and their blocks' roots, tier on tier, until every group has one."""
    tiers = [nodes]
    while (most := tiers[-1].agg(F.max("total")).first()[0]) is not None and most > 1:
        roots = in_blocks(tiers[-1].select("grp", "pos", "digest", "total")).applyInArrow(_block_root, NODES)
        tiers.append(materialize(roots, f"merkle-{what}-{len(tiers)}"))
    return tiers


def along(nodes: DataFrame, above: DataFrame, made, schema: str) -> DataFrame:
    """``made`` on each block of nodes and the path above the block."""
    up = above.withColumnRenamed("pos", "block").groupBy("grp", "block")
    return in_blocks(nodes).cogroup(up).applyInArrow(made, schema)


def descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the nodes of the lowest of ``tiers``, from the paths ``above`` the groups' roots, the last tier."""
    for nodes in reversed(tiers[:-1]):
        above = materialize(along(nodes, above, _paths, PATHS), "merkle-paths")
    return above


def numbered(df: DataFrame, key: str, what: str) -> DataFrame:
    """Rows with ``pos``, their number in the order of ``key``: a range-partitioned sort, numbers within the
    partitions, and the partitions' offsets."""
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    cut = materialize(df.orderBy(key).withColumns({"cut": F.spark_partition_id(), "nth": within}), what)
    sizes = cut.groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("cut", F.coalesce(F.sum("n").over(  # one row per partition
        Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy()).alias("total"))
    return cut.join(F.broadcast(offsets), "cut").withColumn("pos", F.col("nth") + F.col("offset")).drop("cut", "nth", "offset")


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every row of ``docs`` (columns ``FIELDS``)."""
    spark = docs.sparkSession
    leaves = materialize(leaves_of(docs), "merkle-leaves")
    placed = materialize(add_places(leaves).withColumnRenamed("leaf", "digest"), "merkle-placed")
    tiers = climb(placed, "leaves")
    # the tree over the groups' roots is one group more
    groups = materialize(numbered(tiers[-1].select(F.col("grp").alias("name"), "digest"), "name", "merkle-order"), "merkle-groups")
    over = climb(groups.withColumn("grp", F.lit(b"")), "groups")
    root = over[-1].select("digest").first()
    start = spark.createDataFrame([(b"", 0, [], [], None)], PATHS)
    paths = descend(over, start).drop("grp", "subroot").join(groups, "pos").select(
        F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "own", "others", F.col("digest").alias("subroot"))
    paths = descend(tiers[1:], materialize(paths, "merkle-tops")) if len(tiers) > 1 else paths
    return along(placed, paths, _proofs, PROOFS).select(
        "doc_id", "leaf", "subroot", F.lit(root and root[0]).cast("string").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root and root[0]).cast("string")).alias("verified"))
