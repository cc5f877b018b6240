"""Mixing sources to target weights by pivotal rounding (DataFrame functions only).

Every document of a source starts with the same fractional number of copies,
``target / size of the source``. The whole part is certain. The fractions are
rounded in pairs: of two fractions, mass (in words) moves at random from one to the other,
so that both expectations stay as they are, until one of them is 0 or 1. Blocks of documents are walked
from the longest to the shortest, and each document is paired with the rest of its block, whose
documents have one fraction in common: the document becomes 0 or 1 and the rest makes up for it, as long as the rest
is large enough; a rest that is not becomes 0 or 1 itself, and the document is the residual. Else the
shortest document is. Residuals are paired one with the next, block-wise again, level by level, up
to one per source, which is rounded at random. A source of a single block has no other block to make up for a document that is
too long for its rest: that document takes the side that misses the target by less, which is the one draw that is not
at random. A source's words thus differ from its target by less than one document: a short one, but
where a document outweighs the rest of its block.

Edge cases: a null text has size 0; documents of size 0 take nothing; a null
source is a source of its own; rows equal in id, source and size are separate documents that get
numbers of their own; an empty table gives an empty result. All draws are
hashes of ids and a seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragchew.llm.common import SPACES, expand_copies, free_name, let, materialize, uniform

WEIGHTS = (3.0, 1.0, 2.0)
FAN_IN = 256
NEAR = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, at_most: float = 2.0) -> DataFrame:
    """Targets of sources from a table (source, source_size, n): weights repeat in code point
    order, null last; together they get ``share`` of all words, each ``at_most`` times its
    own, what is above being shared out again by weight.

    Filling by weight with caps: in the order of cap / weight, the first sources are
    full and the others get the same level times their weight. One row per source, so
    the ordering windows see a small table.
    """
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(at_most))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    t = t.withColumn("full", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)))
    t = t.withColumn("left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    # the level if this source were the first that is not full; the first that holds is right
    t = t.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share)
                               - F.coalesce("full", F.lit(0.0))) / F.col("left"))
    t = t.withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))
                  ).over(everything)
    return t.withColumn("level", level["level"]).select(
        "source", "source_size", "n", "weight",
        F.when(F.col("level").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("level") * F.col("weight"))).cast("double").alias("target"))


def _pair(seed: int):
    """One step of the pivotal walk over a block: state (cur, done) and the next unit."""

    def settled(unit: Column, p: Column) -> Column:
        return F.struct(unit["ids"].alias("ids"), unit["size"].alias("size"), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        a = state["cur"]

        def move(d: Column) -> Column:
            up = uniform(a["ids"], x["ids"], F.lit(seed)) * (d["up"] + d["down"]) < d["down"]
            # mass goes to a, or from a; the side that hits its bound is set exactly
            pa = F.when(up, F.when(d["up"] == d["a_room"], F.lit(1.0)).otherwise(a["p"] + d["up"] / a["size"])
                        ).otherwise(F.when(d["down"] == d["a_has"], F.lit(0.0)).otherwise(a["p"] - d["down"] / a["size"]))
            px = F.when(up, F.when(d["up"] == d["x_has"], F.lit(0.0)).otherwise(x["p"] - d["up"] / x["size"])
                        ).otherwise(F.when(d["down"] == d["x_room"], F.lit(1.0)).otherwise(x["p"] + d["down"] / x["size"]))
            return F.struct(_snap(pa).alias("a"), _snap(px).alias("x"))

        def after(p: Column) -> Column:
            a_done = (p["a"] == 0.0) | (p["a"] == 1.0)
            return F.struct(
                F.when(a_done, settled(x, p["x"])).otherwise(settled(a, p["a"])).alias("cur"),
                F.concat(state["done"], F.array(
                    F.when(a_done, settled(a, p["a"])).otherwise(settled(x, p["x"])))).alias("done"))

        room = F.struct(((1 - a["p"]) * a["size"]).alias("a_room"), (a["p"] * a["size"]).alias("a_has"),
                        ((1 - x["p"]) * x["size"]).alias("x_room"), (x["p"] * x["size"]).alias("x_has"))
        both = let(room, lambda r: let(
            F.struct(F.least(r["a_room"], r["x_has"]).alias("up"), F.least(r["a_has"], r["x_room"]).alias("down"),
                     r["a_room"].alias("a_room"), r["a_has"].alias("a_has"),
                     r["x_room"].alias("x_room"), r["x_has"].alias("x_has")),
            lambda d: let(move(d), after)))
        whole = F.struct(x.alias("cur"), F.concat(state["done"], F.array(a)).alias("done"))
        return F.when(a["p"].isNull(), F.struct(x.alias("cur"), state["done"].alias("done"))).when(
            (a["p"] == 0.0) | (a["p"] == 1.0), whole).otherwise(both)

    return step


def _pool(seed: int, single: Column):
    """One step of the walk over a block of documents of one fraction: state (fraction of the rest, size of the rest with the
    document, residual, done) and the next document. ``single``: no other block makes up for a miss."""

    def step(state: Column, x: Column) -> Column:
        q, size = state["q"], x["size"].cast("double")
        rest = state["left"] - size

        def unit(p: Column) -> Column:
            return F.struct(x["ids"].alias("ids"), x["size"].alias("size"), p.alias("p"))

        def go(q: Column, p: Column, settled: Column) -> Column:
            return F.struct(_snap(q).alias("q"), rest.alias("left"),
                            F.when(settled, state["cur"]).otherwise(unit(p)).alias("cur"),
                            F.when(settled, F.concat(state["done"], F.array(unit(p)))).otherwise(state["done"]).alias("done"))

        def move(d: Column) -> Column:
            # what the document lacks and has, and what the rest has and lacks
            short, over = d["room"] - d["rest_has"], d["has"] - d["rest_room"]
            near = single & ((short > NEAR) | (over > NEAR))  # nobody else makes up for it
            up_by, down_by = F.least(d["room"], d["rest_has"]), F.least(d["has"], d["rest_room"])
            draw = uniform(x["ids"], F.lit(seed))
            up = F.when(near & (F.greatest(short, F.lit(0.0)) != F.greatest(over, F.lit(0.0))),
                        F.greatest(short, F.lit(0.0)) < F.greatest(over, F.lit(0.0))
                        ).otherwise(draw * (up_by + down_by) < down_by)
            q_up = F.when(up_by == d["rest_has"], F.lit(0.0)).otherwise(q - up_by / rest)
            q_down = F.when(down_by == d["rest_room"], F.lit(1.0)).otherwise(q + down_by / rest)
            p_up = F.when(near | (up_by == d["room"]), F.lit(1.0)).otherwise(q + up_by / size)
            p_down = F.when(near | (down_by == d["has"]), F.lit(0.0)).otherwise(q - down_by / size)
            return let(F.struct(_snap(F.when(up, p_up).otherwise(p_down)).alias("p"),
                                F.when(up, q_up).otherwise(q_down).alias("q")),
                       lambda n: go(n["q"], n["p"], (n["p"] == 0.0) | (n["p"] == 1.0)))

        both = let(F.struct(((1 - q) * size).alias("room"), (q * size).alias("has"), (q * rest).alias("rest_has"),
                            ((1 - q) * rest).alias("rest_room")), move)
        whole = (q == 0.0) | (q == 1.0)
        # the last document is the residual, unless there is one or nothing is left to round
        return F.when(whole | state["cur"].isNotNull(), go(q, q, F.lit(True))).when(rest < 0.5, go(q, q, F.lit(False))).otherwise(both)

    return step


def _snap(p: Column) -> Column:
    return F.when(p < NEAR, F.lit(0.0)).when(p > 1 - NEAR, F.lit(1.0)).otherwise(p)


def _level(units: DataFrame, kind: str, seed: int, level: int) -> DataFrame:
    """One level of the tree: (source, block) with the settled units and the residual."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("longest"), "u", "ids", "size", "p")))
    cur, done = F.lit(None).cast(kind).alias("cur"), F.array().cast(f"array<{kind}>").alias("done")
    if level == 0:
        walk = F.aggregate(
            ordered, F.struct(F.max("p").alias("q"), F.sum("size").cast("double").alias("left"), cur, done),
            lambda s, x: _pool(seed, F.max("n") == 1)(s, x), lambda s: F.struct(s["cur"].alias("cur"), s["done"].alias("done")))
    else:
        walk = F.aggregate(ordered, F.struct(cur, done), lambda s, x: _pair(seed + level)(
            s, F.struct(x["ids"].alias("ids"), x["size"].alias("size"), x["p"].alias("p"))))
    return units.withColumn("u", F.xxhash64("ids", F.lit(seed), F.lit(level))).groupBy(
        "source", "block").agg(walk.alias("w")).select("source", "w.cur", "w.done")


def pivotal_copies(docs: DataFrame, ids: list[str], size: str = "size", source: str = "source",
                   weights=WEIGHTS, share: float = 1.5, at_most: float = 2.0,
                   seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """Whole numbers of copies for documents (ids, size, source) so that each source
    meets its target. Returns the ids, size, source, source_size, target and copies, one
    row per input row."""
    kinds = materialize(
        docs.select(F.struct(*ids).alias("ids"), F.col(size).cast("long").alias("size"),
                    F.col(source).alias("source"))
        .groupBy("ids", "size", "source").agg(F.count(F.lit(1)).alias("m")), "mix-kinds")
    sums = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"),
                                       F.sum("m").alias("n"))
    targets = materialize(source_targets(sums, weights, share, at_most).coalesce(1), "mix-targets")
    most = targets.agg(F.max("n")).first()[0] or 0

    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.select(F.col("source").alias("s"), "source_size", "target", "n", share_of.alias("share"))
    # the table of sources is joined null-safe; Spark broadcasts it by its size
    units = expand_copies(kinds, "m", "j").join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", F.struct("ids", "j").alias("ids"), "size", "n",
        F.floor("share").alias("base"), _snap(F.col("share") - F.floor("share")).alias("p"))
    walks = (F.col("size") > 0) & (F.col("p") > 0) & (F.col("p") < 1)
    parts = [units.where(~walks).select("source", "ids", "size", "p")]

    blocks = F.greatest(F.ceil(F.col("n") / fan_in), F.lit(1).cast("long"))
    now = units.where(walks).select(
        "source", "ids", "size", "p",
        F.pmod(F.xxhash64("ids", F.lit(seed)), blocks).alias("block"), blocks.alias("n"))
    kind = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in now.schema
                                if f.name in ("ids", "size", "p")) + ">"
    level = 0
    while True:
        tree = materialize(_level(now, kind, seed, level), f"mix-level{level}")
        parts.append(tree.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        cur = tree.where(F.col("cur").isNotNull()).select("source", "cur.*")
        if most <= fan_in ** (level + 1):
            break
        level += 1
        # so many residuals a source has at most; their count shrinks by the fan-in each time
        left = F.greatest(F.ceil(F.col("n") / float(fan_in) ** (level + 1)), F.lit(1).cast("long"))
        whole = (F.col("p") == 0.0) | (F.col("p") == 1.0)
        parts.append(cur.where(whole))
        now = cur.where(~whole).join(t.select("s", "n"), F.col("source").eqNullSafe(F.col("s"))).select(
            "source", "ids", "size", "p", F.pmod(F.xxhash64("ids", F.lit(seed + level)), left).alias("block"))
    parts.append(cur.withColumn("p", F.when(
        uniform("ids", F.lit(seed), F.lit("root")) < F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0))))

    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.select("source", "ids", "size", "p"))
    return out.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        "ids.ids.*", "size", "source", "source_size", "target",
        (F.floor("share") + F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0))).cast("long").alias("copies"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", **options) -> DataFrame:
    """Words that the mix takes from each document: doc_id, size, source_size, target, taken."""
    units = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"),
                        F.col(source_col).alias("source"))
    return pivotal_copies(units, ["doc_id"], **options).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).alias("taken"))


def mix_rows(docs: DataFrame, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0, 1 or 2 times by default).

    Rows are known by two hashes of all their columns. Rows that agree in everything
    share their copies: each gets the whole part, one of them what is left over.
    """
    plain = [F.col(f"`{c}`") for c in docs.columns]
    h1, h2, c, m, n, j = (free_name(docs, f"__mix_{x}") for x in ("h1", "h2", "copies", "rows", "n", "j"))
    keyed = docs.select(*plain, F.xxhash64(*plain).alias(h1), F.xxhash64(F.lit(1), *plain).alias(h2))
    units = keyed.select(h1, h2, word_count(F.col(f"`{text_col}`")).alias("mix_size"), F.col(f"`{source_col}`").alias("mix_source"))
    made = pivotal_copies(units, [h1, h2], "mix_size", "mix_source", **options)
    total = materialize(made.groupBy(h1, h2).agg(F.sum("copies").alias(c), F.count(F.lit(1)).alias(m)).where(F.col(c) > 0),
                        "mix-copies")
    base = keyed.join(total, [h1, h2]).withColumn(n, F.floor(F.col(c) / F.col(m)))
    out = expand_copies(base, n, j).select(*plain)
    odd = total.where(F.col(c) % F.col(m) != 0)
    if not odd.isEmpty():
        rest = keyed.join(odd, [h1, h2]).dropDuplicates([h1, h2]).withColumn(n, F.col(c) % F.col(m))
        out = out.unionByName(expand_copies(rest, n, j).select(*plain))
    return out
