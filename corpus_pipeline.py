"""The corpus pipeline: documents in, a clean, mixed and sharded training set out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns they were given, untouched; the last
adds ``vslot`` and ``shard`` (with underscores where the documents have such a column). A document that the mix takes twice is two rows.

Null or empty texts pass the first three stages (they score the calibrated share of toxic texts, are
nobody's duplicate and leak nothing); the mix takes no words from them, so it
leaves them as often as their source's share says. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragchew.llm import decontam, mixing, near_dups, sharding, toxicity
from ragchew.llm.common import materialize, pack

REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``REJECT`` (operator 2)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    packed, unpack = pack(docs, ["doc_id", "text"])
    scored = toxicity.score(packed, toxicity.fit(docs, labels))
    return unpack(scored.where(F.col("score") < REJECT))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (operator 8)."""
    return near_dups.keep_one(docs, similarity=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item (operator 10)."""
    packed, unpack = pack(docs, ["doc_id", "text"])
    marked = decontam.mark_leaks(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpack(marked.where(F.size("leak_items") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it (operator 3)."""
    return mixing.mix_rows(docs)


def put_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their virtual slot and shard (operator 7)."""
    return sharding.shard_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", put_in_shards),
]

# Trained scores and hashes: SQL cannot say the same; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
