"""A stored logarithmic family of suffix arrays, to which batches of documents are added.

``suffix_index`` removes the repeats of one table. Here the index outlives the job: a batch gets its suffix array (the stretches of
its texts in the order of anchor and stretch, cut into files by ranges of that order), is scanned together with
the suffixes of all stored levels that have an anchor of the batch, and becomes a level. Levels of equal
size class (the power of two of ``unit`` suffixes that they hold) are merged into one of the next class, so n batches leave
about log n levels and a suffix is written about log n times.

What is found for a batch concerns stored documents too: one of them loses a string once a later batch brings its
second place. Each level keeps the runs found when it came; ``results`` takes the runs of all levels.
No anchor without a suffix in the batch is looked at again, and these alone can have new partners.

Under the index's path there is a folder per level (``suffixes``, ``texts``, ``runs``) and a numbered manifest of the levels in
force. A write ends with one rename of the next manifest, which fails if another writer took its number
(``IndexConflict``); a job that stops before leaves folders that nobody reads, and ``vacuum`` removes them.

An addition reads the suffixes of all levels and shuffles them and the stored texts by key, for the texts of the
documents that it concerns; its scan and its windows grow with what the batch has in common with the index. The driver holds the list of
levels and at most ``2 * HOT`` frequent anchors.

Edge cases are those of ``suffix_index``; a batch without rows adds nothing, one without long texts a level without suffixes, and
rows added twice are separate documents that repeat each other.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragchew.llm.common import materialize
from ragchew.llm.suffix_index import GRAM, HOT, KEY, LENGTH, SALTS, _suffixes, keyed, repeated, without

UNIT = 1 << 24
SCHEMAS = {
    "suffixes": "anchor long, stretch long, k long, k0 int, t int, first int, windows int",
    "texts": "k long, k0 int, t int, doc_id long, text binary",
    "runs": "k long, k0 int, t int, first int, windows int",
}


class IndexConflict(RuntimeError):
    """Another writer changed the index first; nothing of this write is seen."""


class SuffixIndex:
    """The index stored at ``path``; ``length`` and ``gram`` must be the same for all that use it."""

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM, unit: int = UNIT):
        self.spark, self.path, self.length, self.gram, self.unit = spark, path.rstrip("/"), length, gram, unit

    # --- manifest ------------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        where = self._hadoop(folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """Number of the manifest in force, 0 before the first batch."""
        return max((int(n) for n in self._names(f"{self.path}/manifest") if n.isdigit()), default=0)

    def levels(self, version: int | None = None) -> list[tuple[str, int]]:
        """(folder, number of suffixes) of each level in force, oldest first."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifest/{version:06d}").collect()
        return [(r.level, r.suffixes) for r in sorted(rows, key=lambda r: r.place)]

    def size_class(self, suffixes: int) -> int:
        return max(suffixes // self.unit, 1).bit_length()

    def _publish(self, version: int, levels: list[tuple[str, int]]) -> None:
        temp, final = f"{self.path}/manifest/_writing-{uuid.uuid4().hex}", f"{self.path}/manifest/{version:06d}"
        self.spark.createDataFrame([(i, *level) for i, level in enumerate(levels)],
                                   "place int, level string, suffixes long").coalesce(1).write.parquet(temp)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # refuses a target that exists
        source = self._hadoop(temp)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, self._hadoop(final), options)
        except Exception as error:
            if self.version() < version:
                raise
            raise IndexConflict(f"{self.path}: version {version} was written by another job") from error

    # --- tables of the levels ------------------------------------------------------------------------

    def _read(self, table: str, levels: list[str]) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[table])
        if not levels:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return reader.parquet(*[f"{self.path}/{level}/{table}" for level in levels])

    def _write(self, table: str, level: str, rows: DataFrame) -> DataFrame:
        if table == "suffixes":  # a frequent anchor spans several ranges
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            order = ["anchor", "stretch", "k", "first"]
            rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        rows.write.parquet(f"{self.path}/{level}/{table}")
        return self._read(table, [level])

    def _merged(self, levels: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """Levels after all merges of equal classes; a merge of several steps is written once."""
        groups: list[tuple[list[str], int]] = []
        for level, n in levels:
            group = [level]
            while any(self.size_class(n) == self.size_class(m) for _, m in groups):
                at = next(i for i, (_, m) in enumerate(groups) if self.size_class(n) == self.size_class(m))
                others, m = groups.pop(at)
                group, n = others + group, n + m
            groups.append((group, n))
        out = []
        for group, n in groups:
            level = group[0] if len(group) == 1 else f"level-{uuid.uuid4().hex}"
            if len(group) > 1:
                self._write("suffixes", level, self._read("suffixes", group))
                self._write("texts", level, self._read("texts", group))
                self._write("runs", level, self._read("runs", group).distinct())
            out.append((level, n))
        return out

    # --- use -----------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Add a batch and find its repeats, in itself and with all stored levels. Returns the new version."""
        version = self.version()
        known = self.levels(version)
        names, level = [name for name, _ in known], f"level-{uuid.uuid4().hex}"
        texts = self._write("texts", level, keyed(docs, id_col, text_col))
        if texts.isEmpty():
            return version
        own = self._write("suffixes", level, texts.select(*KEY, "text").mapInArrow(
            _suffixes(self.length, self.gram, 1, np.zeros(0, np.int64)),
            "anchor long, salt int, stretch long, batch int, k long, k0 int, t int, first int, windows int"
        ).drop("salt", "batch"))
        scanned = own.withColumn("batch", F.lit(len(known)))
        for number, name in enumerate(names):
            partners = self._read("suffixes", [name]).join(own.select("anchor").distinct(), "anchor", "left_semi")
            scanned = scanned.unionByName(partners.withColumn("batch", F.lit(number)))
        scanned = materialize(scanned, "repeat-scanned")
        total = scanned.count()
        often = [r.anchor for r in scanned.groupBy("anchor").count().where(F.col("count") * 2 * HOT >= total).collect()] \
            if total > 2 * HOT else []
        salt = F.when(F.col("anchor").isin(often), 1 + F.pmod(F.xxhash64("k", "first"), F.lit(SALTS))).otherwise(0)
        scanned = scanned.select("anchor", salt.cast("int").alias("salt"), "stretch", "batch", *KEY, "first", "windows")
        # texts of stored documents that have an anchor of the batch
        asked = scanned.where(F.col("batch") < len(known)).select(*KEY).distinct()
        concerned = texts.unionByName(self._read("texts", names).join(asked, KEY, "left_semi")) if names else texts
        self._write("runs", level, repeated(scanned, concerned, self.length).distinct())
        self._publish(version + 1, self._merged([*known, (level, own.count())]))
        return version + 1

    def results(self, version: int | None = None) -> DataFrame:
        """Every document of the index without its repeated strings, as ``suffix_index.remove_repeats`` returns them."""
        names = [name for name, _ in self.levels(version)]
        return without(self._read("texts", names), self._read("runs", names), self.length)

    def vacuum(self) -> list[str]:
        """Delete the folders that the manifest in force does not name, and the older manifests. Not beside a running writer."""
        version = self.version()
        kept = {name for name, _ in self.levels(version)}
        gone = [f"{self.path}/{n}" for n in self._names(self.path) if n.startswith("level-") and n not in kept]
        gone += [f"{self.path}/manifest/{n}" for n in self._names(f"{self.path}/manifest") if n != f"{version:06d}"]
        for path in gone:
            where = self._hadoop(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return gone
