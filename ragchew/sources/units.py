"""Tables kept by units (a log, a day, a page) and changed by one rename.

Layout under a root:

* ``rows/commit=/<partition columns>/bucket=/`` -- the rows; each write has a folder of its own;
* ``units/commit=/<partition columns>/bucket=/`` -- one row per unit of those rows;
* ``manifest/000007/`` -- one row per (partition, bucket, commit) folder in force.

A unit's bucket is a hash of its key. A write reads the units table (not the rows) of the buckets it
touches to see which of its units are there already. Buckets that hold one are written anew beside the old
folder, without the replaced units and with the new rows; the others get a folder more. Then the next manifest is
written under a name of its own and renamed to its number. Until that rename readers see the old table, after it the
new one, and a job that stops in between leaves only folders that nobody reads (``vacuum`` removes them). A writer that began from
the same manifest as another finds its number taken: ``StoreConflict``, and nothing of it is seen.

The driver holds the list of folders, never rows: partitions x buckets x at most ``MAX_FOLDERS``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragchew.session import materialize

PARTITIONS = ["contest", "contest_mode", "year"]
BUCKETS = 16
# A bucket with as many folders is written as one when it is next added to.
MAX_FOLDERS = 8
BUCKET, COMMIT = "__bucket", "__commit"


class StoreConflict(RuntimeError):
    """Another writer changed the table first; nothing of this write is seen."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def latest(spark: SparkSession, root: str) -> int:
    """Number of the manifest in force; 0 where there is none."""
    return max((int(n) for n in _names(spark, f"{root}/manifest") if n.isdigit()), default=0)


def exists(spark: SparkSession, root: str) -> bool:
    return latest(spark, root) > 0


def _folders(spark: SparkSession, root: str, number: int | None = None) -> list[T.Row]:
    """The manifest: rows of (partition values as text, bucket, commit, schema, unit schema, partition columns)."""
    number = latest(spark, root) if number is None else number
    return spark.read.parquet(f"{root}/manifest/{number:06d}").collect() if number else []


def _publish(spark: SparkSession, root: str, number: int, folders: list[tuple]) -> None:
    """Make ``folders`` the manifest ``number``, unless that number is taken."""
    temp, final = f"{root}/manifest/_writing-{uuid.uuid4().hex}", f"{root}/manifest/{number:06d}"
    schema = "place array<string>, bucket int, commit string, rows string, units string, by array<string>"
    spark.createDataFrame(folders, schema).coalesce(1).write.parquet(temp)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (temp, final))
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE  # refuses a target that exists
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, options)
    except Exception as error:
        if latest(spark, root) < number:
            raise
        raise StoreConflict(f"{root}: version {number} was written by another job") from error


def _path(spark: SparkSession, root: str, table: str, row) -> str:
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    parts = [f"{c}={escape(v)}" for c, v in zip(row.by, row.place)]
    return "/".join([root, table, f"{COMMIT}={row.commit}", *parts, f"{BUCKET}={row.bucket}"])


def _schema(folders: list, which: str) -> T.StructType:
    """The columns of all folders in force, those of the last write first."""
    out: dict[str, T.StructField] = {}
    for text in dict.fromkeys(row[which] for row in reversed(folders)):
        for field in T.StructType.fromJson(json.loads(text)).fields:
            out.setdefault(field.name, field)
    return T.StructType(list(out.values()))


def _read(spark: SparkSession, root: str, table: str, folders: list) -> DataFrame:
    schema = _schema(folders, table)
    kinds = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(COMMIT, T.StringType())])
    return (spark.read.schema(kinds).option("basePath", f"{root}/{table}")
            .parquet(*[_path(spark, root, table, f) for f in folders]).select(*schema.names, BUCKET))


def _chosen(folders: list, where: dict | None) -> list:
    """The folders of the asked partition values (value, or list of values)."""
    out = []
    for row in folders:
        values = dict(zip(row.by, row.place))
        if all(values[c] in {str(x) for x in (v if isinstance(v, (list, tuple, set)) else [v])} for c, v in (where or {}).items()):
            out.append(row)
    return out


def load(spark: SparkSession, root: str, where: dict | None = None, number: int | None = None) -> DataFrame:
    """The rows in force (of version ``number``, if asked for), of partitions with the values ``where`` only."""
    folders = _folders(spark, root, number)
    if not folders:
        raise FileNotFoundError(f"no stored table at {root}")
    some = _chosen(folders, where)
    if not some:
        return spark.createDataFrame([], _schema(folders, "rows"))
    return _read(spark, root, "rows", some).drop(BUCKET)


def stored_units(spark: SparkSession, root: str, where: dict | None = None) -> DataFrame | None:
    """The units in force, from the units table: no row is read. None where nothing is stored."""
    folders = _folders(spark, root)
    some = _chosen(folders, where)
    if not some:
        return spark.createDataFrame([], _schema(folders, "units")) if folders else None
    return _read(spark, root, "units", some).drop(BUCKET)


def put(df: DataFrame, root: str, key: dict[str, Column], cluster_by: list[str] | None = None,
        units: DataFrame | None = None, partitions: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Put the units of ``df`` into the table at ``root`` and leave every other unit as it is.

    A unit is the ``partitions`` columns plus the ``key`` columns (name -> expression over the columns of
    ``df``), none of them null. Units that are stored already are replaced. ``units`` names further units (same
    columns) to be replaced, also where ``df`` has no row of them: they then have none. ``cluster_by`` keeps rows
    alike in those columns in one file. ``buckets`` holds for the first write; later ones keep to it only if it is the same.
    Returns the units of ``df``. The rows of ``df`` are computed and written once, into the folder of the write; what
    else is asked of them is read back from there.
    """
    spark = df.sparkSession
    by = list(partitions or PARTITIONS)
    unit = [*by, *key]
    base = latest(spark, root)
    folders = _folders(spark, root, base) if base else []

    def bucket_of() -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in unit]), F.lit(buckets)).cast("int")

    commit = uuid.uuid4().hex
    own = {c: v for c, v in key.items() if c not in df.columns}  # not stored

    def write(rows: DataFrame) -> DataFrame:
        plain = rows.drop(*own)
        out = plain.repartition(*by, BUCKET, *cluster_by) if cluster_by else plain
        out.write.mode("append").partitionBy(*by, BUCKET).parquet(f"{root}/rows/{COMMIT}={commit}")
        return plain

    plain = write(df.withColumns(key).withColumn(BUCKET, bucket_of()))
    new = spark.read.schema(plain.schema).parquet(f"{root}/rows/{COMMIT}={commit}").withColumns(own)
    there = materialize(new.select(*unit, BUCKET).distinct(), "store-units")
    asked = there
    if units is not None:
        asked = materialize(there.unionByName(units.select(*unit).withColumn(BUCKET, bucket_of())).distinct(), "store-asked")
    place = F.array(*[F.col(c).cast("string") for c in by])
    touched = {(tuple(r.place), r.bucket) for r in asked.select(place.alias("place"), F.col(BUCKET).alias("bucket")).distinct().collect()}
    old = [f for f in folders if (tuple(f.place), f.bucket) in touched]
    again = set()
    if old:
        hit = _read(spark, root, "units", old).join(asked.select(*unit), unit, "left_semi")
        again = {(tuple(r.place), r.bucket) for r in hit.select(place.alias("place"), F.col(BUCKET).alias("bucket")).distinct().collect()}
        count: dict = {}
        for f in old:
            count[tuple(f.place), f.bucket] = count.get((tuple(f.place), f.bucket), 0) + 1
        again |= {k for k, n in count.items() if n >= MAX_FOLDERS}
    marks = there
    if again:
        kept = [f for f in old if (tuple(f.place), f.bucket) in again]
        rest = _read(spark, root, "rows", kept).withColumns(key).join(asked.select(*unit), unit, "left_anti")
        both = rest.unionByName(new, allowMissingColumns=True)
        if any(both.schema[f.name].dataType != f.dataType for f in new.schema.fields):
            commit, rest = uuid.uuid4().hex, both  # columns of another type than before: all rows anew
        plain = write(rest.unionByName(both.limit(0), allowMissingColumns=True))
        marks = _read(spark, root, "units", kept).join(asked.select(*unit), unit, "left_anti").unionByName(there)
    marks = marks.repartition(*by, BUCKET)
    marks.write.partitionBy(*by, BUCKET).parquet(f"{root}/units/{COMMIT}={commit}")
    written = touched
    if again or asked is not there:  # a bucket whose units were all taken out has no folder
        some = marks.select(place.alias("place"), F.col(BUCKET).alias("bucket")).distinct().collect()
        written = {(tuple(r.place), r.bucket) for r in some}
    schemas = (plain.drop(BUCKET).schema.json(), marks.drop(BUCKET).schema.json())
    keep = [tuple(f) for f in folders if (tuple(f.place), f.bucket) not in again]
    _publish(spark, root, base + 1, keep + [(list(p), b, commit, *schemas, by) for p, b in sorted(written)])
    return there.drop(BUCKET)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove the folders that none of the last ``keep`` manifests names, and older manifests; the number of
    folders removed. Not while a writer is at work: what it has written is in no manifest yet."""
    numbers = sorted(int(n) for n in _names(spark, f"{root}/manifest") if n.isdigit())
    alive = {_path(spark, root, table, f) for n in numbers[-keep:] for f in _folders(spark, root, n) for table in ("rows", "units")}
    gone = 0

    def remove(path: str) -> None:
        fs, where = _fs(spark, path)
        fs.delete(where, True)

    def walk(path: str) -> None:
        nonlocal gone
        if any(a.startswith(f"{path}/") for a in alive):
            for name in _names(spark, path):
                if "=" in name and f"{path}/{name}" not in alive:
                    walk(f"{path}/{name}")
        else:
            remove(path)
            gone += 1

    for table in ("rows", "units"):
        for name in _names(spark, f"{root}/{table}"):
            walk(f"{root}/{table}/{name}")
    for name in _names(spark, f"{root}/manifest"):
        if not name.isdigit() or int(name) not in numbers[-keep:]:
            remove(f"{root}/manifest/{name}")
    return gone
