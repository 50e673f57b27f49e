"""Tables in buckets of a key's hash, of which a change writes anew those buckets alone that it touches.

A version is a row of the manifest for each bucket: the folder that holds it. A change reads the buckets of its rows, writes them into new folders and then a manifest with the others'
folders as they were, so readers see the version before until then, and a change that broke off is never seen. Applying the same change again gives the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.relations import upsert
from lacuna.staging import staged

MANIFEST = "bucket int, place string, version long"


@dataclass(frozen=True)
class Bucketed:
    folder: str
    key: list[str]
    #: Columns of the key that buckets go by; all of it if None.
    by: list[str] | None = None
    #: For good: a table keeps the number that it began with.
    buckets: int = 64

    def __post_init__(self) -> None:
        if not set(self.by or []) <= set(self.key):
            raise ValueError("buckets go by columns of the key")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.key)), F.lit(self.buckets)).cast("int").alias("__bucket")


def manifest(spark: SparkSession, table: Bucketed, version: int | None = None) -> DataFrame:
    """bucket, place, version: of the latest version, or of one; no rows before the first."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{table.folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    if version is None:
        # Versions are folders, so only their names are looked at.
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version)


def latest_version(spark: SparkSession, table: Bucketed) -> int:
    """0 before the first."""
    return manifest(spark, table).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _places(spark: SparkSession, table: Bucketed, version: int | None = None) -> dict[int, str]:
    """As many as there are buckets."""
    return {r["bucket"]: r["place"] for r in manifest(spark, table, version).collect() if r["place"]}


def _rows(spark: SparkSession, table: Bucketed, places: list[str], schema) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table.folder}/{p}" for p in sorted(places)])


def read(spark: SparkSession, table: Bucketed, schema, version: int | None = None) -> DataFrame:
    """The table as of its latest version, or of one."""
    return _rows(spark, table, list(_places(spark, table, version).values()), schema)


def change(spark: SparkSession, table: Bucketed, rows: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], also: DataFrame | None = None) -> int:
    """Write the buckets of rows (and of also, which has the columns that buckets go by) anew, as apply(what they hold, rows); other buckets stay as they are, files
    and all. apply must keep rows in their buckets. Gives the version. One change at a time; no rows change nothing."""
    rows = staged(rows, "changes")
    named = rows.select(table.bucket()) if also is None else rows.select(table.bucket()).union(also.select(table.bucket()))
    touched = sorted(r[0] for r in named.distinct().collect())
    places, last = _places(spark, table), latest_version(spark, table)
    if not touched:
        return last
    stored = _rows(spark, table, [places[b] for b in touched if b in places], rows.schema)
    made = apply(stored, rows).select(*rows.columns, table.bucket())
    token = f"data/{uuid.uuid4().hex}"
    # Large buckets are several files, written by several tasks.
    made.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{table.folder}/{token}")
    written = {int(r[0]) for r in spark.read.parquet(f"{table.folder}/{token}").select("__bucket").distinct().collect()} if _any(spark, f"{table.folder}/{token}") else set()
    places = {b: p for b, p in places.items() if b not in touched} | {b: f"{token}/__bucket={b}" for b in written}
    # A table that lost its last row has a row without a place, so that its version is seen.
    listed = sorted(places.items()) or [(0, None)]
    spark.createDataFrame(listed, "bucket int, place string").coalesce(1).write.parquet(f"{table.folder}/manifest/version={last + 1}")
    return last + 1


def _any(spark: SparkSession, folder: str) -> bool:
    """Whether anything was written below folder: without rows there are no buckets."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return any("__bucket=" in s.getPath().getName() for s in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place))


def merge(table: Bucketed, rows: DataFrame, update: list[str] | None = None) -> int:
    """rows, of which each key has one, put in by key: new keys are added, of known keys the columns update are replaced (all if None)."""
    return change(rows.sparkSession, table, rows, lambda stored, new: upsert(stored, new, table.key, update))


def vacuum(spark: SparkSession, table: Bucketed, keep: int = 2) -> int:
    """Delete what only versions before the last keep hold; readers of those must be done. Gives the number of folders that went."""
    last = latest_version(spark, table)
    needed = {p for v in range(max(1, last - keep + 1), last + 1) for p in _places(spark, table, v).values()}
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.folder)
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = 0
    for version in range(1, last - keep + 1):
        system.delete(path(f"{table.folder}/manifest/version={version}"), True)
    for run in system.listStatus(path(f"{table.folder}/data")) if last else []:
        for place in system.listStatus(run.getPath()):
            name = f"data/{run.getPath().getName()}/{place.getPath().getName()}"
            if "__bucket=" in name and name not in needed:
                system.delete(place.getPath(), True)
                gone += 1
    return gone
