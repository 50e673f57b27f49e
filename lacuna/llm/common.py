"""What the operators share: reading tables, staging results and scanning text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of its own; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged within are deleted at the end, but for those that are kept: they belong to the scratch around it, if there is one.

    What leaves the block must read kept tables alone.
    """
    own: list[str] = []
    outer = _scratch.set(own)
    kept = _kept.set([])
    try:
        yield
    finally:
        rest = _kept.get()
        _scratch.reset(outer)
        _kept.reset(kept)
        if _scratch.get() is not None:
            _scratch.get().extend(rest)
        for path in own:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_kept: ContextVar[list[str]] = ContextVar("kept", default=[])


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, lineage cut. keep: not deleted with the scratch that it is in."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scratch.get() is not None:
        (_kept if keep else _scratch).get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A batch of rows that goes to Python holds so many bytes at most, or one row.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches end after BATCH_BYTES: texts have any length, and a batch of thousands of them is much of a worker's memory.

    A session setting; one that is smaller already stays.
    """
    size = spark.conf.get(_BATCH_SETTING, None)
    if size is None or not size.rstrip("b").isdigit() or int(size.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Give memory that is free in this Python process back to the system; a worker stays for the next tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_in_arrow(rows: DataFrame, function: Callable, schema) -> DataFrame:
    """rows.mapInArrow(function, schema) in small batches; memory is released when a partition ends."""
    small_batches(rows.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return rows.mapInArrow(released, schema)


def row_id(key: Column, text: Column) -> Column:
    """16 bytes for a row's key and text: rows with both alike are the same; a null key is none of the others, a null text is empty."""
    named = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    return F.unhex(F.md5(F.concat(named, F.lit("\0"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary")))


def fresh_name(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row even if body uses it within lambdas."""
    return F.transform(F.array(value), body)[0]
