"""The daily run as a stream: what arrived since the last run, merged into bucketed tables that keep reviews."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lacuna.operators import bucketed
from lacuna.operators.bucketed import Bucketed
from lacuna.operators.relations import upsert
from lacuna.staging import shared_folder


def arrivals(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def daily_counts(events: DataFrame, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts by day and type; a day is given out once it can get no more rows that are late by so much at most."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 day").alias("day"), "event_type").agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), "event_type", "n")


class _FirstSeen(StatefulProcessor):
    """A key's first row; that it came is kept for good."""

    def __init__(self, order: list[str], schema):
        self.order, self.schema = order, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.came = handle.getValueState("came", "came boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part if first is None else pd.concat([first, part])
            first = part.sort_values(self.order, kind="stable", na_position="first").head(1)
        if first is not None and not self.came.exists():
            self.came.update((True,))
            yield first

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_seen(rows: DataFrame, key: list[str], ts: str, late: str | None = None) -> DataFrame:
    """Each key once over all runs of a checkpoint: of the batch that brings it, the row that is first by ts, then by the other columns that can be put in order.

    Keys are kept for good, in the state store, whose provider is set to one that holds more than memory does. late: forget them once the
    watermark, so much behind the latest ts, has passed them; a key that comes again after that is given out again.
    """
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        return timed.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    order = [ts, *(f.name for f in timed.schema if f.name not in (*key, ts) and f.dataType.typeName() in ("string", "long", "integer", "double", "boolean", "date", "timestamp"))]
    return timed.groupBy(*key).transformWithStateInPandas(_FirstSeen(order, timed.schema), timed.schema, "Append", "None")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work off all that is there, then stop; a run that was cut short goes on where it stopped."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _last(batch: DataFrame, key: list[str], order: list[str] | None) -> DataFrame:
    """One row for each key: the greatest by order, of equal ones (or without an order) the greatest by all columns, so that a batch that runs again chooses alike."""
    rest = [c for c in batch.columns if c not in key]
    by = F.struct(*(order or []), *rest) if rest else F.lit(1)
    return batch.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("last")).select(*key, "last.*").select(*batch.columns) if rest else batch.distinct()


def merger(folder: str, key: list[str], update: list[str] | None = None, order: list[str] | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Merge each batch into the bucketed table in folder; of a key that comes twice the last by order counts. Only the buckets that a batch touches are written.

    What is stored does not hang on the number of a batch: one that runs again changes nothing, and where the checkpoint is lost, what comes again is merged
    into what is there. Read it by bucketed.read().
    """
    table = Bucketed(folder, key, buckets=buckets)

    def merge(batch: DataFrame, number: int) -> None:
        bucketed.merge(table, _last(batch, key, order), update)

    return merge


def replacer(
    folder: str, key: list[str], scope: str, reviews: Callable[[SparkSession], DataFrame], current: str = "is_current", order: list[str] | None = None, buckets: int = 64
) -> Callable[[DataFrame, int], None]:
    """As merger(), but a batch is all that is current of each value of scope in it. What was stored of such a value and did not come again is superseded
    (current is false) where reviews (the key columns) name it, else it is deleted; other values of scope stay as they are.

    Buckets go by scope, so keys are unique within a value of it: it is part of the table's key if it is none of key.
    """
    whole = key if scope in key else [scope, *key]
    table = Bucketed(folder, whole, [scope], buckets)

    def apply(stored: DataFrame, new: DataFrame) -> DataFrame:
        stale = stored.join(new.select(scope).distinct(), scope, "left_semi").join(new.select(*whole), whole, "left_anti")
        named = reviews(new.sparkSession).select(*key).distinct()
        superseded = stale.join(named, key, "left_semi").withColumn(current, F.lit(False))
        kept = stored.join(stale.select(*whole), whole, "left_anti").unionByName(superseded.select(*stored.columns))
        return upsert(kept, new, whole)

    def replace(batch: DataFrame, number: int) -> None:
        bucketed.change(batch.sparkSession, table, _last(batch, whole, order), apply)

    return replace


def settled_daily_counts(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """daily_counts() of the table name in folder (a file or a folder of files) in one run, days that are over at the last event; the stream writes files in the shared folder."""
    place = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{name}*")
    counts = daily_counts(stream, late="0 seconds")
    query = counts.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{place}/rows").withColumn("day", F.col("day").cast("timestamp_ntz"))
