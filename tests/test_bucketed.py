"""Tables of which a change writes only the buckets that it touches, and streams into them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import bucketed, relations
from lacuna.operators.bucketed import Bucketed
from lacuna.streaming import increments

SCHEMA = "k long, v string, w int"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_merges_are_those_of_the_whole_table(spark, tmp_path):
    rng = random.Random(1)
    table, whole = Bucketed(str(tmp_path / "t"), ["k"], buckets=8), spark.createDataFrame([], SCHEMA)
    assert rows_of(bucketed.read(spark, table, SCHEMA)) == [] and bucketed.latest_version(spark, table) == 0
    for version in range(1, 4):
        batch = spark.createDataFrame([(k, f"v{version}", rng.randrange(9)) for k in rng.sample(range(60), 15)] + ([(None, "null", 1)] if version == 1 else []), SCHEMA)
        update = ["v"] if version == 2 else None
        whole = relations.upsert(whole, batch, ["k"], update)
        for _ in range(version):
            bucketed.merge(table, batch, update)
        assert sorted(map(str, rows_of_any(bucketed.read(spark, table, SCHEMA)))) == sorted(map(str, rows_of_any(whole)))
    assert bucketed.merge(table, batch.limit(0)) == bucketed.latest_version(spark, table) == 6


def rows_of_any(frame):
    return [tuple(r) for r in frame.collect()]


def test_files_written_are_in_proportion_to_the_change(spark, tmp_path):
    table = Bucketed(str(tmp_path / "t"), ["k"])
    bucketed.merge(table, spark.range(5000).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("w")))
    before = bucketed._places(spark, table)
    bucketed.merge(table, spark.createDataFrame([(7, "b", 2), (5001, "c", 3)], SCHEMA))
    after = bucketed._places(spark, table)
    touched = {r[0] for r in spark.createDataFrame([(7,), (5001,)], "k long").select(table.bucket()).collect()}
    assert len(before) == 64 and {b for b in after if after[b] != before[b]} == touched
    assert bucketed.read(spark, table, SCHEMA).count() == 5001 and bucketed.read(spark, table, SCHEMA, version=1).count() == 5000
    written = [d for d in os.listdir(tmp_path / "t/data") if len([b for b in os.listdir(tmp_path / "t/data" / d) if "__bucket=" in b]) < 64]
    assert len(written) == 1
    bucketed.merge(table, spark.createDataFrame([(7, "d", 2)], SCHEMA))
    assert bucketed.vacuum(spark, table, keep=1) == 1 + len(touched)
    assert rows_of(bucketed.read(spark, table, SCHEMA).where("k in (7, 5001)")) == [(7, "d", 2), (5001, "c", 3)] and bucketed.latest_version(spark, table) == 3


def test_a_change_that_breaks_off_is_not_seen(spark, tmp_path):
    table = Bucketed(str(tmp_path / "t"), ["k"], buckets=4)
    bucketed.merge(table, spark.createDataFrame([(k, "a", 1) for k in range(20)], SCHEMA))
    broken = F.when(F.col("k") == 3, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v"))
    with pytest.raises(Exception, match="lost"):
        bucketed.change(spark, table, spark.createDataFrame([(k, "b", 1) for k in range(20)], SCHEMA), lambda stored, new: new.withColumn("v", broken))
    assert {r["v"] for r in bucketed.read(spark, table, SCHEMA).collect()} == {"a"} and bucketed.latest_version(spark, table) == 1
    nothing = bucketed.change(spark, table, spark.createDataFrame([(k, "b", 1) for k in range(20)], SCHEMA), lambda stored, new: new.limit(0))
    assert nothing == 2 and bucketed.read(spark, table, SCHEMA).count() == 0
    bucketed.merge(table, spark.createDataFrame([(1, "again", 1)], SCHEMA))
    assert rows_of(bucketed.read(spark, table, SCHEMA)) == [(1, "again", 1)]
    with pytest.raises(ValueError):
        Bucketed("x", ["k"], ["v"])


def test_a_lost_checkpoint_loses_nothing(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "table")
    stream = lambda: increments.arrivals(spark, f"{source}/*", SCHEMA)
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA).write.parquet(f"{source}/one")
    increments.run_once(stream(), increments.merger(folder, ["k"]), str(tmp_path / "first"))
    os.rename(source / "one", tmp_path / "worked-off")
    spark.createDataFrame([(2, "B", 2), (3, "c", 2)], SCHEMA).write.parquet(f"{source}/two")
    for checkpoint in ("second", "second", "third"):
        increments.run_once(stream(), increments.merger(folder, ["k"]), str(tmp_path / checkpoint))
        assert rows_of(bucketed.read(spark, Bucketed(folder, ["k"]), SCHEMA)) == [(1, "a", 1), (2, "B", 2), (3, "c", 2)]


def test_keys_are_never_given_out_again(spark, tmp_path):
    """Over restarts, and long after a watermark would have passed them."""
    source, kind, got = tmp_path / "in", "k int, ts string, v string", []

    def run():
        del got[:]
        stream = increments.first_seen(increments.arrivals(spark, f"{source}/*", kind), ["k"], "ts")
        increments.run_once(stream, lambda batch, _: got.extend((r["k"], r["v"]) for r in batch.collect()), str(tmp_path / "cp"))
        return sorted(got, key=str)

    spark.createDataFrame([(1, "2024-01-01 02:00:00", "late"), (1, "2024-01-01 01:00:00", "b"), (1, "2024-01-01 01:00:00", "a"), (None, "2024-01-01 00:00:00", "n")], kind).write.parquet(f"{source}/one")
    assert run() == [(1, "a"), (None, "n")]
    spark.createDataFrame([(2, "2025-06-01 00:00:00", "new")], kind).write.parquet(f"{source}/two")
    assert run() == [(2, "new")]
    spark.createDataFrame([(1, "2026-01-01 00:00:00", "back"), (2, "2023-01-01 00:00:00", "old"), (3, "2026-01-01 00:00:00", "x"), (None, "2026-01-01 00:00:00", "n")], kind).write.parquet(f"{source}/three")
    assert run() == [(3, "x")]
    assert run() == []
