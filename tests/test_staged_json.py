"""Stages' outputs: whole runs or none."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lacuna.operators import runs
from lacuna.sources import staged_json

SCHEMA = "inspire_id long, year int, title string, parts array<struct<b:int,a:string>>, status string"


def papers(spark, n, title="ü"):
    return spark.range(n).select(F.col("id").alias("inspire_id"), (2020 + F.col("id") % 3).cast("int").alias("year"), F.lit(title).alias("title"), F.array(F.struct(F.lit(1).alias("b"), F.lit(None).cast("string").alias("a"))).alias("parts"), F.lit("ok").alias("status"))


def test_lines_by_year_and_key(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = papers(spark, 30).repartition(5)
    staged_json.write(rows, path, "inspire_id", F.col("year"), {"papers": 30})
    run = staged_json.current(path)
    assert run["summary"] == {"papers": 30} and run["rows"] == {"2020": 10, "2021": 10, "2022": 10}
    assert sorted(map(str, staged_json.read(spark, path, SCHEMA).collect())) == sorted(map(str, rows.collect()))
    assert {r["year"] for r in staged_json.read(spark, path, SCHEMA, ["2021"]).collect()} == {2021}
    written = [json.loads(line) for f in run["files"] for line in (tmp_path / "out" / f).read_text(encoding="utf-8").splitlines()]
    assert [(w["year"], w["inspire_id"]) for w in written] == sorted((2020 + i % 3, i) for i in range(30))
    first = (tmp_path / "out" / run["files"][0]).read_text(encoding="utf-8").splitlines()[0]
    assert first == '{"inspire_id":0,"parts":[{"a":null,"b":1}],"status":"ok","title":"ü","year":2020}'


def test_a_run_that_breaks_off_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "out")
    staged_json.write(papers(spark, 6, "first"), path, "inspire_id", F.col("year"), {"n": 1})
    # Ranges put the rows that fail into the last task, when others have written theirs.
    broken = papers(spark, 400, "second").withColumn("title", F.when(F.col("inspire_id") == 398, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        staged_json.write(broken, path, "inspire_id", F.col("year"), {"n": 2})
    assert {r["title"] for r in staged_json.read(spark, path, SCHEMA).collect()} == {"first"} and staged_json.current(path)["summary"] == {"n": 1}
    with pytest.raises(Exception, match="no inspire_id"):
        staged_json.write(papers(spark, 3).withColumn("inspire_id", F.lit(None).cast("long")), path, "inspire_id", F.col("year"))
    os.makedirs(tmp_path / "out/run-orphan/slice=2020")
    staged_json.write(papers(spark, 2, "third"), path, "inspire_id", F.col("year"))
    assert {r["title"] for r in staged_json.read(spark, path, SCHEMA).collect()} == {"third"}
    assert staged_json.remove_others(path) >= 2 and staged_json.read(spark, path, SCHEMA).count() == 2


def test_tasks_that_fail_take_their_files_away():
    writer = staged_json.Writer({"path": "/nowhere/at/all", "run": "x"})
    writer.abort([None])


def test_a_stage_can_read_what_it_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    runs.write_stage(papers(spark, 4), runs.summary(papers(spark, 4).withColumn("reduction_ratio", F.lit(5.0))), path, "inspire_id", F.col("year"))
    again = staged_json.read(spark, path, SCHEMA).withColumn("title", F.lit("new"))
    runs.write_stage(again, runs.summary(again.withColumn("reduction_ratio", F.lit(6.0))), path, "inspire_id", F.col("year"))
    assert {r["title"] for r in staged_json.read(spark, path, SCHEMA).collect()} == {"new"}
    assert staged_json.current(path)["summary"]["reduction_ratio_min"] == 6.0 and staged_json.current(path)["summary"]["statuses"] == {"ok": 4}


def test_nothing_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        staged_json.read(spark, str(tmp_path / "none"), SCHEMA)
    staged_json.write(papers(spark, 0), str(tmp_path / "empty"), "inspire_id", F.col("year"), {"papers": 0})
    assert staged_json.read(spark, str(tmp_path / "empty"), SCHEMA).count() == 0
