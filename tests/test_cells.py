"""The index of cells against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.functions import vectors
from lacuna.operators import cells


def test_index_gives_the_scan(spark, tmp_path):
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, f"n{i}", [x + rng.gauss(0, 0.05) for x in middles[i % 12]]) for i in range(600)]
    rows += [(1000, "far", [3.0 * x for x in rows[0][2]]), (1001, "zero", [0.0] * 8), (1002, "none", None)]
    table = spark.createDataFrame(rows, "id long, name string, embedding array<float>")
    folder = str(tmp_path / "index")
    assert cells.build(table, folder, cells=12) == 12
    for asked in (0, 7, 599):
        query = [float(x) for x in table.where(F.col("id") == asked).first()["embedding"]]
        point = vectors.unit(F.array(*map(F.lit, query)))
        scan = table.where("id < 1001").where(F.col("id") != asked).withColumn("d", vectors.cosine_distance(vectors.unit(F.col("embedding").cast("array<double>")), point)).orderBy("d", "id").limit(10)
        found = cells.nearest(spark, folder, table.schema, query, 10, without=asked, probes=1)
        assert [(r["id"], round(r["distance"], 9)) for r in found.rows.collect()] == [(r["id"], round(r["d"], 9)) for r in scan.collect()]
        assert found.cells == 12 and found.cells_read < 12
        assert found.rows.columns == ["id", "name", "embedding", "distance"]
    everything = cells.nearest(spark, folder, table.schema, query, 5000)
    assert everything.rows.count() == 601 and everything.cells_read == 12
    with pytest.raises(ValueError):
        cells.nearest(spark, folder, table.schema, [0.0] * 8)


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    assert cells.build(none, str(tmp_path / "index")) == 0
    assert cells.nearest(spark, str(tmp_path / "index"), none.schema, [1.0, 0.0]).rows.count() == 0
