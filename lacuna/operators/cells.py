"""Nearest vectors by an index of cells, exact.

Vectors are put on the unit sphere, where the nearest by cosine are the nearest by distance, and dealt to cells around centres that k-means finds; a cell is a partition of
the stored table. A search reads cells in order of how near a member can be at all (the distance to the centre less the cell's radius), more of them each time, and stops
when no cell that is left can hold anything nearer than what it has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions import vectors
from lacuna.staging import staged

#: Cells at most; their centres go to the driver.
MOST_CELLS = 1024
#: Rows that centres are fitted on, about.
FITTED = 100_000
#: Room for the rounding of distances.
SLACK = 1e-6


@dataclass(frozen=True)
class Found:
    """The nearest rows, and how much was read for them."""

    rows: DataFrame
    cells_read: int
    cells: int


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def build(rows: DataFrame, folder: str, key: str = "id", vector: str = "embedding", cells: int | None = None, seed: int = 1) -> int:
    """Write the index of rows (all their columns) below folder. Rows whose vector is null, or nothing but zeros, are at no angle to others and are left out; vectors have one length.
    cells: about the square root of the rows, if none. Centres are fitted on a bounded sample; every row is in the index. Gives the number of cells."""
    usable = rows.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).withColumn("__unit", vectors.unit(F.col(vector).cast("array<double>")))
    usable = staged(usable, "cells-rows")
    total = usable.count()
    wanted = max(1, min(MOST_CELLS, cells or math.isqrt(total)))
    sample = usable if total <= FITTED else usable.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(-(-total // FITTED))) == 0)
    pointed = array_to_vector(F.col("__unit")).alias("features")
    if total:
        model = KMeans(k=wanted, seed=seed, maxIter=10).fit(sample.select(pointed))
        centres = [c.tolist() for c in model.clusterCenters()]
        placed = model.transform(usable.withColumn("features", pointed)).drop("features").withColumnRenamed("prediction", "cell")
    else:
        centres, placed = [], usable.withColumn("cell", F.lit(0))
    spark = rows.sparkSession
    middle = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    # A cell may be a third of all rows: it is cut into several files.
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/rows")
    held = spark.read.schema(placed.schema).parquet(f"{folder}/rows") if total else placed
    radii = held.join(F.broadcast(middle), "cell").groupBy("cell").agg(F.max(_distance(F.col("__unit"), F.col("centre"))).alias("radius"), F.count("*").alias("n"))
    middle.join(radii, "cell").coalesce(1).write.parquet(f"{folder}/cells")
    return len(centres)


def nearest(spark: SparkSession, folder: str, schema, query: list[float], k: int = 10, key: str = "id", without=None, probes: int = 4) -> Found:
    """The k rows of the index nearest to query by cosine, ties by key, as build() was given them and with distance; without: a key that is not wanted.

    schema: of the rows that were given. probes: cells read at first; twice as many each time. The answer is the scan's.
    """
    size = math.sqrt(sum(x * x for x in query))
    if not size:
        raise ValueError("a vector of zeros is at no angle to others")
    point = F.array(*[F.lit(float(x) / size) for x in query])
    known = spark.read.schema("cell int, centre array<double>, radius double, n long").parquet(f"{folder}/cells")
    # MOST_CELLS numbers at most.
    bounds = sorted((r["low"], r["cell"]) for r in known.select("cell", (_distance(F.col("centre"), point) - F.col("radius")).alias("low")).collect())
    given = schema.fields if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema).fields
    rows = spark.read.schema(T.StructType([*given, T.StructField("__unit", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])).parquet(f"{folder}/rows")
    if without is not None:
        rows = rows.where(F.col(key) != F.lit(without))
    names = [c for c in rows.columns if c not in ("__unit", "cell")]
    read = 0
    while True:
        read = min(len(bounds), read + max(1, probes))
        probes *= 2
        chosen = [c for _, c in bounds[:read]]
        near = rows.where(F.col("cell").isin(*chosen)) if chosen else rows.where("false")
        dot = F.aggregate(F.zip_with("__unit", point, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        best = near.withColumn("distance", 1 - dot).orderBy("distance", key).limit(k).select(*names, "distance")
        best = staged(best, "cells-nearest")
        worst = best.agg(F.max("distance"), F.count("*")).first()
        # Of unit vectors the distance is the root of twice the cosine distance.
        done = worst[1] == k and read < len(bounds) and bounds[read][0] > math.sqrt(max(0.0, 2 * worst[0])) + SLACK
        if done or read == len(bounds):
            return Found(best.orderBy("distance", key), read, len(bounds))
