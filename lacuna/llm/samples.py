"""Bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sample is first cut to so many times its size, by hash.
SLACK = 3


def hash_sample(rows: DataFrame, order: Column, limit: int) -> DataFrame:
    """The limit rows of rows that are least by order, a 64-bit hash; all, if there are fewer.

    A count tells below which hash about SLACK times as many rows lie, so of a large table no task hands the limit's worth of rows
    to the last one. If a few keys that repeat leave less than the limit there, the sample is that much smaller.
    """
    total = rows.count()
    if total > SLACK * limit:
        rows = rows.where(order < F.lit(int(-(2**63) + 2**64 * SLACK * limit / total)))
    return rows.orderBy(order).limit(limit)
