"""A Bloom filter of fixed size: it tells which rows of a large table can have no partner in a join, before they are shuffled.

Its size does not depend on the data; a filter that is too full lets more rows through, and the join stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import map_in_arrow
from lacuna.llm.textvec import mix

BITS = 1 << 25


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    return [(h & np.uint64(BITS - 1)).astype(np.int64) for h in (hashes, mix(hashes))]


def build(rows: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of 64-bit hashes, as words of 64 bits. Tasks set bits, and their words are or-ed by place: BITS / 64 rows at most."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS >> 6, np.uint64)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        used = np.flatnonzero(bits)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bits[used].view(np.int64))], names=["place", "bits"])

    found = map_in_arrow(rows.select(F.col(column).cast("long")).where(F.col(column).isNotNull()), words, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for place in _places(hashes):
        out &= (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out
