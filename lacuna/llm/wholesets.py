"""The whole shingle sets of chosen rows of a large table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import bloom
from lacuna.llm.common import map_in_arrow
from lacuna.llm.textvec import text_slices


def whole_sets(rows: DataFrame, wanted: DataFrame, cut: Callable[[pa.Array], list[np.ndarray]]) -> DataFrame:
    """rows: text_id, text; wanted: text_id, node, each node once; cut: sets of 64-bit hashes of texts -> node, size, shingles (bytes of the set), one row for each node.

    A filter of what is wanted keeps other texts from being cut into shingles; the join is exact.
    """
    spread = rows.sparkSession.sparkContext.broadcast(bloom.build(wanted.select(F.xxhash64("text_id").alias("hash")), "hash"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            chosen = pa.array(bloom.may_hold(spread.value, all_rows.column(2).to_numpy().view(np.uint64)))
            for batch in text_slices(iter([all_rows.filter(chosen)]), 1):
                own = cut(batch.column(1))
                columns = [pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["text_id", "size", "shingles"])

    cut_rows = map_in_arrow(rows.select("text_id", "text", F.xxhash64("text_id").alias("hash")), made, "text_id binary, size long, shingles binary")
    # Rows may repeat; they are told by what the join has dealt them out by, so the sets are not shuffled again.
    return cut_rows.join(wanted, "text_id").dropDuplicates(["text_id", "node"]).select("node", "size", "shingles")
