"""Running values of rows in order, however large a group of them is.

Rows are dealt to tasks by ranges of their order, so a group may lie in many tasks. A task works out what it can from its own rows; a row for each task
says what its last group has come to, and from these, taken in order, follows what the first group of each task begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import map_in_arrow, staged

#: Of a running value: what it begins with, and how a task's own value goes on from what came before (null: nothing).
_FOLDS = {
    "first": (None, lambda a, b: F.coalesce(b, a)),
    "sum": (0, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "xor": (0, lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0)))),
    "last": (None, lambda a, b: F.coalesce(a, b)),
}


class _Task:
    """The running values of one task's rows, batch after batch."""

    def __init__(self, segment: list[int], folds: list[tuple[str, int]]):
        self.segment, self.folds = segment, folds
        self.last, self.groups, self.values = None, 0, [_FOLDS[kind][0] for kind, _ in folds]

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        """Which rows begin a group, and the running values; the batch has rows."""
        keys = np.stack([batch.column(i).to_numpy() for i in self.segment])
        begins = np.concatenate([[self.last is None or (keys[:, 0] != self.last).any()], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        group = np.cumsum(begins)
        starts = np.flatnonzero(begins)
        out = []
        for k, (kind, place) in enumerate(self.folds):
            carried, column = self.values[k], batch.column(place)
            if kind in ("first", "last"):
                rows = np.arange(len(group))
                begun = np.concatenate([[0], starts])[group]
                at = begun if kind == "first" else np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), rows, -1))
                # Rows of a group that went on from the batch before, where it has the value.
                before = (group == 0) if kind == "first" else (at < begun) & (group == 0)
                own = column.take(pa.array(np.where(at >= begun, at, 0)))
                values = pc.if_else(pa.array(at >= begun), own, pa.scalar(None, pa.int64()))
                values = pc.if_else(pa.array(before), pa.scalar(carried, pa.int64()), values)
                self.values[k] = values[-1].as_py()
            else:
                x = column.to_numpy().view(np.uint64)
                own = np.array([carried % 2**64], np.uint64)
                if kind == "sum":
                    sums = np.cumsum(x, dtype=np.uint64)
                    sums = sums - np.concatenate([np.uint64(0) - own, sums[starts] - x[starts]])[group]
                else:
                    sums = np.bitwise_xor.accumulate(x)
                    sums = sums ^ np.concatenate([own, sums[starts] ^ x[starts]])[group]
                values = pa.array(sums.view(np.int64))
                self.values[k] = int(sums[-1])
            out.append(values)
        self.last = keys[:, -1]
        self.first = pa.array(self.groups + group == 1)
        self.groups += int(group[-1])
        return begins, out


def running(rows: DataFrame, segment: list[str], order: list[str], folds: dict[str, tuple[str, str]], name: str, ends: str = "is_end", alone: bool = True) -> DataFrame:
    """rows with the running values of folds within each segment, in that order, and with whether a row is the last of its segment.

    segment: columns of longs without nulls. folds: name -> (sum, xor, first or last, a column of longs); all but last take no nulls, sums wrap, last is the
    latest value that is not null. alone: whether rows that are the only one of their segment are wanted; those at a task's edges come in any case. Rows that are alike in segment and order should be alike in all, else their order is open. rows are read twice
    (ranges are found from a sample), so they should be a table. The driver gets a row for each task.
    """
    names = rows.columns
    places = [names.index(c) for c in segment], [(kind, names.index(c)) for kind, c in folds.values()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, at, held = _Task(*places), TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins, values = task.of(batch)
            if held is not None:
                yield finished(held, bool(begins[0]))
            final = np.concatenate([begins[1:], [True]])
            numbers = pa.array(np.arange(at, at + len(final)))
            held = [*batch.columns, *values, pa.array(np.full(len(final), part, np.int32)), numbers, task.first], final, begins
            at += len(final)
        if held is not None:
            yield finished(held, None)

    def finished(held: tuple[list[pa.Array], np.ndarray, np.ndarray], ended: bool | None) -> pa.RecordBatch:
        columns, final, begins = held
        final[-1] = ended is not False
        out = pa.RecordBatch.from_arrays([*columns, pa.array(final)], names=[*names, *folds, "__part", "__at", "__first", ends])
        if alone:
            return out
        several = ~(final & begins) | columns[-1].to_numpy(zero_copy_only=False)
        several[-1] |= ended is None
        return out.filter(pa.array(several))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} long" for c in folds), "__part int, __at long, __first boolean", f"{ends} boolean"])
    ordered = rows.repartitionByRange(*segment, *order).sortWithinPartitions(*segment, *order)
    done = staged(map_in_arrow(ordered, work, schema), name)

    keys = F.struct(*segment)
    tasks = done.groupBy("__part").agg(F.min_by(keys, "__at").alias("begin"), F.max_by(keys, "__at").alias("end"), F.max_by(F.struct("__first", *folds), "__at").alias("tail"), F.max("__at").alias("at"))
    carried, key, value, before = [], None, None, None
    for task in sorted(tasks.collect()):
        part, begin, end, tail, at = task
        goes_on = key == begin
        if before is not None:
            carried.append((*before, goes_on))
        start = value if goes_on else [None] * len(folds)
        before = (part, at, *start)
        value = list(tail[1:])
        if tail[0] and goes_on:
            value = [_join(kind, a, b) for (kind, _), a, b in zip(folds.values(), start, value, strict=True)]
        key = end
    if before is not None:
        carried.append((*before, False))
    schema = ", ".join(["__part int, __end long", *(f"__{c} long" for c in folds), "__open boolean"])
    # As many rows as there were tasks.
    starts = F.broadcast(rows.sparkSession.createDataFrame(carried, schema))

    def whole(c: str, kind: str) -> Column:
        return F.when(F.col("__first"), _FOLDS[kind][1](F.col(c), F.col(f"__{c}"))).otherwise(F.col(c)).alias(c)

    closed = (F.col(ends) & ~(F.col("__open") & (F.col("__at") == F.col("__end")))).alias(ends)
    return done.join(starts, "__part").select(*names, *[whole(c, kind) for c, (kind, _) in folds.items()], closed)


def _join(kind: str, a: int | None, b: int | None) -> int | None:
    """a, then b, as longs; the sum wraps."""
    if kind == "first":
        return a if a is not None else b
    if kind == "last":
        return b if b is not None else a
    found = (a + b if kind == "sum" else a ^ b) % 2**64
    return found - 2**64 if found >= 2**63 else found
