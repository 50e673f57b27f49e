"""What filters take from each other: a row for each part of a corpus, each order of the filters and each step.

Which filters a document fails is a number of five bits. A table of 32 by 120, made once, says for such a number and each order of the filters
at which step a document goes. Tasks look their documents up in it and count what each step of each order removes, in all and by label; the tasks'
arrays of counts are summed. All else follows from removals: what a filter fails in all is what it removes as the first one, what
it alone fails is what it removes as the last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import let, map_in_arrow, staged

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: A task adds up so many parts at a time.
PARTS_AT_ONCE = 1024
SPACE = r"[\x20\x09-\x0D]+"


def first_failures() -> np.ndarray:
    """For each set of failed filters (bits in the order of FILTERS) and each order: the step that removes, from 0; the number of filters, if none does."""
    table = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int64)
    for place, order in enumerate(ORDERS):
        for step in reversed(range(len(order))):
            bit = 1 << FILTERS.index(order[step])
            table[(np.arange(len(table)) & bit) > 0, place] = step
    return table


def _text_failures(text: Column) -> Column:
    """Bits of A to D: under 50 words; under 65 % of them distinct; over 5 % capitals; a special character."""
    words = F.array_remove(F.split(text, SPACE), "")
    few = let(words, lambda w: (F.size(w) < 50).cast("int") + 2 * (100 * F.size(F.array_distinct(w)) < 65 * F.size(w)).cast("int"))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return few + 4 * (100 * capitals.cast("long") > 5 * F.length(text).cast("long")).cast("int") + 8 * text.rlike("[#$%&*|]").cast("int")


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask (bits in the order of FILTERS), good, toxic: a row for each row of docs.

    Copies are told by the digest of the whole text. The first of them is looked for by digest and key, so a text that is a third of all rows is no hot key.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # The digest's bytes, not its letters: half the size.
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.select("key", "part", _text_failures(F.col("text")).cast("tinyint").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = staged(rows, "audit-rows")
    firsts = rows.where("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    marked = labels.groupBy(F.col("doc_id").alias("key")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("key").isNotNull() & F.col("first").isNull()
    none = F.lit(False)
    return (
        rows.join(firsts, ["digest", "key"], "left").join(marked, "key", "left")
        .select("part", (F.col("mask") + 16 * copy.cast("int")).cast("int").alias("mask"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    )


def _removals(counts: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """counts of documents by label (good 1, toxic 2) and mask -> all, good and toxic ones that each order removes at each step, and those it keeps."""
    masks = np.flatnonzero(counts.sum(axis=0))
    steps = table.max() + 1
    places = (np.arange(table.shape[1]) * steps + table[masks]).ravel()
    chosen = counts.sum(axis=0), counts[1] + counts[3], counts[2] + counts[3]
    return [np.bincount(places, weights=np.repeat(n[masks], table.shape[1]), minlength=table.shape[1] * steps).astype(np.int64) for n in chosen]


def removals(failed: DataFrame) -> DataFrame:
    """failures() -> part, cell (order * 6 + step, both from 0; the last step is what is kept), removed, good, toxic; zeros included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, parts = first_failures(), {}

        def summed() -> pa.RecordBatch:
            arrays = zip(*[_removals(n, table) for n in parts.values()], strict=True)
            columns = [pa.ListArray.from_arrays(np.arange(len(parts) + 1, dtype=np.int32) * len(column[0]), np.concatenate(column)) for column in arrays]
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), *columns], names=["part", "removed", "good", "toxic"])

        for batch in batches:
            named = batch.column(0).dictionary_encode()
            label = batch.column(2).to_numpy(zero_copy_only=False) + 2 * batch.column(3).to_numpy(zero_copy_only=False)
            cells = (named.indices.to_numpy().astype(np.int64) * 4 + label) * len(table) + batch.column(1).to_numpy()
            found = np.bincount(cells, minlength=len(named.dictionary) * 4 * len(table)).reshape(-1, 4, len(table))
            for name, n in zip(named.dictionary.to_pylist(), found, strict=True):
                if len(parts) >= PARTS_AT_ONCE and name not in parts:
                    yield summed()
                    parts.clear()
                parts[name] = parts.get(name, 0) + n
        if parts:
            yield summed()

    arrays = map_in_arrow(failed.select("part", "mask", "good", "toxic"), count, "part string, removed array<long>, good array<long>, toxic array<long>")
    cells = arrays.select("part", F.posexplode(F.arrays_zip("removed", "good", "toxic")).alias("cell", "n"))
    return cells.groupBy("part", "cell").agg(*[F.sum(f"n.{c}").alias(c) for c in ("removed", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step (from 1; its filter is that letter of the order), and of the part's documents: kept after the step, removed by it, redundant
    (they fail its filter, but are gone by then), unique_fails (they fail its filter alone), good_lost and toxic_lost (removed by it, with such a label)
    and shapley (what its filter removes, over all orders).

    A: under 50 words; B: under 65 % of the words are distinct; C: over 5 % of the code points are capitals A to Z; D: one of #$%&*| stands in it; E: a document with
    a smaller key has the same text. Words are runs of anything but ASCII white space, case-sensitive. A null text is empty, and equals other empty ones; a null
    part is the empty string. A null key has no smaller one, is smaller than none and has no label; of equal keys none is smaller. Repeated
    rows count each. labels may hold a key several times: one of its rows with 1 is enough. An empty table gives no rows; other columns play no part.
    """
    steps = len(FILTERS) + 1
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.col("cell") / steps).cast("int") + 1)
    rows = removals(failures(docs, labels, key, text, part)).select("part", order.alias("filter_order"), (F.col("cell") % steps + 1).cast("int").alias("step"), "removed", "good", "toxic")
    rows = rows.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    whole = Window.partitionBy("part", "filter_order")
    of_filter = Window.partitionBy("part", "letter")
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(of_filter)
    rows = rows.withColumn("kept", F.sum("removed").over(whole) - F.sum("removed").over(whole.orderBy("step"))).where(F.col("step") < steps)
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", (at(1) - F.col("removed")).alias("redundant"), at(len(FILTERS)).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(of_filter).alias("shapley"),
    )
