"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

Documents with the same shingles are one node. Bands of a node's signature are buckets; a bucket's members are told by running values of all rows in order, so a
band that a third of all documents share is no group of any task. What shares a band is verified on whole sets, by stars (stars.py), and united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import map_in_arrow, row_id, scratch, staged
from lacuna.llm.ordered import running
from lacuna.llm.stars import united
from lacuna.llm.superminhash import bands, signatures
from lacuna.llm.textvec import bytes_of, mix, shingles, text_slices, word_hashes
from lacuna.llm.wholesets import whole_sets


@dataclass(frozen=True)
class Banding:
    width: int = 2
    threshold: float = 0.8
    #: A pair just at the threshold shares no band with a chance of (1 - 0.8 ** rows) ** bands, here 5 in a million.
    bands: int = 40
    rows: int = 6


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[9:14] = 32
_PLAIN[65:91] += 32


def plain(texts: pa.Array) -> pa.Array:
    """A to Z in lower case, ASCII white space as spaces; all else as it is. Null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    data, offsets = bytes_of(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_PLAIN[data]))


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    words, begins = word_hashes(plain(texts))
    return [shingles(words[a:b], width) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _signed(rows: DataFrame, banding: Banding) -> DataFrame:
    """key, text, text_id -> key, text_id, size, content (16 bytes that stand for the set), bands (a long for each)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            sets = _sets(batch.column(1), banding.width)
            full = [k for k, s in enumerate(sets) if len(s)]
            made = bands(signatures([sets[k] for k in full], banding.bands * banding.rows), banding.rows).view(np.int64) if full else []
            contents, found = [None] * len(sets), [None] * len(sets)
            for k, row in zip(full, made, strict=True):
                contents[k] = np.array([sets[k].sum(), mix(sets[k] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).tobytes()
                found[k] = row
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(contents, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["key", "text_id", "size", "content", "bands"])

    kind = rows.schema["key"].dataType.simpleString()
    return map_in_arrow(rows.select("key", "text", "text_id"), sign, f"key {kind}, text_id binary, size long, content binary, bands array<long>")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", banding: Banding = Banding()) -> DataFrame:
    """key, n_shingles (distinct shingles of the text), component_id (the smallest key of the documents linked to it over any number of links, its own included)
    and kept (whether the key is that one): a row for each row of docs.

    Words are runs of anything but ASCII white space, with A to Z in lower case; a text of fewer words than a shingle is one shingle. A text without words, empty or
    null, has none and is linked to nothing. Repeated rows are copies of each other. A null key is the smallest only of nulls. Other columns
    play no part; an empty table gives no rows.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), content.alias("text"), row_id(F.col(key), content).alias("text_id"))
    signed = staged(_signed(rows, banding), "neardup-signed", keep=True)
    with scratch(docs.sparkSession):
        nodes = signed.where("size > 0").groupBy("content").agg(F.min("key").alias("key"), F.min("text_id").alias("text_id"), F.first("bands").alias("bands"))
        nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "content", "key", "text_id", "bands"), "neardup-nodes")
        in_bands = nodes.select(F.explode("bands").alias("bucket"), "node")
        met = running(in_bands, ["bucket"], ["node"], {"head": ("first", "node")}, "neardup-bands", alone=False)
        met = staged(met.where("NOT (head = node AND is_end)").select("bucket", "node", "head"), "neardup-met")
        wanted = staged(met.select("node").distinct().join(nodes.select("node", "text_id"), "node"), "neardup-wanted")
        sets = staged(whole_sets(rows, wanted, lambda texts: _sets(texts, banding.width)), "neardup-sets")
        classes, _ = united(met, sets, banding.threshold)
        described = nodes.select("node", "content", "key").join(classes, "node", "left").select("content", "key", F.coalesce("component", "node").alias("component"))
        described = staged(described, "neardup-described")
        least = staged(described.groupBy("component").agg(F.min("key").alias("component_id")), "neardup-least")
        answers = staged(described.join(least, "component").select("content", "component_id"), "neardup-answers", keep=True)
    found = signed.where("size > 0").join(answers, "content").select("key", "size", "component_id")
    found = found.unionByName(signed.where("size = 0").select("key", "size", F.col("key").alias("component_id")))
    return found.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
