"""Byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import map_in_arrow
from lacuna.llm.wordblocks import BLOCK_CHARS, per_distinct_word

IDS_AT_ONCE = 2_000_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


@lru_cache(maxsize=2)
def _single_piece_encoder(raw: bytes):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(raw), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(raw: bytes) -> pa.Array:
    ranks = read_ranks(raw)
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns keep, and the token ids (array<int>) of the whole text.

    Each match of pattern is encoded by itself, without special tokens. Every distinct match is encoded
    once, in the bucket of its hash, and its ids return to the documents by position. The rank file is read by
    the driver and broadcast: its size is that of a vocabulary, whatever the corpus.

    A null or empty text has no ids; repeated rows each give a row; an empty table gives none.
    """
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def resolve(words: pa.Array) -> pa.Array:
        encoder = _single_piece_encoder(ranks.value)
        return pa.array([encoder.encode_ordinary(w.decode()) for w in words.to_pylist()], pa.list_(pa.int32()))

    def assemble(lists: pa.ListArray, numbers: np.ndarray, begins: np.ndarray) -> pa.Array:
        taken = lists.take(pa.array(numbers))
        return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[begins]), taken.flatten())

    return per_distinct_word(docs, text, list(keep), pattern, resolve, assemble, out, T.ArrayType(T.IntegerType()), block_chars=block_chars)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for, by a join with the token-byte table.

    The table has a row for each id of the vocabulary, so it is broadcast, and joined by its dense key. Null ids
    decode to null, an empty array to no bytes; an id outside the vocabulary raises.
    """
    with open(ranks_path, "rb") as file:
        ranks = encoded.sparkSession.sparkContext.broadcast(file.read())
    at = encoded.columns.index(ids)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(ranks.value)
        for batch in batches:
            offsets = batch.column(at).offsets.to_numpy()
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + IDS_AT_ONCE, "right")) - 1)
                part = batch.slice(begin, end - begin)
                own = part.column(at)
                taken = tokens.take(own.values.slice(offsets[begin], offsets[end] - offsets[begin]))
                ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
                if taken.null_count:
                    raise ValueError("an id is not in the vocabulary")
                starts = ends[offsets[begin : end + 1] - offsets[begin]]
                data = pa.py_buffer(memoryview(taken.buffers()[2] or b"")[starts[0] : starts[-1]])
                made = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(np.ascontiguousarray(starts - starts[0])), data]).cast(pa.binary())
                if own.null_count:
                    made = pa.compute.if_else(own.is_valid(), made, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])
                begin = end

    return map_in_arrow(encoded, joined, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
