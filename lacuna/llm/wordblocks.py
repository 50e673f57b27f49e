"""Work done once per distinct pre-token and brought back to the documents by position.

Rows for each occurrence of each word would be many times the size of the text, and frequent words
would be hot keys. So each task numbers the distinct pre-tokens of a block of documents and keeps
the documents as sequences of those numbers. A block sends each of its words once, whatever its
frequency, to the bucket that its hash names; there every distinct word is resolved once for all
blocks. The answers go back to the block, whose number sequences turn into answers by position.

Both shuffles carry packed rows: one for each block and bucket, and one for each block. Packing is for the disk: a plain row for each
position, or for each word of a block, would be many times the text, and the shuffles must stay within 1.5 times the input.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import map_in_arrow, release

#: Characters after which a block ends. A block is what one task holds at a time; a longer text is a block of its own.
BLOCK_CHARS = 12_000_000
PIECES_AT_ONCE = 200_000

#: Blocks after which there is one bucket more, so that a bucket does not grow with the corpus alone.
BLOCKS_A_BUCKET = 32
#: Blocks after which words that begin alike are spread over one bucket more.
BLOCKS_A_SPREAD = 1024

PACKED = "bucket long, block long, docs binary, numbers binary, words binary"


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32: a byte each, and for those of 255 or more what is left over, as four planes of bytes."""
    low = np.minimum(numbers, 255).astype(np.uint8)
    rest = (numbers[low == 255] - 255).astype("<u4")
    planes = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 4).T)
    packed = zstandard.compress(low.tobytes(), 9)
    return np.array([len(packed)], "<u8").tobytes() + packed + zstandard.compress(planes.tobytes(), 9)


def _expand(packed: bytes) -> np.ndarray:
    end = 8 + int(np.frombuffer(packed, "<u8", 1)[0])
    low = np.frombuffer(zstandard.decompress(packed[8:end]), np.uint8)
    planes = np.frombuffer(zstandard.decompress(packed[end:]), np.uint8).reshape(4, -1)
    numbers = low.astype(np.uint32)
    numbers[low == 255] += np.ascontiguousarray(planes.T).reshape(-1).view("<u4")
    return numbers


def pack_numbers(*arrays: np.ndarray) -> bytes:
    packed = [_squeeze(a) for a in arrays]
    return np.array([len(packed), *map(len, packed)], "<u8").tobytes() + b"".join(packed)


def unpack_numbers(packed: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(packed, "<u8", 1)[0])
    ends = 8 + 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(packed, "<u8", n, 8))]).astype(int)
    return [_expand(packed[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack_numbers(np.fromiter(map(len, words), np.uint32, len(words)))
    return np.array([len(lengths)], "<u8").tobytes() + lengths + zstandard.compress(b"".join(words), 9)


def unpack_words(packed: bytes) -> pa.Array:
    end = 8 + int(np.frombuffer(packed, "<u8", 1)[0])
    (lengths,) = unpack_numbers(packed[8:end])
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(packed[end:]))])


def pack_lists(values: pa.ListArray) -> bytes:
    """A ListArray of int32 of 0 or more, without nulls."""
    return pack_numbers(np.diff(values.offsets.to_numpy()), values.flatten().to_numpy())


def to_ipc(data: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(data)
    return sink.getvalue().to_pybytes()


def _block_rows(block: int, docs: list[pa.RecordBatch], counts: list[int], words: dict, numbers: array, buckets: int, key_bytes: int | None, spread: int = 1) -> pa.Table:
    encoded = [w.encode() for w in words]
    used = np.frombuffer(numbers, np.uint32) if numbers else np.zeros(0, np.uint32)
    # The most frequent words get the smallest numbers, which take the least room.
    by_use = np.argsort(-np.bincount(used, minlength=len(encoded)), kind="stable")
    number = np.empty(len(by_use), np.uint32)
    number[by_use] = np.arange(len(by_use), dtype=np.uint32)
    home = np.fromiter(((zlib.crc32(encoded[i][:key_bytes]) + (zlib.crc32(encoded[i]) % spread if spread > 1 else 0)) % buckets for i in by_use), np.int64, len(by_use))
    kept = pa.Table.from_batches(docs).append_column("__n", pa.array(counts, pa.int64()))
    # A block's documents are a group of their own, apart from all buckets of words.
    rows = [(-1 - block, block, to_ipc(kept), pack_numbers(home, number[used]), None)]
    order = np.argsort(home, kind="stable")
    names, starts = np.unique(home[order], return_index=True)
    for name, start, end in zip(names, starts, np.append(starts, len(order))[1:], strict=True):
        rows.append((int(name), block, None, None, pack_words([encoded[i] for i in by_use[order[start:end]]])))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "docs", "numbers", "words"])


def pack_blocks(docs: DataFrame, text: str, keep: list[str], pattern: str, buckets: int, key_bytes: int | None, block_chars: int, spread: int = 1) -> DataFrame:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        block = TaskContext.get().partitionId() << 32
        words, numbers, held, counts, chars = Numbering(), array("I"), [], [], 0
        for batch in batches:
            kept, begin = batch.select(range(1, batch.num_columns)), 0
            for row, value in enumerate(batch.column(0)):
                before = len(numbers)
                if (string := value.as_py()) is not None:
                    if len(string) <= PIECES_AT_ONCE:
                        numbers.extend(map(words.__getitem__, compiled.findall(string)))
                    else:
                        found = compiled.finditer(string)
                        while pieces := [m.group() for m in islice(found, PIECES_AT_ONCE)]:
                            numbers.extend(map(words.__getitem__, pieces))
                    chars += len(string)
                counts.append(len(numbers) - before)
                if chars >= block_chars:
                    held.append(kept.slice(begin, row + 1 - begin))
                    yield from _block_rows(block, held, counts, words, numbers, buckets, key_bytes, spread).to_batches()
                    block, begin = block + 1, row + 1
                    words, numbers, held, counts, chars = Numbering(), array("I"), [], [], 0
            if begin < batch.num_rows:
                held.append(kept.slice(begin))
        if counts:
            yield from _block_rows(block, held, counts, words, numbers, buckets, key_bytes, spread).to_batches()

    return map_in_arrow(docs.select(F.col(text).cast("string").alias("__text"), *[F.col(c) for c in keep]), blocks, PACKED)


def per_distinct_word(
    docs: DataFrame,
    text: str,
    keep: list[str],
    pattern: str,
    resolve: Callable[[pa.Array], pa.Array],
    assemble: Callable[[pa.ListArray, np.ndarray, np.ndarray], pa.Array],
    out: str,
    out_type: T.DataType,
    key_bytes: int | None = None,
    buckets: int | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The columns keep of docs, and out, made from the pre-tokens of text.

    resolve: distinct words (binary) -> a list of int32 for each; called with every distinct word of a bucket once.
    assemble: (the lists of the block's words, the word number at each position, where each document begins) -> a value per document.
    key_bytes: words that begin with the same so many bytes meet in one bucket, or in a few of a large corpus; all bytes if None.
    Null texts count as empty; repeated rows each give a row; no rows give no rows.
    """
    spread = 1
    if not buckets:
        chars = docs.agg(F.sum(F.length(F.col(text).cast("string")))).first()[0] or 0
        # Words that begin alike are told apart, too, once there are so many blocks that a beginning's share of them is large.
        spread = max(1, chars // block_chars // BLOCKS_A_SPREAD) if key_bytes else 1
        buckets = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // block_chars // BLOCKS_A_BUCKET)
    packed = pack_blocks(docs, text, keep, pattern, buckets, key_bytes, block_chars, spread)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, out_type)])

    def resolved(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        columns = {c: group.column(c).to_pylist() for c in ("words", "docs", "numbers")}
        at = [i for i, w in enumerate(columns["words"]) if w is not None]
        answers: list[bytes | None] = [None] * group.num_rows
        if at:
            per_row = [unpack_words(columns["words"][i]) for i in at]
            distinct = pa.chunked_array(per_row).combine_chunks().dictionary_encode()
            lists = resolve(distinct.dictionary)
            begin = 0
            for i, w in zip(at, per_row, strict=True):
                answers[i] = pack_lists(lists.take(distinct.indices.slice(begin, len(w))))
                begin += len(w)
        return pa.Table.from_arrays([group.column("bucket"), group.column("block"), group.column("docs"), group.column("numbers"), pa.chunked_array([pa.array(answers, pa.binary())])], names=["bucket", "block", "docs", "numbers", "words"])

    def assembled(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")
        answers = [unpack_numbers(x) for x in group.column("words").to_pylist() if x is not None]
        lengths = np.concatenate([x[0] for x in answers]) if answers else np.zeros(0, np.uint32)
        values = np.concatenate([x[1] for x in answers]).astype(np.int32) if answers else np.zeros(0, np.int32)
        offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        at = next(i for i, x in enumerate(group.column("docs").to_pylist()) if x is not None)
        docs_ = pa.ipc.open_stream(group.column("docs")[at].as_py()).read_all()
        home, used = unpack_numbers(group.column("numbers")[at].as_py())
        # The answers came in order of bucket, and within a bucket in order of number.
        place = np.empty(len(home), np.uint32)
        place[np.argsort(home, kind="stable")] = np.arange(len(home), dtype=np.uint32)
        numbers = place[used]
        begins = np.concatenate([[0], np.cumsum(docs_.column("__n").to_numpy())]).astype(np.int64)
        made = docs_.drop_columns(["__n"]).append_column(out, assemble(lists, numbers, begins))
        release()
        return made

    return packed.groupBy("bucket").applyInArrow(resolved, PACKED).groupBy("block").applyInArrow(assembled, schema)
