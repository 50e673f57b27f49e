"""Words of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; a longer text is cut between words.
BYTES_AT_ONCE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SPACE = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n bytes at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _tables[size]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] (bytes) for each run; the same bytes hash alike wherever they stand."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case; everything but letters, marks and digits becomes one space. Null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}\p{N}]+", " ")


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], data != _SPACE, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, and where each text begins and ends in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


def pieces(data: np.ndarray, offsets: np.ndarray, separator: int = _SPACE) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, begin, end): runs of whole texts of BYTES_AT_ONCE at most, or parts of one text that end at a separator."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BYTES_AT_ONCE, "right")) - 1)
        begin, end = int(offsets[i]), int(offsets[j])
        while end - begin > BYTES_AT_ONCE:
            cut = begin + BYTES_AT_ONCE
            found = np.flatnonzero(data[begin:cut] == separator)
            cut = begin + int(found[-1]) + 1 if len(found) else end
            yield i, j, begin, cut
            begin = cut
        yield i, j, begin, end
        i = j


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of normalised texts, one text after the other, and the word at which each text begins (n + 1 places)."""
    data, offsets = bytes_of(texts)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, j, begin, end in pieces(data, offsets):
        part = data[begin:end]
        if j - i > 1:
            # Texts that touch must not share a word: a space goes between them.
            at = offsets[i + 1 : j] - begin
            part = np.insert(part, at, _SPACE)
            bounds = np.concatenate([[0], at + np.arange(1, len(at) + 1), [len(part)]])
        else:
            bounds = np.array([0, len(part)])
        starts, ends = _runs(part)
        hashes.append(hash_runs(part, starts, ends))
        counts[i:j] += np.diff(np.searchsorted(starts, bounds))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words; fewer words give none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x100000001B3)
        out += words[k : n + k]
    return mix(out)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of width words; of fewer words, one of all; of none, none."""
    if 0 < len(words) < width:
        return window_hashes(words, len(words))
    return np.unique(window_hashes(words, width))


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 0, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of limit bytes of text at most, or of one row, to bound what is worked on at once."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
