"""Containment and shared passages by hashes of windows, joined as keys.

A window's hash comes from prefix sums of powers, so that all windows of a text cost its length. Quotes are told by the hash of their beginning, in classes of length; texts send the
hashes of their windows that some quote may have, and what joins is looked at exactly. Two texts that share a passage share one of the
hashes that winnowing keeps of each. The numbers of quotes and of texts may be any: nothing of them goes to the driver but a filter of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.staging import staged

#: Quotes' beginnings have a power of two of bytes, so many at most.
WIDEST = 64
#: Bytes of a text that are worked on at once.
PIECE = 1 << 20
#: Bits of the filter for each beginning, of all at least and at most, and how many of them one beginning sets.
FILTER_BITS, LEAST_BITS, MOST_BITS, PROBES = 32, 1 << 16, 1 << 27, 8

_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers[size] = tuple(made)
    return _powers[size]


class Windows:
    """Hashes of all windows of a sequence of symbols, for any width."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _tables(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(_mixed(symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=self.sums[1:])

    def of(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        # The width goes into the hash, so that one filter serves all of them.
        return _mixed((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width * _BASE % 2**64))


def _kept(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes that the filter may hold."""
    own = hashes
    for probe in range(PROBES):
        at = _places(own, probe, len(bits) * 64)
        own = own[(bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
        if not len(own):
            break
    return np.unique(own)


def _places(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return ((hashes * np.uint64(2 * probe + 1) >> np.uint64(7 * probe % 32)) & np.uint64(bits - 1)).astype(np.int64)


def _filter(anchored: DataFrame) -> np.ndarray:
    """Bits of the hashes of anchored, set by the tasks and or-ed by place: a row for each word of bits at most."""
    n = anchored.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_BITS * n).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size >> 6, np.uint64)
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            for probe in range(PROBES):
                at = _places(hashes, probe, size)
                np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bits[used].view(np.int64))], names=["place", "bits"])

    found = anchored.select("hash").mapInArrow(words, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.uint64)
    bits[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def _beginnings(quotes: DataFrame, quote: str) -> DataFrame:
    """__q, quote -> __q, width, hash of the longest beginning that is a power of two of bytes, WIDEST at most."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(x.encode()[:WIDEST], np.uint8) for x in batch.column(1).to_pylist()]
            widths = [1 << (len(d).bit_length() - 1) for d in data]
            hashes = [Windows(d[:w]).of(w)[0] for d, w in zip(data, widths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(widths, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))], names=["__q", "width", "hash"])

    return quotes.select("__q", quote).mapInArrow(begin, "__q long, width int, hash long")


def containing(texts: DataFrame, quotes: DataFrame, text: str, quote: str, by: list[str] | None = None) -> DataFrame:
    """All columns of texts and of quotes, of each pair where the text contains the quote and the columns by are alike.

    texts are read once, whatever the number of quotes. Null texts and quotes are in no pair. An empty quote stands in every text (of its by), so such quotes
    give as many rows as there are texts. Repeated rows each give theirs. The other columns of the two have different names.
    """
    by = by or []
    spark = texts.sparkSession
    named = quotes.where(F.col(quote).isNotNull())
    distinct = staged(named.where(F.col(quote) != "").select(*by, quote).distinct().withColumn("__q", F.monotonically_increasing_id()), "quotes")
    anchored = staged(_beginnings(distinct, quote).join(distinct.select("__q", *by), "__q"), "quote-anchors")
    widths = sorted(r["width"] for r in anchored.select("width").distinct().collect())
    spread = spark.sparkContext.broadcast((widths, _filter(anchored)))
    at = texts.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, bits = spread.value
        for batch in batches:
            found = [_text_hashes(x.as_py().encode(), widths, bits) if x.is_valid else None for x in batch.column(at)]
            rows = [i for i, hits in enumerate(found) if hits is not None and len(hits)]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([found[i].view(np.int64) for i in rows], pa.list_(pa.int64()))], names=[*taken.schema.names, "__hashes"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields), "__hashes array<long>"])
    near = staged(texts.mapInArrow(scan, kinds).withColumn("__t", F.monotonically_increasing_id()), "texts-near")
    hits = near.select("__t", *by, F.explode("__hashes").alias("hash")).join(anchored.select("hash", "__q", *by), ["hash", *by]).select("__t", "__q")
    # A text goes with all its quotes at once.
    asked = hits.join(distinct.select("__q", F.col(quote).alias("__quote")), "__q").groupBy("__t").agg(F.collect_list(F.struct("__q", "__quote")).alias("__asked"))
    held = near.join(asked, "__t").withColumn("__held", F.filter("__asked", lambda q: F.contains(F.col(text), q["__quote"])))
    held = held.select(*texts.columns, F.explode("__held.__q").alias("__q"))
    rest = [c for c in quotes.columns if c not in by]
    found = held.join(named.join(distinct, [*by, quote]).select("__q", *rest), "__q").select(*texts.columns, *rest)
    empty = named.where(F.col(quote) == "")
    if empty.isEmpty():
        return found
    whole = texts.where(F.col(text).isNotNull())
    return found.unionByName((whole.join(empty, by) if by else whole.crossJoin(empty)).select(*texts.columns, *rest))


def _text_hashes(data: bytes, widths: list[int], bits: np.ndarray) -> np.ndarray:
    """Distinct hashes of the text's windows that the filter may hold; pieces overlap by a window."""
    out = []
    for begin in range(0, max(1, len(data)), PIECE):
        piece = np.frombuffer(data[begin : begin + PIECE + WIDEST], np.uint8)
        windows = Windows(piece)
        out += [_kept(bits, windows.of(w)) for w in widths if w <= len(piece)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def winnowed(rows: DataFrame, text: str, shared: int) -> DataFrame:
    """rows without text, with anchor: hashes of which any two texts have one in common if they share a passage of so many characters. A long text has some
    two of them for each shared / 2 characters; one that is shorter has none."""
    gram = max(1, shared // 2)
    window = shared - gram + 1

    @F.pandas_udf("array<long>")
    def chosen(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def of(text: str | None) -> list[int]:
            hashes = Windows(_symbols(text or "")).of(gram)
            if len(hashes) < window:
                return []
            picked = []
            for begin in range(0, len(hashes) - window + 1, PIECE):
                views = np.lib.stride_tricks.sliding_window_view(hashes[begin : begin + PIECE + window - 1], window)
                picked.append(np.unique(views.argmin(axis=1) + np.arange(len(views)) + begin))
            return np.unique(hashes[np.concatenate(picked)]).view(np.int64).tolist()

        for series in texts:
            yield series.map(of)

    return rows.select(*[c for c in rows.columns if c != text], F.explode(chosen(text)).alias("anchor"))


def common_length(a: str, b: str) -> int:
    """Length of the longest substring of both, in characters: by halves, whether some window of a length is in both; the windows found are compared."""
    x, y = _symbols(a), _symbols(b)
    one, other = Windows(x), Windows(y)
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if _place(x, y, one, other, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _place(x: np.ndarray, y: np.ndarray, one: Windows, other: Windows, width: int) -> bool:
    """Whether a window of this width is in both: its hash is, and so are its symbols."""
    left, right = one.of(width), other.of(width)
    order = np.argsort(right, kind="stable")
    begin, end = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    for i in np.flatnonzero(end > begin):
        for j in order[begin[i] : end[i]]:
            if (x[i : i + width] == y[j : j + width]).all():
                return True
    return False


@F.pandas_udf(T.LongType())
def longest_common(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def sharing(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: int, by: list[str], keys: tuple[str, str]) -> DataFrame:
    """keys of the pairs of rows (alike in by) that may share a passage of so many characters: all that do, and few others."""
    # A text's anchors do not repeat; pairs are made distinct once, after the join, so that a side that is large need not move for it.
    a = winnowed(left.select(*by, keys[0], left_text), left_text, least)
    b = winnowed(right.select(*by, keys[1], right_text), right_text, least)
    return a.join(b, [*by, "anchor"]).select(*keys).distinct()

