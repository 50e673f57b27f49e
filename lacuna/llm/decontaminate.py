"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other values keeps its template. Windows of the
template, in a form with names and in one that is blind to case and has none, are hash-joined with those of the benchmark; the values in the slots of an item's windows must then map to the document's values
consistently: the same value of the item always to the same value of the document, as a re-parameterised question does and chance does not.

Almost no window of a corpus is a benchmark window. Tasks keep those that a Bloom filter of the benchmark's windows
lets through; the filter's size is fixed, whatever the benchmark's, and the join is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import bloom
from lacuna.llm.common import fresh_name, map_in_arrow, row_id, scratch, staged
from lacuna.llm.textvec import bytes_of, hash_runs, pieces, text_slices, window_hashes

#: Words that count as units.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees watt watts volt volts meter meters metre metres"
).split()

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


@dataclass(frozen=True)
class Rule:
    #: Words in a window.
    width: int = 6
    #: Share of an item's windows that a document must hold. Items shorter than a window are one window.
    coverage: float = 0.5
    #: Share of the item's slot values that map to one value each.
    consistency: float = 0.8


def _spaced(texts: pa.Array) -> pa.Array:
    """Words apart by one space; marks of a sentence's end stay as words of their own; case stays."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring_regex(texts, r"([0-9])[.,]([0-9])", r"\1\2")
    texts = pc.replace_substring_regex(texts, r"\n+|[.!?:;|]+", " . ")
    return pc.replace_substring_regex(texts, r"[^\p{L}\p{M}\p{N}.]+", " ")


def _lowered(texts: pa.Array) -> np.ndarray:
    """The bytes of the texts in lower case, each letter at its place; a letter whose small form has another length stays."""
    small = pc.utf8_lower(texts)
    if not pc.all(pc.equal(pc.binary_length(small), pc.binary_length(texts)), min_count=0).as_py():
        fit = lambda c: s if len((s := c.lower()).encode()) == len(c.encode()) else c
        small = pa.array(["".join(map(fit, t)) for t in texts.to_pylist()], pa.large_string())
    return bytes_of(small)[0]


def _units() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(hash_runs(data, np.concatenate([[0], ends[:-1] + 1]), ends))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes of the words with names and without, plain hashes of the words, and the word at which each text begins (n + 1 places).

    A word with a digit is a number, a word that begins with a capital a name, wherever it stands; the templates have their types.
    """
    spaced = _spaced(texts)
    data, offsets = bytes_of(spaced)
    lowered = _lowered(spaced)
    units = _units()
    named, blind, plain, counts = [], [], [], np.zeros(len(texts), np.int64)
    for i, j, begin, end in pieces(data, offsets):
        part = data[begin:end]
        low = lowered[begin:end]
        bounds = np.array([0, len(part)])
        if j - i > 1:
            at = offsets[i + 1 : j] - begin
            part, low = (np.insert(x, at, 32) for x in (part, low))
            bounds = np.concatenate([[0], at + np.arange(1, len(at) + 1), [len(part)]])
        inside = np.concatenate([[False], part != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        hashes = hash_runs(low, starts, ends)
        digits = np.concatenate([[0], np.cumsum((part >= 48) & (part <= 57))])
        number = digits[ends] > digits[starts]
        stop = part[starts] == ord(".")
        stop &= ends - starts == 1
        upper = np.zeros(len(starts), bool)
        for k, least in enumerate((0, 0xC0, 0xE0)):
            at = np.minimum(starts + k, len(part) - 1)
            upper |= (part[starts] >= least) & (part[at] != low[at])
        template = hashes.copy()
        template[np.isin(hashes, units)] = UNIT
        template[number] = NUMBER
        with_names = np.where(upper & (template == hashes), NAME, template)
        real = ~stop
        named.append(with_names[real])
        blind.append(template[real])
        plain.append(hashes[real])
        counts[i:j] += np.diff(np.searchsorted(starts[real], bounds))
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(named or none), np.concatenate(blind or none), np.concatenate(plain or none), np.concatenate([[0], np.cumsum(counts)])


def hashed_windows(templates: np.ndarray, plain: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows: of the template, or of the words themselves where all of them are slots."""
    slots = np.concatenate([[0], np.cumsum(_slots(templates))])
    made = window_hashes(templates, width)
    wholly = slots[width:] - slots[:-width] == width
    return np.where(wholly, window_hashes(plain, width), made) if wholly.any() else made


def _forms(named: np.ndarray, blind: np.ndarray, plain: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(template, hashes of the windows, whether a window counts): with names where a word is left that is no slot, and without where that differs."""
    first, second = hashed_windows(named, plain, width), hashed_windows(blind, plain, width)
    slots = np.concatenate([[0], np.cumsum(_slots(named))])
    some = slots[width:] - slots[:-width] < width
    return [(named, first, some), (blind, second, (second != first) | ~some)]


def _slots(templates: np.ndarray) -> np.ndarray:
    return (templates == NUMBER) | (templates == NAME) | (templates == UNIT)


def _batch(keys: pa.Array, owner: np.ndarray, hashes: np.ndarray, at: np.ndarray, width: int, templates: np.ndarray, plain: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
    slot = _slots(templates)
    values = [plain[a : a + width][slot[a : a + width]].view(np.int64) for a in at]
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(owner)), pa.array(np.full(len(at), width, np.int32)), pa.array(hashes.view(np.int64)), pa.array((at - begins[owner]).astype(np.int32)), pa.array(values, pa.list_(pa.int64()))],
        names=["key", "width", "window", "place", "slots"],
    )


def _schema(rows: DataFrame) -> str:
    return f"key {rows.schema['key'].dataType.simpleString()}, width int, window long, place int, slots array<long>"


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """key, text -> all windows of each text (of its own width where it is shorter): hash, place and the hashes of the slots' values."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            named, blind, plain, begins = words_of(batch.column(1))
            for row, (begin, end) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                if w := min(width, end - begin):
                    for (_, hashes, counts), templates in zip(_forms(named[begin:end], blind[begin:end], plain[begin:end], w), (named, blind), strict=True):
                        at = np.flatnonzero(counts)
                        yield _batch(batch.column(0), np.full(len(at), row), hashes[at], at + begin, int(w), templates, plain, begins)

    return map_in_arrow(items, scan, _schema(items))


def document_windows(rows: DataFrame, widths: list[int], bits: np.ndarray) -> DataFrame:
    """key, text -> the windows of each text that the filter lets through, as of item_windows()."""
    spread = rows.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            named, blind, plain, begins = words_of(batch.column(1))
            for w in widths:
                if len(plain) < w:
                    continue
                for templates, hashes, counts in _forms(named, blind, plain, w):
                    at = np.flatnonzero(counts)
                    at = at[bloom.may_hold(spread.value, hashes[at])]
                    owner = np.searchsorted(begins, at, "right") - 1
                    whole = at + w <= begins[owner + 1]
                    at, owner = at[whole], owner[whole]
                    yield _batch(batch.column(0), owner, hashes[at], at, w, templates, plain, begins)

    return map_in_arrow(rows, scan, _schema(rows))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """key, item_key, coverage (share of the item's windows that the document holds) and consistency (the least share, over the
    runs of windows that count, of slot values that map to one value; 1 without slots), for each pair that the rule takes for contamination.

    An item shorter than a window is one window of its own width. Null and empty texts hold no windows; a document that is repeated gives its pairs
    once; a repeated item too. No benchmark, no rows.
    """
    own = items.select(F.col(item_key).alias("key"), F.col(item_text).cast("string").alias("text")).distinct()
    benchmark = staged(item_windows(own, rule.width), "benchmark-windows")
    totals = benchmark.groupBy("key").agg(F.count_distinct("place").alias("windows"))
    benchmark = benchmark.join(totals, "key").select(F.col("key").alias("item"), "windows", "width", "window", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    widths = sorted({rule.width, *(r[0] for r in benchmark.select("width").distinct().collect())})
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    hits = document_windows(rows, widths, bloom.build(benchmark, "window")).join(benchmark, ["width", "window"])

    # Windows of one passage keep their distance from the item's; each such run has slots of its own.
    mapped = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    runs = hits.groupBy("key", "item", (F.col("place") - F.col("item_place")).alias("shift")).agg(
        F.max("windows").alias("windows"), F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set(mapped))).alias("mapped")
    )
    values = F.array_distinct(F.transform("mapped", lambda m: m["item"]))
    steady = F.size(F.filter(values, lambda v: F.size(F.filter("mapped", lambda m: m["item"] == v)) == 1))
    runs = runs.withColumn("consistency", F.when(F.size(values) > 0, steady / F.size(values)).otherwise(1.0)).where(F.col("consistency") >= rule.consistency)
    return (
        runs.groupBy("key", "item")
        .agg((F.size(F.array_distinct(F.flatten(F.collect_set("places")))) / F.max("windows")).alias("coverage"), F.min("consistency").alias("consistency"))
        .where(F.col("coverage") >= rule.coverage)
        .select(F.col("key").alias(key), F.col("item").alias(item_key), "coverage", "consistency")
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """docs without the rows whose text matches() finds. Rows are told apart by key and text: one that shares its key, null or empty ones too, with a contaminated
    row stays. Repeated rows go or stay together; null and empty texts stay; without a benchmark all rows stay, and an empty table stays empty."""
    mark = fresh_name(docs, "row_id")
    named = docs.withColumn(mark, row_id(F.col(key), F.col(text)))
    with scratch(docs.sparkSession):
        found = staged(matches(named.select(mark, text), items, mark, text, item_key, item_text, rule).select(mark).distinct(), "contaminated", keep=True)
    return named.join(found, mark, "left_anti").drop(mark)
