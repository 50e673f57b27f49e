"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams, of every length up to a limit, that both have, over the root of the product of their
counts (presence, so repeats do not count). n-grams are hashed to a fixed number of places. Kernel ridge regression, one language against the
rest, is fitted in the Nystroem space of landmark texts. As the kernel is a scalar product of presence vectors, landmarks, whitening and
weights multiply into one matrix, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import map_in_arrow, staged
from lacuna.llm.samples import SLACK
from lacuna.llm.textvec import mix, text_slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Kernel:
    longest: int = 3
    places: int = 1 << 14
    landmarks: int = 256
    ridge: float = 0.1
    #: Bound of the sample that the model is fitted on; it is shared out among the languages, with least_rows for each of many.
    sample_rows: int = 4000
    least_rows: int = 8
    #: Texts, and characters, in a matrix.
    batch: int = 256


def presence(texts: pa.Array, kernel: Kernel) -> np.ndarray:
    """A row for each text: 1 where the text has an n-gram of that place. Only letters and marks count, in lower case; other runs are a space."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    plain = pc.replace_substring_regex(pc.utf8_lower(plain), r"[^\p{L}\p{M}]+", " ")
    out = np.zeros((len(texts), kernel.places), np.uint8)
    flat = out.reshape(-1)
    lengths = pc.utf8_length(plain).to_numpy()
    codes = np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le"), np.uint32)
    shift = np.uint64(64 - int(kernel.places).bit_length() + 1)
    for begin in range(0, len(codes), 1 << 19):
        # Some codes before the part belong to the n-grams that end in it.
        low = max(0, begin - kernel.longest + 1)
        part = codes[low : begin + (1 << 19)].astype(np.uint64)
        owner = np.searchsorted(np.cumsum(lengths), np.arange(low, low + len(part)), "right")
        gram = np.zeros(len(part), np.uint64)
        for n in range(1, kernel.longest + 1):
            gram = part if n == 1 else gram[:-1] * np.uint64(0x1000003) + part[n - 1 :] + np.uint64(n)
            place = mix(gram) >> shift
            within = owner[: len(gram)] == owner[n - 1 :]
            flat[owner[: len(gram)][within] * kernel.places + place[within].astype(np.int64)] = 1
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: places x languages.
    weights: np.ndarray


def fit(rows: np.ndarray, languages: list[str], kernel: Kernel) -> Model:
    """rows: presence vectors. The landmarks are spread over the languages in turn."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((kernel.places, 0), np.float32))
    x, label = _unit(rows), np.searchsorted(names, languages)
    rank = np.zeros(len(label), np.int64)
    for c in range(len(names)):
        rank[label == c] = np.arange((label == c).sum())
    landmarks = x[np.lexsort((label, rank))[: kernel.landmarks]]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = values > 1e-6
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = (x @ landmarks.T) @ whiten
    # Each language weighs the same, however many rows it has.
    weight = 1 / np.bincount(label)[label]
    targets = np.eye(len(names))[label]
    centre = np.concatenate([features, np.ones((len(x), 1))], axis=1)
    gram = centre.T @ (centre * weight[:, None])
    solved = np.linalg.solve(gram + kernel.ridge * len(names) / len(gram) * np.eye(len(gram)), centre.T @ (targets * weight[:, None]))
    weights = landmarks.T @ (whiten @ solved[:-1])
    return Model(names, np.vstack([weights, solved[-1:]]).astype(np.float32))


def train(docs: DataFrame, text: str, lang: str, order: Column, kernel: Kernel = Kernel()) -> Model:
    """A model from the rows of docs that have a language and letters. Of each language it takes the same number of rows, or all it has: those least
    by order, a 64-bit hash, so that a rare language is learned as well. Null languages and texts and texts without letters take no part; repeated rows
    count as they come; no rows give a model that knows no language."""
    value = F.col(text).cast("string")
    usable = docs.where(F.col(lang).isNotNull() & value.isNotNull() & value.rlike(r"\p{L}")).select(value.alias("text"), F.col(lang).cast("string").alias("lang"), order.alias("place"))
    counts = staged(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(kernel.least_rows, kernel.sample_rows // max(1, counts.count()))
    # A cut by hash leaves about SLACK times the rows of a language, so no task ranks all of a large one's.
    cut = F.when(F.col("n") <= SLACK * each, F.lit(2.0**63)).otherwise(F.lit(-(2.0**63)) + F.lit(2.0**64 * SLACK * each) / F.col("n"))
    near = usable.join(counts.select("lang", cut.alias("cut")), "lang").where(F.col("place").cast("double") <= F.col("cut"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", F.md5(F.col("text").cast("binary")))))
    sample = ranked.where(F.col("rank") <= each).select("text", "lang", "place")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0, 1 << 21):
            bits = np.packbits(presence(batch.column(0), kernel), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bits], pa.binary()), batch.column(1), batch.column(2)], names=["bits", "lang", "place"])

    rows = map_in_arrow(sample, packed, "bits binary, lang string, place long").toArrow().sort_by([("place", "ascending"), ("lang", "ascending"), ("bits", "ascending")])
    bits = [np.unpackbits(np.frombuffer(b, np.uint8)) for b in rows.column("bits").to_pylist()]
    return fit(np.stack(bits) if bits else np.zeros((0, kernel.places), np.uint8), rows.column("lang").to_pylist(), kernel)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), kernel: Kernel = Kernel()) -> DataFrame:
    """The columns keep, lang_pred (a learned language) and score (0 to 1), from the whole text alone.

    A text that is null or has no letter is und with score 0, and so is every text where nothing could be learned. Repeated rows each give a row; an empty table gives none.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at = len(keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for large in text_slices(batches, at, 1 << 21):
            for begin in range(0, large.num_rows, kernel.batch):
                batch = large.slice(begin, kernel.batch)
                letters = pc.fill_null(pc.match_substring_regex(batch.column(at), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                if known.languages and letters.any():
                    rows = np.flatnonzero(letters)
                    sums = _unit(presence(batch.column(at).take(pa.array(rows)), kernel)) @ known.weights[:-1] + known.weights[-1]
                    score[rows] = np.clip(sums.max(axis=1), 0, 1)
                    for row, best in zip(rows, sums.argmax(axis=1), strict=True):
                        names[row] = known.languages[best]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])
    return map_in_arrow(docs.select(*keep, F.col(text).cast("string").alias("__text")), scored, schema)
