"""Quality classification by co-training.

Two views of a document, the content of its text and its metadata, each have a logistic classifier. In each round each view
labels all unlabelled documents that it is sure of, by a probability calibrated on labelled rows that were held back, and the other learns from them: tasks sum slopes and curvatures over them, and a step of
Newton's method takes the sums. The views' scores are calibrated on labelled rows that were held back, weighed by how much each tells there, and combined for every document.

Only the labelled rows are a bounded sample (Training); pseudo-labels, moments, features and scores cover all documents and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import map_in_arrow, release, scratch, small_batches, staged
from lacuna.llm.samples import hash_sample
from lacuna.llm.textvec import bytes_of, hash_runs, mix, text_slices


@dataclass(frozen=True)
class Training:
    #: Bound of the sample of labelled rows.
    labelled_rows: int = 8_000
    rounds: int = 4
    #: How sure a view must be of a row that it hands over; and what a row handed over weighs at most, and all of them in labelled rows.
    confidence: float = 0.95
    handed_weight: float = 0.3
    handed_share: float = 1.0
    ridge: float = 1e-2
    #: Places that the characters' shapes, the words and the metadata values are hashed to.
    shapes: int = 64
    words: int = 128
    values: int = 128

    @property
    def width(self) -> int:
        """Features of the text view."""
        return NUMERIC + self.shapes + self.words


NUMERIC = 14


def text_features(texts: pa.Array, shapes: int, places: int) -> np.ndarray:
    """A row for each text: rates of character classes, of words in capitals, of words and lines that repeat, lengths, hashed shapes of word ends, and hashed words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    data, offsets = bytes_of(texts)
    n = len(texts)
    out = np.zeros((n, NUMERIC + shapes + places), np.float64)
    for row in range(n):
        part = data[offsets[row] : offsets[row + 1]]
        if not len(part):
            continue
        space = (part == 32) | ((part >= 9) & (part <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        upper, lower = (part >= 65) & (part <= 90), ((part >= 97) & (part <= 122)) | (part >= 128)
        digit = (part >= 48) & (part <= 57)
        sign = ~(space | upper | lower | digit)
        plain = part | np.where(upper, 32, 0).astype(np.uint8)
        words, count = hash_runs(plain, starts, ends), len(starts)
        _, times = np.unique(words, return_counts=True)
        lengths = ends - starts
        capitals, signs = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(sign)])
        in_word, signs_in = capitals[ends] - capitals[starts], signs[ends] - signs[starts]
        marks = sign[1:] & sign[:-1]
        lines = np.concatenate([[-1], np.flatnonzero(part == 10), [len(part)]])
        line_hashes = hash_runs(part, lines[:-1] + 1, lines[1:])
        out[row, :NUMERIC] = (
            sign.mean(), digit.mean(), upper.mean(), lower.mean(), marks.mean() if len(marks) else 0,
            (in_word * 2 > lengths).mean(), (signs_in > 1).mean(), (signs_in == lengths).mean(),
            (words[1:] == words[:-1]).mean() if count > 1 else 0, times.max() / count if count > 20 else 0,
            1 - len(times) / count if count > 20 else 0, 1 - len(np.unique(line_hashes)) / len(line_hashes), lengths.mean() / 10, np.log1p(count) / 10,
        )
        # The last two characters of a word, letters and digits by class.
        kind = np.where(upper, 65, np.where(lower, 97, np.where(digit, 48, part))).astype(np.uint64)
        tail = kind[ends - 1] + np.uint64(256) * np.where(lengths > 1, kind[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        out[row, NUMERIC : NUMERIC + shapes] = np.sqrt(np.bincount((mix(tail) % np.uint64(shapes)).astype(np.int64), minlength=shapes) / count)
        out[row, NUMERIC + shapes :] = np.sqrt(np.bincount((words % np.uint64(places)).astype(np.int64), minlength=places) / count)
    return out


def metadata_places(columns: list[pa.Array], values: int) -> np.ndarray:
    """For each document the place (below values) of each of its metadata values, by hash; of numbers that of the magnitude."""
    n = len(columns[0]) if columns else 0
    out = np.zeros((n, len(columns)), np.int64)
    for k, column in enumerate(columns):
        if pa.types.is_floating(column.type) or pa.types.is_integer(column.type):
            size = np.log2(np.abs(pc.fill_null(column.cast(pa.float64()), 0).to_numpy(zero_copy_only=False)) + 1)
            names = [f"{x:.0f}" for x in np.nan_to_num(size * 2, posinf=0)]
        else:
            names = [str(x) for x in column.to_pylist()]
        raw = [f"{k}:{x}".encode() for x in names]
        ends = np.cumsum([len(x) for x in raw])
        out[:, k] = hash_runs(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends) % np.uint64(values)
    return out


def one_hot(places: np.ndarray, values: int) -> np.ndarray:
    out = np.zeros((len(places), values))
    for column in places.T:
        out[np.arange(len(places)), column] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the constant last and unpenalised."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge * weight.sum())
    penalty[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(bend, slope)
        w -= move / max(1.0, np.abs(move).max() / 4)
        if np.abs(move).max() < 1e-6:
            break
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    #: Weights of the text view and of the metadata view; weights of their margins and the constant in the combined margin.
    text: np.ndarray
    metadata: np.ndarray
    combined: np.ndarray
    prior: float

    def probability(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        margins = np.stack([_margin((text - self.mean) / self.scale, self.text), _margin(metadata, self.metadata)], axis=1)
        return 1 / (1 + np.exp(-np.clip(_margin(margins, self.combined), -30, 30)))


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """For the rows of each label: their number, slope and curvature at w, of the unweighted loss."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    p = _sigmoid(x @ w)
    out = []
    for label in (0, 1):
        own, q = x[y == label], p[y == label]
        out += [np.array([float(len(own))]), own.T @ (q - label), ((own * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ own).ravel()]
    return out


def handed_over(text: np.ndarray, metadata: np.ndarray, models: list[np.ndarray], sureness: list[np.ndarray], options: Training) -> np.ndarray:
    """Sums over rows without labels: those that the metadata view is sure of for the text view, then the other way round. sureness: for each view the weight of
    its margin and the constant that make a probability of it, so that a view that is often wrong is never sure."""
    views = [text, metadata]
    parts = []
    for v in (0, 1):
        p = _sigmoid(_margin(_margin(views[1 - v], models[1 - v])[:, None], sureness[1 - v]))
        sure = np.maximum(p, 1 - p) >= options.confidence
        parts += _sums(views[v][sure], (p[sure] >= 0.5).astype(int), models[v])
    return np.concatenate(parts)


def _steps(x: np.ndarray, y: np.ndarray, w: np.ndarray, handed: np.ndarray | None, options: Training, steps: int) -> np.ndarray:
    """w after steps of Newton's method over labelled rows and, at the w that they start from, the sums of rows handed over. Both classes weigh the same."""
    size = len(w)
    penalty = np.full(size, options.ridge * len(y))
    penalty[-1] = 1e-9
    other = [np.zeros(1), np.zeros(size), np.zeros(size * size)] * 2 if handed is None else np.split(handed, np.cumsum([1, size, size * size] * 2)[:-1])
    many = float(other[0][0] + other[3][0])
    weight = min(options.handed_weight, options.handed_share * len(y) / max(many, 1))
    for _ in range(steps):
        own = _sums(x, y, w)
        total = [own[3 * c][0] + weight * other[3 * c][0] for c in (0, 1)]
        slope, bend = penalty * w, np.diag(penalty)
        for c in (0, 1):
            balance = sum(total) / 2 / max(total[c], 1)
            slope = slope + balance * (own[3 * c + 1] + weight * other[3 * c + 1])
            bend = bend + balance * (own[3 * c + 2] + weight * other[3 * c + 2]).reshape(size, size)
        move = np.linalg.solve(bend, slope)
        w = w - move / max(1.0, np.abs(move).max() / 4)
        if np.abs(move).max() < 1e-6:
            break
    return w


def cotrain(labelled: tuple[np.ndarray, np.ndarray, np.ndarray], moments: tuple[np.ndarray, np.ndarray], pool: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray], options: Training) -> Model:
    """labelled: text features, metadata features and labels (0 or 1). moments: means and deviations of the text features of all documents.
    pool: the sums of handed_over() for two models and their sureness, over all rows without labels. A quarter of the labelled rows is held back: each round's sureness
    and the weights of the combined margin are fitted on it."""
    text, metadata, y = labelled
    mean, scale = moments
    views = [(text - mean) / scale, metadata]
    held = np.arange(len(y)) % 4 == 0
    models = [_steps(x[~held], y[~held], np.zeros(x.shape[1] + 1), None, options, 25) for x in views]
    for _ in range(options.rounds):
        sureness = [logistic(_margin(x[held], w)[:, None], y[held], np.ones(held.sum()), options.ridge) for x, w in zip(views, models, strict=True)]
        handed = pool(models, sureness)
        cut = 2 * (1 + len(models[0]) + len(models[0]) ** 2)
        models = [_steps(x[~held], y[~held], w, part, options, 1) for x, w, part in zip(views, models, (handed[:cut], handed[cut:]), strict=True)]
    margins = np.stack([_margin(x[held], w) for x, w in zip(views, models, strict=True)], axis=1)
    # Calibrated with the true shares of the classes.
    combined = logistic(margins, y[held], np.ones(held.sum()), 1e-3)
    return Model(mean, scale, models[0], models[1], combined, float(y.mean()))


def _per_document(make: Callable[[np.ndarray, np.ndarray], pa.Array], text: str, metadata: list[str], docs: DataFrame, kind: T.DataType, options: Training) -> Column:
    """A column that make gives of a document's text features and metadata places. Text and metadata go to Python, and only the answer comes back."""

    def run(texts: pa.Array, values: pa.Array) -> pa.Array:
        parts = []
        for batch in text_slices(iter([pa.RecordBatch.from_arrays([texts, *values.flatten()], names=[str(i) for i in range(values.type.num_fields + 1)])])):
            parts.append(make(text_features(batch.column(0), options.shapes, options.words), metadata_places(batch.columns[1:], options.values)))
        return pa.concat_arrays(parts) if parts else pa.nulls(0, make(np.zeros((0, options.width)), np.zeros((0, values.type.num_fields), np.int64)).type)

    small_batches(docs.sparkSession)
    numeric = ("long", "integer", "double", "float", "short", "byte")
    plain = [F.col(c) if docs.schema[c].dataType.typeName() in numeric else F.col(c).cast("string") for c in metadata]
    named = [c.alias(f"m{i}") for i, c in enumerate(plain)] or [F.lit(0).alias("m0")]
    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(F.col(text).cast("string"), F.struct(*named))


def _packed(text: np.ndarray, places: np.ndarray) -> pa.Array:
    """Features of a document in few bytes: half floats, then places."""
    left, right = text.astype("<f2").view(np.uint8).reshape(len(text), -1), places.astype("<u2").view(np.uint8).reshape(len(places), -1)
    return pa.array([r.tobytes() for r in np.concatenate([left, right], axis=1)], pa.binary())


def _unpacked(packed: pa.Array, options: Training) -> tuple[np.ndarray, np.ndarray]:
    """Text features and metadata features."""
    rows = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    cut = 2 * options.width
    text = np.ascontiguousarray(rows[:, :cut]).view("<f2").astype(np.float64).reshape(len(rows), -1)
    return text, one_hot(np.ascontiguousarray(rows[:, cut:]).view("<u2").astype(np.int64).reshape(len(rows), -1), options.values)


#: The sums of about so many tasks are added up by one, level by level, so that no task holds many of them and the driver one.
SUMS = 64


def sum_levels(tasks: int) -> list[int]:
    """The groups of each level: as many levels as so many tasks ask for, the last of one group."""
    groups = [-(-tasks // SUMS)]
    while groups[-1] > 1:
        groups.append(-(-groups[-1] // SUMS))
    return groups if tasks else [1]


def _summed(features: DataFrame, make: Callable[[np.ndarray, np.ndarray], np.ndarray], options: Training, levels: list[int]) -> np.ndarray | None:
    """The sum of make(text features, metadata features) over all rows of features, added up in levels; None of no rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = make(*_unpacked(batch.column(0).slice(begin, 4096), options))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in sorted(group.column("sums").to_pylist()))
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part long, sums binary"
    rows = map_in_arrow(features.select("x"), task, schema)
    for groups in levels:
        rows = rows.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part").applyInArrow(add, schema)
    one = rows.first()
    return np.frombuffer(one["sums"], np.float64) if one else None


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("lang", "source", "n_chars"), options: Training = Training()) -> Model | None:
    """A model from labels (key, label 0 or 1) and from all documents; None where not both labels are there, or fewer than 8 rows have one.

    The labelled sample is the rows least by a hash of the key, of a key's labels the least; null keys and labels take no part in it. Every other document, repeated or
    with a null text (which counts as empty) too, is a row without label.
    """
    with scratch(docs.sparkSession):
        model = _trained(docs, labels, key, text, label, metadata, options)
    # The driver held the sample's rows.
    release()
    return model


def _trained(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, metadata: tuple[str, ...], options: Training) -> Model | None:
    order = F.xxhash64(F.col(key), F.lit(7)).alias("__order")
    given = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("__given"))
    chosen = staged(hash_sample(given.select(F.col(key).alias("key"), "__given", order), F.col("__order"), options.labelled_rows), "quality-labels")
    features = staged(docs.select(F.col(key).alias("key"), _per_document(_packed, text, list(metadata), docs, T.BinaryType(), options).alias("x")), "quality-features")
    # A key may stand in any number of rows: those that are least go to the driver, no more than the sample's size.
    least = features.join(F.broadcast(chosen), "key").select("__order", "__given", "x").orderBy("__order", "x").limit(options.labelled_rows)
    rows = least.toArrow().sort_by([("__order", "ascending"), ("x", "ascending")])
    y = rows.column("__given").to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2 or len(y) < 8:
        return None
    x, m = _unpacked(rows.column("x").combine_chunks(), options)
    levels = sum_levels(features.rdd.getNumPartitions())
    moments = _summed(features, lambda t, _: np.concatenate([[float(len(t))], t.sum(axis=0), (t * t).sum(axis=0)]), options, levels)
    n, width = moments[0], options.width
    mean = moments[1 : width + 1] / n
    scale = np.maximum(np.sqrt(np.maximum(moments[width + 1 :] / n - mean * mean, 0)), 1e-3)
    pool = features.join(F.broadcast(chosen.select("key")), "key", "left_anti").select("x")

    def handed(models: list[np.ndarray], sureness: list[np.ndarray]) -> np.ndarray:
        spread = docs.sparkSession.sparkContext.broadcast((models, sureness))
        total = _summed(pool, lambda t, places: handed_over((t - mean) / scale, places, *spread.value, options), options, levels)
        return total if total is not None else np.zeros(sum(2 * (1 + len(w) + len(w) ** 2) for w in models))

    return cotrain((x, m, y), (mean, scale), handed, options)


def score(docs: DataFrame, model: Model | None, text: str = "text", metadata: tuple[str, ...] = ("lang", "source", "n_chars"), keep: list[str] | None = None, out: str = "quality_score", options: Training = Training()) -> DataFrame:
    """The columns keep (all if None) and out, the probability of label 1. Null texts count as empty; without a model every score is 1.
    Repeated rows each give a row; an empty table gives none; a column named out among those kept is an error."""
    carried = docs.columns if keep is None else keep
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def probability(texts: np.ndarray, places: np.ndarray) -> pa.Array:
        known = spread.value
        return pa.array(np.ones(len(texts)) if known is None else known.probability(texts, one_hot(places, options.values)), pa.float64())

    return docs.select(*carried, _per_document(probability, text, list(metadata), docs, T.DoubleType(), options).alias(out))
