"""Language identification and quality classification: held-out accuracy and odd tables."""

import dataclasses
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import langid, quality, queries
from lacuna.llm.textvec import normalised, word_hashes

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op7_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = langid.train(train, "text", "lang", F.xxhash64("doc_id"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "the dog"), (4, "the dog"), (5, "und der hund " * 50_000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    nothing = langid.train(train.limit(0), "text", "lang", F.xxhash64("doc_id"))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_presence_is_a_kernel():
    kernel = langid.Kernel(places=1 << 14)
    x = langid.presence(pa.array(["ab ab", "ab", None, "x" * 3]), kernel)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert [int(r.sum()) for r in x] == [len(grams(t)) for t in ("ab ab", "ab", "", "xxx")]


@needs_data
def test_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = labels.where("doc_id % 3 = 0")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.score(docs, model, keep=["doc_id"]).join(held, "doc_id").collect()
    assert sum((r["quality_score"] >= 0.5) == (r["quality"] == 1) for r in rows) / len(rows) > 0.93


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality_score string"
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (2, "a b", "en", "s", 3, "x"), (None, "w " * 300_000, "en", "s", 9, "x")], schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model is None
    assert [r["p"] for r in quality.score(docs, model, out="p").collect()] == [1.0] * 4
    assert quality.score(docs.limit(0), None, out="p").count() == 0
    assert not np.isnan(quality.text_features(pa.array([None, "", " ", "\n", "A", "a" * 10**6]), 8, 4)).any()


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    texts = normalised(pa.array(["Hello, wörld hello", "", None, "a b c", "x" * 10 + " hello"]))
    hashes, begins = word_hashes(texts)
    assert begins.tolist() == [0, 3, 3, 3, 6, 8] and hashes[0] == hashes[2] == hashes[7]
    monkeypatch.setattr("lacuna.llm.textvec.BYTES_AT_ONCE", 16)
    again, _ = word_hashes(texts)
    assert (hashes == again).all()


def plain_step(x, y, weights, w, ridge_rows, options):
    """One damped step of Newton's method, row by row; weights are those of the rows before the classes are made to weigh the same."""
    size = len(w)
    total = [sum(v for v, label in zip(weights, y) if label == c) for c in (0, 1)]
    slope, bend = [0.0] * size, [[0.0] * size for _ in range(size)]
    for row, label, weight in zip(x, y, weights):
        row = [*row, 1.0]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(row, w))))
        own = weight * sum(total) / 2 / total[label]
        for i in range(size):
            slope[i] += own * (p - label) * row[i]
            for j in range(size):
                bend[i][j] += own * max(p * (1 - p), 1e-6) * row[i] * row[j]
    for i in range(size):
        penalty = options.ridge * ridge_rows if i < size - 1 else 1e-9
        slope[i] += penalty * w[i]
        bend[i][i] += penalty
    move = np.linalg.solve(np.array(bend), np.array(slope))
    return w - move / max(1.0, np.abs(move).max() / 4)


def test_a_round_of_cotraining_against_plain_python():
    rng = np.random.default_rng(2)
    options = quality.Training(rounds=1, confidence=0.8)
    side = rng.integers(0, 2, 120)
    text = rng.normal(size=(120, 3)) + side[:, None]
    places = np.stack([side * 2 + rng.integers(0, 2, 120), 4 + rng.integers(0, 3, 120)], axis=1)
    metadata = quality.one_hot(places, 8)
    labelled, free = slice(0, 60), slice(60, 120)
    mean, scale = text.mean(axis=0), text.std(axis=0)
    z = (text - mean) / scale
    model = quality.cotrain((text[labelled], metadata[labelled], side[labelled]), (mean, scale), lambda models, sureness: quality.handed_over(z[free], metadata[free], models, sureness, options), options)

    views = [z, metadata]
    known = [i for i in range(60) if i % 4]
    models = []
    for view in views:
        w = np.zeros(view.shape[1] + 1)
        for _ in range(25):
            w = plain_step(view[known], side[known], [1.0] * len(known), w, len(known), options)
        models.append(w)
    after = []
    for v in (0, 1):
        rows, labels = [], []
        margin = lambda i: views[1 - v][i] @ models[1 - v][:-1] + models[1 - v][-1]  # noqa: B023, E731
        sure = np.zeros(2)
        for _ in range(25):
            # Both classes weigh as they come.
            m = np.array([[margin(i), 1.0] for i in range(0, 60, 4)])
            p = 1 / (1 + np.exp(-m @ sure))
            slope = m.T @ (p - side[0:60:4]) + np.array([options.ridge * 15, 1e-9]) * sure
            move = np.linalg.solve((m * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ m + np.diag([options.ridge * 15, 1e-9]), slope)
            sure = sure - move / max(1.0, np.abs(move).max() / 4)
        for i in range(60, 120):
            p = 1 / (1 + np.exp(-(sure[0] * margin(i) + sure[1])))
            if max(p, 1 - p) >= 0.8:
                rows.append(i)
                labels.append(int(p >= 0.5))
        assert len(rows) > 5
        weight = min(0.3, len(known) / len(rows))
        after.append(plain_step(np.concatenate([views[v][known], views[v][rows]]), [*side[known], *labels], [1.0] * len(known) + [weight] * len(rows), models[v], len(known), options))
    np.testing.assert_allclose(model.text, after[0], rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose(model.metadata, after[1], rtol=1e-6, atol=1e-7)
    margin = model.combined[0] * (z @ after[0][:-1] + after[0][-1]) + model.combined[1] * (metadata @ after[1][:-1] + after[1][-1]) + model.combined[2]
    np.testing.assert_allclose(model.probability(text, metadata), 1 / (1 + np.exp(-margin)), rtol=1e-5)


def test_cotraining_takes_all_documents(spark):
    rng = np.random.default_rng(1)
    good = lambda i: " ".join(rng.choice(["tree", "house", "river", "road"], 30)) + "."
    bad = lambda i: " ".join(rng.choice(["!!!", "$$", "BUY", "x9"], 30))
    rows = [(i, good(i) if i % 2 else bad(i), "s" if i % 2 else "t") for i in range(400)] + [(None, "BUY BUY", "t"), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    options = quality.Training(labelled_rows=30)
    model = quality.train(docs, labels, metadata=("source",), options=options)
    x = quality.text_features(pa.array([t for _, t, _ in rows], pa.large_string()), options.shapes, options.words).astype(np.float16).astype(np.float64)
    np.testing.assert_allclose(model.mean, x.mean(axis=0), atol=1e-9)
    np.testing.assert_allclose(model.scale, np.maximum(x.std(axis=0), 1e-3), atol=1e-6)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model, metadata=("source",), keep=["doc_id"], options=options).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(400) if i != 7)
    again = quality.train(docs.repartition(3), labels, metadata=("source",), options=options)
    np.testing.assert_allclose(again.combined, model.combined, rtol=1e-6)


def test_rare_languages_are_learned(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"the cat and the dog number {i}", "en") for i in range(3000)] + [(i, f"der hund und die katze zum {i}", "de") for i in range(3000, 3005)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, "text", "lang", F.xxhash64("doc_id"), langid.Kernel(sample_rows=100))
    assert model.languages == ["de", "en"]
    got = langid.predict(spark.createDataFrame([(1, "die katze und der hund")] * 2, "doc_id long, text string"), model)
    assert [r["lang_pred"] for r in got.collect()] == ["de", "de"] and langid.predict(docs.limit(0), model).count() == 0


def test_scores_against_the_kernel_itself():
    """The one matrix product gives what kernel ridge regression on Nystroem features gives when it is written out with sets of n-grams."""
    kernel = langid.Kernel(places=1 << 20, landmarks=6)
    texts = ["the cat sat", "a dog and a cat", "the old dog", "der alte hund", "eine katze und", "und der hund"]
    langs = ["en", "en", "en", "de", "de", "de"]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    k = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    model = langid.fit(langid.presence(pa.array(texts), kernel), langs, kernel)
    # All texts are landmarks: features whose products are the kernel.
    gram = np.array([[k(a, b) for b in texts] for a in texts])
    values, vectors = np.linalg.eigh(gram)
    features = np.concatenate([gram @ (vectors / np.sqrt(values)), np.ones((6, 1))], axis=1)
    weight = np.full((6, 1), 1 / 3)
    targets = np.array([[lang == name for name in ("de", "en")] for lang in langs], float)
    ridge = kernel.ridge * 2 / features.shape[1] * np.eye(features.shape[1])
    solved = np.linalg.solve(features.T @ (features * weight) + ridge, features.T @ (targets * weight))
    for text in ["the hund", "a katze", "cat"]:
        own = np.concatenate([np.array([k(text, b) for b in texts]) @ (vectors / np.sqrt(values)), [1.0]]) @ solved
        x = langid._unit(langid.presence(pa.array([text]), kernel))
        np.testing.assert_allclose((x @ model.weights[:-1] + model.weights[-1])[0], own, atol=1e-4)


def test_a_labelled_key_may_stand_in_any_number_of_rows(spark):
    """Only the sample's worth of rows goes to the driver, and the model is learned."""
    good, bad = "this is a sentence of plain words that goes on for a while", "$$$ BUY NOW !!! $$$ CLICK"
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, good).otherwise(bad).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(40).alias("n_chars"))
    many = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(bad).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(40).alias("n_chars"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("quality"))
    options = dataclasses.replace(quality.Training(), labelled_rows=400)
    calls = []
    real = quality._unpacked

    def counting(packed, options):
        calls.append(len(packed))
        return real(packed, options)

    quality._unpacked = counting
    try:
        model = quality.train(docs.unionByName(many), labels, options=options)
    finally:
        quality._unpacked = real
    assert max(calls) <= 400
    scores = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model, keep=["doc_id"], options=options).collect()}
    assert model is None or min(scores[i] for i in (0, 2, 4)) > max(scores[i] for i in (1, 3, 5))


def test_sums_of_few_tasks_take_one_level():
    """A level is a shuffle of all partitions; more of them come as tasks get more."""
    assert [quality.sum_levels(n) for n in (0, 1, 32, 64, 65, 5000)] == [[1], [1], [1], [1], [2, 1], [79, 2, 1]]
