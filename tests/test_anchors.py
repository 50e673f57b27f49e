"""Containment and shared passages against plain Python."""

import difflib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import anchors, evaluation


def text(rng, n, letters="abc é𝄞"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_common_length():
    rng = random.Random(1)
    for _ in range(300):
        a, b = text(rng, rng.randrange(60), "abcé"), text(rng, rng.randrange(60), "abcé")
        assert anchors.common_length(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
    assert anchors.common_length("", "") == anchors.common_length("a", "") == 0


def test_common_length_of_long_texts():
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 20, n))
    passage = letters(5000)
    a, b = letters(60_000) + passage + letters(40_000), letters(20_000) + passage + letters(80_000)
    began = time.perf_counter()
    assert 5000 <= anchors.common_length(a, b) < 5010
    assert time.perf_counter() - began < 10


def longest(a, b):
    """By a table of common endings, row by row."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = before[j - 1] + 1
        best, before = max(best, *row), row
    return best


def test_symbols_with_the_same_sums_are_told_apart():
    """Sequences that polynomial hashes of two symbols take for each other."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    assert anchors.common_length(word[:2048], word[2048:4096]) == longest(word[:2048], word[2048:4096])


@pytest.mark.parametrize("by", [None, ["paper"]])
def test_containing(spark, by, monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 64)
    rng = random.Random(3)
    texts = [(i, rng.randrange(3), rng.choice([None, text(rng, rng.choice([0, 1, 5, 63, 64, 200]))])) for i in range(60)]
    quotes = []
    for k in range(200):
        source = rng.choice([t for _, _, t in texts if t])
        at = rng.randrange(len(source))
        quotes.append((k, rng.randrange(3), rng.choice([source[at : at + rng.choice([1, 2, 3, 7, 20, 64, 90, 150])], text(rng, 6), None])))
    quotes += [(900, 1, ""), (901, 1, quotes[0][2]), (901, 1, quotes[0][2])]
    t = spark.createDataFrame(texts, "id int, paper int, t string")
    q = spark.createDataFrame(quotes, "q int, paper int, s string")
    q = q if by else q.withColumnRenamed("paper", "other")
    got = anchors.containing(t, q, "t", "s", by)
    want = sorted((i, k) for i, p, x in texts for k, o, s in quotes if x is not None and s is not None and s in x and (not by or p == o))
    assert sorted((r["id"], r["q"]) for r in got.collect()) == want
    assert got.columns == (["id", "paper", "t", "q", "s"] if by else ["id", "paper", "t", "q", "other", "s"])


def test_many_quotes_are_one_scan(spark):
    quotes = spark.range(30_000).select("id", F.concat(F.lit("quote number "), F.format_string("%07d", "id"), F.lit(" of many")).alias("s"))
    texts = spark.range(40).select(F.col("id").alias("t_id"), F.concat(F.lit("before "), F.format_string("quote number %07d of many", F.col("id") * 700), F.lit(" after")).alias("t"))
    got = anchors.containing(texts, quotes, "t", "s")
    assert sorted((r["t_id"], r["id"]) for r in got.collect()) == [(i, i * 700) for i in range(40)]
    assert anchors.containing(texts, quotes.limit(0), "t", "s").count() == 0


def test_overlaps_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    squash = lambda x: "".join(x.split())
    sources = [text(rng, 300, "abcdefgh ") for _ in range(6)]
    part = lambda n: (lambda s, at: s[at : at + n])(rng.choice(sources), rng.randrange(250))
    predicted = [(rng.randrange(2), i, rng.choice([part(rng.choice([3, 20, 60, 200])), part(60) + part(60), "", None])) for i in range(60)]
    gold = [(rng.randrange(2), f"g{i}", [rng.choice([part(rng.choice([5, 39, 45, 80, 150])), text(rng, 50), " "]) for _ in range(2)]) for i in range(25)]
    got = evaluation.overlaps(spark.createDataFrame(predicted, "inspire_id int, prediction int, evidence_span string"), spark.createDataFrame(gold, "inspire_id int, gold_id string, quotes array<string>"))
    want = {}
    for p, i, span in predicted:
        for o, g, quotes in gold:
            for quote in quotes if p == o and span else []:
                a, b = squash(span), squash(quote)
                n = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
                if a and b and (n >= min(40, len(b)) or a in b):
                    want[p, i, g] = max(n, want.get((p, i, g), 0))
    assert {(r["inspire_id"], r["prediction"], r["gold_id"]): r["overlap"] for r in got.collect()} == want and len(want) > 30


def test_long_spans_meet_quotes_by_shared_passages_alone(spark, monkeypatch):
    """Whole texts are not sought in quotes, and are not moved for it; one that stands in a quote is found all the same."""
    asked, real = [], anchors.containing

    def noted(texts, quotes, text, quote, by=None):
        asked.append(quotes.agg(F.max(F.length(quote))).first()[0])
        return real(texts, quotes, text, quote, by)

    monkeypatch.setattr(anchors, "containing", noted)
    inner = "".join(chr(97 + i * 7 % 26) for i in range(40))
    rows = [(1, 0, inner), (1, 1, inner[:39]), (1, 2, inner * 50), (1, 3, "zz")]
    got = evaluation.overlaps(spark.createDataFrame(rows, "inspire_id int, prediction int, evidence_span string"), spark.createDataFrame([(1, "g", [f"before {inner}! after"])], "inspire_id int, gold_id string, quotes array<string>"))
    assert sorted((r["prediction"], r["overlap"]) for r in got.collect()) == [(0, 40), (1, 39), (2, 40)]
    assert asked == [None, 39]
