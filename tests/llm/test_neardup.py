"""Near duplicates against brute force, signatures against the plain algorithm."""

import random
import re
from itertools import pairwise

import numpy as np
import pytest

from lacuna.llm import neardup, stars, superminhash
from lacuna.llm.textvec import mix


def plain_signature(elements, places):
    """An element after the other, a step after the other, to the end."""
    best = [None] * places
    for x in elements:
        order = list(range(places))
        for step in range(places):
            swap, rank = superminhash.draws(np.array([x], np.uint64), step, places)
            order[step], order[swap[0]] = order[swap[0]], order[step]
            found = (step, int(rank[0]))
            if best[order[step]] is None or found < best[order[step]]:
                best[order[step]] = found
    return [rank for _, rank in best]


def test_signatures_are_those_of_the_plain_algorithm(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(mix(rng.integers(0, 2**62, n).astype(np.uint64))) for n in (1, 2, 7, 30, 200)]
    monkeypatch.setattr(superminhash, "AT_ONCE", 40)
    assert superminhash.signatures(sets, 24).tolist() == [plain_signature(s.tolist(), 24) for s in sets]


@pytest.mark.parametrize("size", [4, 20, 300])
def test_signatures_estimate_with_less_variance(size):
    rng, places, errors = np.random.default_rng(size), 240, []
    same = int(size * 0.8)
    for _ in range(150):
        union = mix(rng.integers(0, 2**62, size).astype(np.uint64))
        rest = size - same
        a, b = np.delete(union, np.arange(rest // 2)), np.delete(union, size - 1 - np.arange(rest - rest // 2))
        signed = superminhash.signatures([a, b], places)
        errors.append((signed[0] == signed[1]).mean() - same / size)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 1.15 * 0.8 * 0.2 / places * (0.75 if size < places else 1)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(pairwise(words)) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(s), least.get(find(i)), key == least.get(find(i))) for i, ((key, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words, docs = [f"w{i}" for i in range(400)], []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 12, 60, 300]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 15])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = rng.choice([" ", "\t", "\n"]).join(copy)
            docs.append(rng.choice([text, text.upper(), f" {text}\x0b"]))
    hub = [rng.choice(words) for _ in range(60)]
    for _ in range(150):
        copy = list(hub)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            copy[at] = rng.choice(words)
        docs.append(" ".join(copy))
    chain = [rng.choice(words) for _ in range(80)]
    for _ in range(60):
        chain = [*chain[rng.choice([4, 6, 12]) :], *[rng.choice(words) for _ in range(rng.choice([4, 6, 12]))]]
        docs.append(" ".join(chain))
    docs += ["", None, " \t", "one", "ONE", "one one", "Ärger x y", "ärger x y", "a b c", "a b c"]
    rng.shuffle(docs)
    rows = [(rng.choice([i, i, i, i, None]), t) for i, t in enumerate(docs)]
    return [*rows, rows[0], rows[0], (5, docs[9])]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(stars, "ROOM", 5000)
    monkeypatch.setattr(stars, "BLOCK", 16)
    for seed in (1, 2):
        docs = corpus(seed)
        table = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id int, text string, node int, bucket string")
        got = neardup.near_duplicates(table)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_empty_tables(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = neardup.near_duplicates(spark.createDataFrame([(2, None), (2, "")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in none] == [(2, 0, 2, True)] * 2


def test_stars_lose_no_link_and_cost_no_square(spark, monkeypatch):
    """Buckets of unlinked sets, of two groups that one link joins, and a large group of near copies."""
    rng = random.Random(8)
    sets, rows = {}, []

    def add(elements, *buckets):
        sets[len(sets)] = np.unique(mix(np.array(sorted(elements), np.uint64)))
        rows.extend((b, len(sets) - 1) for b in buckets)

    for _ in range(30):
        add({rng.randrange(10**6) for _ in range(20)}, 1)
    for k in range(20):
        add({*range(100), 1000 + k}, 2)
    for k in range(20):
        add({*range(12, 112), 2000 + k}, 2)
    add({*range(5, 106)}, 2)
    for k in range(400):
        add({*range(5000, 5100), 6000 + k}, 3, 4, 5)
    counted = {"compared": [], "tiled": []}

    def counting(name):
        real = getattr(stars, name)

        def call(rows, *rest):
            counted[name].append(rows.count())
            return real(rows, *rest)

        return call

    for name in counted:
        monkeypatch.setattr(stars, name, counting(name))
    monkeypatch.setattr(stars, "BLOCK", 8)
    least = {b: min(n for x, n in rows if x == b) for b, _ in rows}
    met = spark.createDataFrame([(b, n, least[b]) for b, n in rows], "bucket long, node long, head long")
    table = spark.createDataFrame([(n, len(s), s.tobytes()) for n, s in sets.items()], "node long, size long, shingles binary")
    classes, weakest = stars.united(met, table, 0.8)
    got = dict(map(tuple, classes.collect()))
    root = {n: n for n in sets}
    for a, s in sets.items():
        for b in range(a):
            t = sets[b]
            common = len(np.intersect1d(s, t))
            if {x for x, n in rows if n == a} & {x for x, n in rows if n == b} and common >= 0.8 * (len(s) + len(t) - common):
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
    assert got == {n: r for n, r in root.items() if sum(r == q for q in root.values()) > 1}
    assert 0.8 <= weakest < 0.99
    # Members of the first two buckets alone are compared with each other: the near copies are in one class by then.
    assert counted["compared"] == [29 + 40 + 399] and counted["tiled"] == [30 + 41]


def test_a_bucket_sends_no_set_to_tiles_that_was_compared_already(spark, monkeypatch):
    """A head is not compared again, a bucket of two is done by its head, and a set goes to a tile once."""
    rng = np.random.default_rng(7)
    base = {n: np.unique(rng.integers(0, 2**63, 100).astype(np.uint64)) for n in (0, 2, 5)}
    sets = {0: base[0], 1: base[5], 2: base[2], 3: base[2][:95], 4: base[5][:90], 5: base[5]}
    # The bucket of three holds a link that its head has no part in; that of two holds none.
    rows = [(10, 0, 0), (10, 2, 0), (10, 3, 0), (11, 0, 0), (11, 1, 0), (12, 1, 1), (12, 4, 1), (12, 5, 1), (13, 2, 2), (13, 4, 2)]
    met = spark.createDataFrame(rows, "bucket long, node long, head long")
    table = spark.createDataFrame([(n, len(s), bytearray(s.tobytes())) for n, s in sets.items()], "node long, size long, shingles binary")
    placed, sent = [], []
    tiled, group_by = stars.tiled, type(met).groupBy

    def counted(df, *args):
        if args == ("bucket", "a", "b"):
            sent.extend(map(tuple, df.select("bucket", "node").collect()))
        return group_by(df, *args)

    def noted(df, *args):
        placed.extend(r["bucket"] for r in df.collect())
        monkeypatch.setattr(type(df), "groupBy", counted)
        return tiled(df, *args)

    monkeypatch.setattr(stars, "tiled", noted)
    classes, _ = stars.united(met, table, 0.8)
    assert dict(map(tuple, classes.collect())) == {1: 1, 4: 1, 5: 1, 2: 2, 3: 2}
    assert set(placed) == {10} and sorted(sent) == [(10, 2), (10, 3)]
