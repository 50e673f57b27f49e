"""Jaccard join, decontamination and top-k search against brute force."""

import random
import re

import numpy as np
import pytest

from lacuna.llm import decontaminate, jaccard, topk
from lacuna.llm.components import components
from pyspark.sql import functions as F


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(9)) for _ in range(n)]


def corpus(seed=5):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        base = words(rng, rng.choice([3, 8, 40, 120, 300]))
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            rows.append((" ".join(copy)).upper() + "!")
    one = words(rng, 200)
    for _ in range(60):
        copy = list(one)
        copy[rng.randrange(200)] = words(rng, 1)[0]
        rows.append(" ".join(copy))
    return [*rows, "", None, " . ", "short", "short", "Short!"]


def shingles(text, width=5):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize("cell", [8, 192])
def test_jaccard_join(spark, cell):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    links = {i: {sets[j] for j in range(len(sets)) if sets[i] and sets[j] and sets[i] != sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} for i in range(len(sets))}
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                if sets[i] and (sets[i] == sets[j] or sets[j] in links[i]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in jaccard.join(docs, forest=jaccard.Forest(cell_nodes=cell)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["class_id"], got[i]["n_links"]) == (root[i], len(links[i]))
        assert got[i]["n_copies"] == (sum(s == sets[i] for s in sets) - 1 if sets[i] else 0)
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs).collect()}
    assert kept == set(root)


def test_jaccard_odd_tables(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", 0, "x"), (1, "a b c d e f", 0, "x"), (None, "other words entirely", 1, "y")], "doc_id int, text string, node int, content string")
    assert sorted((r["doc_id"] or 0, r["n_copies"]) for r in jaccard.join(rows).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert jaccard.one_of_each(rows).count() == 2
    keys = spark.createDataFrame([(None, "a b c d e f", 1), ("", "other words entirely", 2), ("k", "a b c d e f", 3), ("k", "third text here", 4), ("", None, 5), ("", None, 6)], "doc_id string, text string, row_id int")
    assert sorted(r["row_id"] for r in jaccard.one_of_each(keys).collect()) == [2, 3, 4, 5, 6]


def test_forest_depth():
    forest = jaccard.Forest()
    reach = lambda s, k: 1 - (1 - s**k) ** forest.trees
    for similarity in (0.8, 0.85, 0.9, 1.0):
        depth = forest.depth_for(similarity)
        assert reach(similarity, depth) >= forest.recall and (depth == forest.levels or reach(similarity, depth + 1) < forest.recall)


def test_paths_in_order_are_a_trie():
    forest = jaccard.Forest()
    made = jaccard.paths(np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)), forest, jaccard._borrowing(forest.trees * forest.levels))
    assert (made >> np.uint64(forest.bits * forest.levels)).tolist() == list(range(forest.trees)) and (made < 2**63).all()


def near(base, shared):
    """A text of 5-word shingles of which about a share is base's: the words from some place on are others."""
    cut = int(len(base) * 2 * shared / (1 + shared))
    return base[len(base) - cut :] + [f"w{random.random()}" for _ in range(len(base) - cut)]


def test_recall_by_size_of_the_sets(spark):
    random.seed(4)
    rows, pairs = [], 0
    for size in (4, 8, 20, 60, 200):
        for _ in range(60):
            base = [f"v{random.random()}" for _ in range(size + 4)]
            changed = [*base, "one"] if size < 12 else [*base[:-1], *[f"x{random.random()}" for _ in range(max(1, size // 12))]]
            if 10 * len(shingles(" ".join(base)) & shingles(" ".join(changed))) >= 8 * len(shingles(" ".join(base)) | shingles(" ".join(changed))):
                pairs += 1
            rows += [" ".join(base), " ".join(changed)]
    got = jaccard.join(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")).where("n_links > 0").count()
    assert pairs > 200 and got >= 2 * 0.99 * pairs


def test_chains_of_half_alike_texts_do_not_cost_their_square(spark):
    random.seed(5)
    text, rows = [f"v{random.random()}" for _ in range(64)], []
    for i in range(400):
        rows.append((i, text))
        text = near(text, 0.5)
    forest = jaccard.Forest(cell_nodes=8)
    borrow = jaccard._borrowing(forest.trees * forest.levels)
    hashes = lambda t: np.sort(np.array([hash(tuple(t[k : k + 5])) for k in range(len(t) - 4)], np.int64).view(np.uint64))
    made = [(i, int(p), i // 8) for i, t in rows for p in jaccard.paths(jaccard.mix(hashes(t)), forest, borrow).view(np.int64)]
    floor = forest.depth_for(forest.threshold)
    trie = spark.createDataFrame(made, "node long, path long, cell long")
    for n in (100, 400):
        looked = jaccard.tasks(trie.where(F.col("node") < n), forest, floor, None).count()
        assert looked <= 4 * n


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {k: v for k, v in root.items() if k in {x for a, b in edges if a != b for x in (a, b)}}


def test_components_that_are_stars_already_take_no_round(spark, monkeypatch):
    """Each round is a dozen stages, all of which the driver keeps track of; none is needed to see that nothing is left to do."""
    from lacuna.llm import components as module

    written = []
    real = module.staged
    monkeypatch.setattr(module, "staged", lambda df, name, **more: written.append(name) or real(df, name, **more))
    stars = [(1, x) for x in range(2, 9)] + [(x, 20) for x in range(21, 25)]
    got = sorted(map(tuple, components(spark.createDataFrame(stars, "u long, v long")).collect()))
    assert got == [(x, 1) for x in range(1, 9)] + [(x, 20) for x in range(20, 25)]
    assert written == ["edges", "large-least"]
    # A star whose centre is not its least node takes one round.
    written.clear()
    assert sorted(map(tuple, components(spark.createDataFrame([(5, x) for x in (3, 4, 6, 7)], "u long, v long")).collect())) == [(x, 3) for x in range(3, 8)]
    assert written.count("stars") == 1
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_decontamination(spark):
    item = "Today Alice bought 12 apples and 5 pears for Bob on Monday, how many kg of fruit does Alice have now?"
    changed = "Today Carol bought 99 apples and 7 pears for Dan on Friday, how many miles of fruit does Carol have now?"
    mixed = "Today Carol bought 99 apples and 7 pears for Dan on Friday, how many miles of fruit does Erna have now?"
    docs = [(1, f"Before it. {item} After it."), (2, f"Before. {changed}"), (3, "Nothing of the kind is in this text at all, it only talks about apples and pears and Monday."), (4, None), (5, ""), (6, f"{item}\n{changed}"), (7, f"x {item[:40]} y"), (8, mixed), (8, mixed)]
    table = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item", F.lit("clash"))
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "three short words")], "item_id int, text string")
    strict = decontaminate.Rule(consistency=0.95)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(table, items, rule=strict).collect()) == [(1, 1), (2, 1), (6, 1)]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(table, items).collect()) == [(1, 1), (2, 1), (6, 1), (8, 1)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(table, items).collect()) == [3, 4, 5, 7]
    assert decontaminate.matches(table, items.limit(0)).count() == 0
    assert decontaminate.matches(spark.createDataFrame([(1, "so three short words here")], "doc_id int, text string"), items).first()["item_id"] == 4


def test_topk(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.random()]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [0.1, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [0.5]), (205, []), (None, [1.0] * 6), rows[50], rows[51]]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    good = {k: [int((256 * v).__floor__()) for v in vec] for k, vec in rows if k is not None and vec is not None and all(v is not None and abs(v) < 1e30 for v in vec)}
    floats = {r["vec_id"]: r["embedding"] for r in table.collect()}
    good = {k: [int((256 * v).__floor__()) for v in floats[k]] for k in good}
    want = []
    for q in good:
        if q % 50 == 0:
            ranked = sorted(((-sum(a * b for a, b in zip(good[q], v)), k) for k, v in good.items() if k != q))[:5]
            want += [(q, n, k, -s) for n, (s, k) in enumerate(ranked, 1)]
    vectors = topk.quantised(table, "vec_id", "embedding")
    for blocks in ({}, {"query_block": 2, "candidate_block": 17}):
        got = topk.search(vectors.where("key % 50 = 0"), vectors, **blocks)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    few = vectors.where("key < 3")
    assert topk.search(few.where("key = 0"), few).count() == 2
    assert topk.search(few.limit(0), few).count() == 0


def test_decontamination_whatever_the_place_and_case_of_names(spark):
    item = "Tom has 5 apples. Tom eats 2 apples. How many apples are left?"
    rich = "Élodie met X and BOB in Rome, then Élodie paid Bob 30 coins for the boat to Malta."
    docs = [(1, "Anna has 7 apples. Anna eats 3 apples. How many apples are left?"), (2, item.upper()), (3, item.lower()), (4, rich.upper()), (5, rich.lower()), (6, rich.replace("Élodie", "Agnes")), (7, "Tom ate 5 pears. Ann has 2 plums. How many plums did Tom get?"), (8, "Anna has 7 apples. Erna eats 3 apples. How many apples are left?")]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, item), (2, rich)], "item_id int, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2)]
