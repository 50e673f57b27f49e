"""Greedy steps in rounds of joins against the walk."""

import random

from lacuna.operators import matching


def items(rng, groups, n, dims=4):
    rows = []
    for g in range(groups):
        for i in range(n):
            v = [rng.gauss(0, 1) for _ in range(dims)]
            size = sum(x * x for x in v) ** 0.5
            rows.append((g, rng.choice(["a", "b"]), g * 1000 + i, rng.choice([0.1, 0.5, 0.9]), [x / size for x in v]))
    return rows


def test_merging_in_rounds_is_the_walk(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame(items(rng, 3, 60), "inspire_id int, product_type string, ordinal int, confidence double, embedding array<double>")
    for least in (0.3, 0.8):
        walked = matching.merge_duplicates(rows, similarity=least)
        rounds = matching.merge_duplicates(rows, similarity=least, walked=0)
        assert sorted(map(tuple, rounds.select("ordinal", "merged").collect())) == sorted(map(tuple, walked.select("ordinal", "merged").collect()))
        assert rounds.columns == walked.columns
    none = matching.merge_duplicates(rows, similarity=1.5, walked=0)
    assert none.count() == 180 and none.where("merged > 0").count() == 0


def test_assigning_in_rounds_is_the_walk(spark):
    rng = random.Random(4)
    pairs = list({(p, rng.randrange(12), f"r{rng.randrange(12)}"): rng.randrange(6) for p in range(3) for _ in range(90)}.items())
    pairs += [((9, i // 2, f"c{(i + 1) // 2:03}"), i) for i in range(60)]
    table = spark.createDataFrame([(*k, w) for k, w in pairs], "p int, l int, r string, w int")
    walked = matching.assign_one_to_one(table, "p", "l", "r", "w")
    for most in (0, 20):
        rounds = matching.assign_one_to_one(table, "p", "l", "r", "w", walked=most) if most else matching.assign_one_to_one(table.where("p < 9"), "p", "l", "r", "w", walked=0)
        want = walked if most else walked.where("p < 9")
        assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, want.collect()))
