"""The trie of conversations against plain Python, and running values over many tasks."""

import hashlib
import random
import re
import zlib

from lacuna.llm import ordered, prefix_trie


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    convs = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = convs.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + own[h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in nodes}
    below = {n: [0, 0] for n in nodes}
    children = dict.fromkeys(nodes, 0)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            below[n[:d]][0] += children[n] == 0
            below[n[:d]][1] += (len(members) - 1) * words[n]
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], *below[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n=150, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            text = rng.choice(["", " ", "a b", "a\tb\x0bc　d"]) if rng.random() < 0.2 else f"t{rng.randrange(texts)} x"
            rows.append((c, turn, rng.choice(["u", "u", None]), rng.choice([text, text, text, None])))
    rows += [(7, None, "u", "first"), (7, None, "u", "other"), (7, 1, "u", "tie"), (7, 1, "v", "tie"), (7, 1, "v", "tie"), (None, 0, "u", "x"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACKED", 3)
    long = [(1000 + i % 3, t, "u", f"turn {t}") for i in range(3) for t in range(300)]
    copies = [(c, 0, "u", "t0 x") for c in range(2000, 2300)]
    for seed in (1, 2):
        rows = random_rows(seed) + (long + copies if seed == 1 else [])
        table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id int, turn int, role string, text string, depth int, s1 int")
        got = prefix_trie.trie(table)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_running_values_over_tasks(spark):
    """One group is most of the rows and lies in many tasks."""
    rng = random.Random(5)
    rows = [(1 if i % 10 else rng.randrange(40), i, rng.randrange(-(2**63), 2**63), rng.randrange(9), rng.choice([None, None, i])) for i in range(3000)]
    table = spark.createDataFrame(rows, "g long, i int, x long, n long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = ordered.running(table, ["g"], ["i"], {"sums": ("sum", "n"), "bits": ("xor", "x"), "latest": ("last", "v")}, "test-running").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, state = {}, {}
    for g, i, x, n, v in sorted(rows):
        sums, bits, latest = state.get(g, (0, 0, None))
        state[g] = sums + n, bits ^ x, latest if v is None else v
        want[g, i] = state[g]
    last = {g: i for g, i in sorted(want)}
    assert {(r["g"], r["i"]): (r["sums"], r["bits"], r["latest"]) for r in got} == want and len(got) == len(rows)
    assert {(r["g"], r["i"]) for r in got if r["is_end"]} == set(last.items())
