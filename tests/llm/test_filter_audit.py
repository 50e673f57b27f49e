"""The filter audit against plain Python."""

import random
import re
from itertools import permutations

from lacuna.llm import filter_audit


def fails(docs):
    out = []
    for doc_id, text, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any((t or "") == text and d is not None and d < doc_id for d, t, *_ in docs),
        })
    return out


def brute(docs, labels):
    failed, want = fails(docs), {}
    good = [any(None is not d == x[0] and q == 1 for d, q, _ in labels) for x in docs]
    toxic = [any(None is not d == x[0] and t == 1 for d, _, t in labels) for x in docs]
    for part in {s or "" for _, _, s in docs}:
        own = [i for i, x in enumerate(docs) if (x[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if failed[i][letter]]
                left = [i for i in left if not failed[i][letter]]
                total[letter] += len(gone)
                want[part, order, step] = [
                    len(left), len(gone), sum(failed[i][letter] and any(failed[i][x] for x in order[: step - 1]) for i in own),
                    sum(failed[i][letter] and sum(failed[i].values()) == 1 for i in own), sum(good[i] for i in gone), sum(toxic[i] for i in gone),
                ]
        for (p, order, step), row in want.items():
            if p == part:
                row.append(total[order[step - 1]])
    return want


def test_audit(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["ÄÖ", "Ünder"]
    docs = []
    for i in range(120):
        n = rng.choice([0, 1, 49, 50, 51, 80])
        text = rng.choice([" ", "\t", "\n", "\x0b", "  "]).join(rng.choice(words[: rng.choice([5, 62])]) for _ in range(n)) if rng.random() < 0.5 else " ".join(f"x{k}" for k in range(n))
        text = rng.choice(["", " ", "　"]) + text + rng.choice(["", "", " A", "AB CD EF GH", "$", "|", "Ä"])
        docs.append((rng.choice([i, i, i, 3, None]), rng.choice([text, text, text, None]), rng.choice(["a", "b", "", None])))
    docs += [docs[5], docs[6], (900, docs[7][1], "hot"), (901, "ABC" * 40_000 + " x" * 40_000, "hot")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 0, "clash") for d in docs], "doc_id int, text string, source string, mask int, part string")
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()} == brute(docs, labels)


def test_empty_tables_and_many_parts(spark, monkeypatch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(empty, labels).count() == 0
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", 3)
    docs = [(i, f"text {i % 7}", f"part{i % 11}") for i in range(60)]
    got = filter_audit.audit(spark.createDataFrame(docs, empty.schema), labels).collect()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == brute(docs, [])
