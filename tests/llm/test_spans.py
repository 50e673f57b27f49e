"""Secret scans and personal data against the plain patterns in Python."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import pii, secrets
from lacuna.llm.spans import spans

HARD = [
    None, "", " ", "no match", 'token="abcdef"', "TOKEN: x secret:token:abcdef", "password = 'pass=word=123456'", "api_key=abc", "AKIA" + "A1" * 10 + " AKIAAKIA123", "f" * 24 + " " + "0" * 23, "é\U0001f600 token=abcdef12 é",
    "a@b.c@d.e a.b+c@x-y.z.w _y@d.e a@b", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (132) 555-1352 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8", "1" * 3000, "a." * 3000 + "@" + "b." * 3000 + "c", "token=x" * 2000,
]


def base_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_pii(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return out


def run(spark, texts, operator, column):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r["doc_id"]: [tuple(s) for s in r[column]] for r in operator(docs).collect()}


def test_secrets(spark):
    got = run(spark, HARD, secrets.scan, "secrets")
    assert all(got[i] == base_secrets(t) for i, t in enumerate(HARD))


def test_pii(spark):
    got = run(spark, HARD, pii.find, "pii")
    assert all(got[i] == base_pii(t) for i, t in enumerate(HARD))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("tokenTOKEN=:'\" \n0123456789abcdef.@+-()AKIé", max_size=60), min_size=100, max_size=200))
def test_random_texts(spark, texts):
    got = run(spark, texts, secrets.scan, "secrets")
    assert all(got[i] == base_secrets(t) for i, t in enumerate(texts))
    got = run(spark, texts, pii.find, "pii")
    assert all(got[i] == base_pii(t) for i, t in enumerate(texts))


def test_many_spans(spark):
    text = "ab " * 1000 + "é"
    got = spark.createDataFrame([(text,)], "text string").select(spans(F.col("text"), "ab").alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in got] == [(3 * i, 3 * i + 2) for i in range(1000)]


def entropy(window):
    from math import log2

    return -sum(n / len(window) * log2(n / len(window)) for n in (window.count(c) for c in set(window)))


def test_entropy_windows(spark):
    key = "9f8a7c6d5e4b3a2f1e0d"
    texts = ["0" * 30 + key + "1" * 30, "A1b2C3d4E5f6G7h8I9j0", "example" + "A1b2C3d4E5f6G7h8I9j0", "thisisalongwordwithoutanydigits", "aA1" * 10, "x" * 100 + "A1b2C3d4E5f6G7h8I9j0"]
    options = secrets.Entropy()
    got = run(spark, texts, secrets.scan, "entropy_secrets")
    kinds = secrets.kinds(options)
    for i, t in enumerate(texts):
        want = []
        for kind in options.classes:
            for m in re.finditer(kind.run.replace("}+", "}"), t):
                if any(re.search(p, m[0]) for p in options.allowed) or (kind.must and not re.search(kind.must, m[0])):
                    continue
                hot = [k for k in range(len(m[0]) - 19) if entropy(m[0][k : k + 20]) >= kind.bits]
                if hot:
                    want.append((m.start() + hot[0], kinds.index(kind.name), m.start() + hot[-1] + 20))
        assert got[i] == sorted(want)
    allowed = secrets.Entropy(allowed_values=(texts[1],))
    assert not run(spark, texts[1:2], lambda d: secrets.scan(d, options=allowed), "entropy_secrets")[0]


def test_context_discovers_identifiers(spark):
    known = [f"mail of customer id4{i}711 is u{i}@example.com today" for i in range(6)]
    seeds = [f"customer number 411111111111111{d} ends" for d in range(10)]
    unseen = ["customer number AB-99812-77 ends", "a plain 99812377 thing"]
    got = run(spark, known + seeds * 3 + unseen, lambda d: pii.find(d, options=pii.Bootstrap(confidence=0.05, support=1)), "context_pii")
    text = unseen[0]
    assert [text[a:b] for a, _, b in got[len(known) + 30]] == ["AB-99812-77"]
    assert got[len(known) + 31] == []


def test_redact(spark):
    docs = spark.createDataFrame([("mail a@b.cd or +1 (132) 555-1352!",), ("nothing",), ("",)], "text string")
    found = pii.find(docs)
    got = [r["t"] for r in found.select(pii.redact(F.col("text"), F.array_sort(F.concat("pii", "context_pii"))).alias("t")).collect()]
    assert sorted(got) == ["", "mail [EMAIL] or [PHONE]!", "nothing"]


@pytest.mark.parametrize("operator", [secrets.scan, pii.find])
def test_empty_and_extra_columns(spark, operator):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert operator(none).count() == 0
    odd = spark.createDataFrame([(None, "x a@b.cd", "k", 1.0)] * 2, "doc_id int, text string, start string, `end` double")
    assert operator(odd).count() == 2


def test_every_base_kind_induces_patterns(spark):
    known = {
        "email": [f"reach them under kata{i}@example.org any time" for i in range(8)],
        "ip": [f"logged in from 10.0.{i}.7 at noon" for i in range(8)],
        "card": [f"charged to card {c} yesterday evening" for c in [f"4111 1111 1111 {d:04}" for d in range(100)] if luhn(c.replace(" ", ""))][:8],
        "phone": [f"please call back +1 (415) 555-01{i}3 before five" for i in range(8)],
    }
    unseen = {
        "email": ("reach them under john at example dot com any time", "john at example dot com"), "ip": ("logged in from ws-" + "a" * 80 + "-7 at noon", "ws-" + "a" * 80 + "-7"),
        "card": ("charged to card XK-77 yesterday evening", "XK-77"), "phone": ("please call back 476 555 6291 before five", "476 555 6291"),
    }
    texts = [t for kind in known.values() for t in kind]
    got = run(spark, [*texts, *(t for t, _ in unseen.values()), "nobody will call or charge them for this", "\ue041 in \ue055 under"], pii.find, "context_pii")
    for i, (text, want) in enumerate(unseen.values(), len(texts)):
        assert [text[a:b] for a, _, b in got[i]] == [want]
    assert not any(got[i] for i in [*range(len(texts)), len(texts) + 4, len(texts) + 5])


def test_redact_removes_the_union_of_overlapping_spans(spark):
    texts = ["at 10.0.0.0 4111 1111 1111 1111 x", "or +1 (415) 555-0123@mail.example.com y", "a@b.cd 1.2.3.4"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = {r["doc_id"]: r["t"] for r in found.select("doc_id", pii.redact(F.col("text"), F.array_sort(F.concat("pii", "context_pii"))).alias("t")).collect()}
    assert got == {0: "at [IP] x", 1: "or [PHONE] y", 2: "[EMAIL] [IP]"}


def test_entropy_of_keys_in_one_case(spark):
    key = "3ax6xnjp29jd6fds4gc373sgvjxteol0"
    texts = [f"key-{key} end", f"key-{key.upper()} end", "internationalisationcommittee2024", "9" * 12 + "internationalisation"]
    got = run(spark, texts, secrets.scan, "entropy_secrets")
    kinds = secrets.kinds(secrets.Entropy())
    for i, name in enumerate(("entropy_lower", "entropy_upper")):
        ((start, end),) = [(a, b) for a, rank, b in got[i] if kinds[rank] == name]
        assert start <= 6 and end >= 34
    assert got[2] == got[3] == []


def bootstrap_model(masked_texts, options):
    """The rounds in plain Python: (text, first character, last character) of what stands in trusted patterns and is no seed."""
    import regex

    seed = lambda u: pii._HIDDEN[0] <= u[0] <= chr(pii.HIDDEN + 127)
    slots = []
    for t, text in enumerate(masked_texts):
        units = [(m.start(), m.end(), m.group()) for m in regex.finditer(pii.UNIT, text.lower())]
        plain = [pii._HIDDEN[0] if seed(u) else regex.sub("[0-9]+", "0", u) for _, _, u in units]
        for i in range(len(units)):
            alone, framed = [], []
            if i > 1:
                alone.append(("2", plain[i - 2], plain[i - 1]))
            if i:
                alone.append(("1", plain[i - 1]))
            if i + 1 < len(units):
                alone.append(("a", plain[i + 1]))
            for k in range(1, pii.GROUP + 1):
                if i and i + k < len(units) and plain[i + k] not in plain[i + 1 : i + k] and (k == 1 or not any(seed(u) for _, _, u in units[i : i + k])):
                    framed.append((k, ("f", plain[i - 1], plain[i + k]), " ".join(u for _, _, u in units[i : i + k])))
            slots.append((t, units[i], alone, framed, units[i : i + pii.GROUP]))
    known, trusted = {}, {}
    for u in {s[1][2] for s in slots if seed(s[1][2])}:
        known[u] = 1.0
    for left in reversed(range(options.rounds)):
        told, instances = {}, {}
        for _, (_, _, u), alone, framed, _ in slots:
            for p, name, k in [*((p, u, 1) for p in alone), *((p, name, k) for k, p, name in framed)]:
                instances.setdefault(p, set()).add((name, k))
                if k == 1 and u in known:
                    told.setdefault(p, set()).add(u)
        sure = {p: sum(known[u] for u in us) / (len(instances[p]) + options.doubt) for p, us in told.items() if len(us) >= options.support}
        new, trusted = trusted, {p: c for p, c in sure.items() if c >= options.confidence}
        if not left or new == trusted:
            break
        for p, c in trusted.items():
            for name, k in instances[p]:
                if k == 1 and not seed(name):
                    known[name] = 0.0
        for name in [n for n in known if not seed(n)]:
            rest = 1.0
            for p, c in trusted.items():
                if (name, 1) in instances[p]:
                    rest *= 1 - min(c, 0.999)
            known[name] = 1 - rest
    out = set()
    for t, (start, end, u), alone, framed, following in slots:
        if any(p in trusted for p in alone) and not seed(u):
            out.add((t, start, end))
        for k, p, _ in framed:
            if p in trusted and not seed(u):
                out.add((t, start, following[k - 1][1]))
    return out


def test_bootstrap_against_a_plain_model(spark):
    import random

    rng = random.Random(11)
    frames = ["call {} now", "mail to {} please", "ticket of {} was closed", "the {} of it", "reach {} at once", "we saw {} and left"]
    values = [f"u{i}@ex.org" for i in range(6)] + [f"10.0.0.{i}" for i in range(6)] + [f"AB-{i}{i}7" for i in range(5)] + ["house", "john at work", "12 34 56"]
    weights = [[1 if (f + v) % 3 else 0.02 for v in range(len(values))] for f in range(len(frames))]
    texts = [" . ".join(frames[f].format(rng.choices(values, weights[f])[0]) for f in rng.choices(range(len(frames)), k=rng.randrange(1, 6))) for _ in range(250)]
    for options in (pii.Bootstrap(), pii.Bootstrap(confidence=0.55, support=2, rounds=4), pii.Bootstrap(confidence=0.3, support=2, rounds=2)):
        docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("base", pii.base_spans(F.col("text")))
        docs = docs.select("row", "base", pii.masked(F.col("text"), F.col("base")).alias("masked"))
        masked = {r["row"]: r["masked"] for r in docs.collect()}
        units = docs.select("row", spans(F.col("masked"), pii.UNIT).alias("units"))
        hits = pii.bootstrap(docs, options).distinct().join(units, "row")
        got = {(r["row"], r["start"], r["end"]) for r in hits.select("row", F.col("units")[F.col("place")]["start"].alias("start"), F.col("units")[F.col("place") + F.col("size") - 1]["end"].alias("end")).collect()}
        want = bootstrap_model([masked[i] for i in range(len(texts))], options)
        assert got == want and (want or options == pii.Bootstrap())


def test_finds_make_further_patterns(spark):
    known = [f"signed in as u{i}@ex.org this morning" for i in range(8)]
    found = [f"signed in as KD-{c}x7 this morning" for c in "pq"]
    # The ids stand in a context that no seed has, where they are enough to tell it.
    further = [f"badge holder KD-{c}x7 entered" for c in "pq"] + [f"badge holder {u} entered" for u in ("u0@ex.org", "KD-zz9")] + ["badge holder u1@ex.org entered", "badge holder u2@ex.org entered"]
    texts = known + found + further
    one = run(spark, texts, lambda d: pii.find(d, options=pii.Bootstrap(rounds=1, confidence=0.75)), "context_pii")
    more = run(spark, texts, lambda d: pii.find(d, options=pii.Bootstrap(confidence=0.75)), "context_pii")
    at = texts.index("badge holder KD-zz9 entered")
    assert one[at] == [] and [texts[at][a:b] for a, _, b in more[at]] == ["KD-zz9"]


def test_precision_and_recall_of_discovery(spark):
    """With the default options: ids that no fixed pattern finds, in contexts of ids that one does; look-alikes in other contexts are left alone."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=4)) + rng.choice(["a", "o", "e"])
    contexts = [("their mail is", "if needed"), ("phoned us from", "on monday"), ("paid with card", "in full"), ("connected through", "that night")]
    seeds = [lambda i: f"{word()}{i}@mail.example", lambda i: f"+1 (415) 555-{i:04}", lambda i: next(c for d in range(10) if luhn((c := f"4111 1111 1{i:03} 111{d}").replace(" ", ""))), lambda i: f"10.1.{i % 250}.{i // 250}"]
    texts, want = [], []
    for i in range(600):
        k = i % 4
        before, after = contexts[k]
        noise = " ".join(word() for _ in range(rng.randrange(3, 12)))
        if i % 10 == 0:
            value = rng.choice([f"{word()} at {word()} dot org", f"{rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}", f"ID{rng.randrange(10**6)}"])
            want.append((len(texts), value))
        else:
            value = seeds[k](i)
        texts.append(f"{noise} {before} {value} {after} {' '.join(word() for _ in range(5))}")
        texts.append(f"{noise} order ID{rng.randrange(10**6)} shipped {rng.randrange(100, 999)} {word()} at {word()} today")
    got = {(i, texts[i][a:b]) for i, spans_ in run(spark, texts, pii.find, "context_pii").items() for a, _, b in spans_}
    right = len(got & set(want))
    assert right / len(want) >= 0.95 and right / max(1, len(got)) >= 0.9


def test_fillers_are_cut_out_of_candidates(spark):
    key, hexa = "A1b2C3d4E5f6G7h8I9j0", "9f8a7c6d5e4b3a2f1e0d"
    texts = ["example" + key, "x" * 100 + key + "AAAAAAAAAA" + key[::-1], f"{key}/example/{hexa}", "0" * 30 + hexa, "example " * 4, "abcdefgh0123456789abcdefgh", "short " + key[:10] + "example" + key[10:]]
    options = secrets.BY_WINDOW
    got = run(spark, texts, lambda d: secrets.scan(d, options=options), "entropy_secrets")
    kinds = secrets.kinds(options)
    for i, t in enumerate(texts):
        cut = t
        for pattern, length in options.cut_out:
            cut = re.sub(pattern, "\0" * length, cut)
        want = []
        for kind in options.classes:
            for m in re.finditer(kind.run, cut):
                if not kind.must or re.search(kind.must, m[0]):
                    value = m[0].lower() if kind.alphabet == kind.alphabet.lower() else m[0]
                    hot = [k for k in range(len(value) - 19) if entropy(value[k : k + 20]) >= kind.bits]
                    if hot:
                        want.append((m.start() + hot[0], kinds.index(kind.name), m.start() + hot[-1] + 20))
        assert got[i] == sorted(want)
    assert [bool(got[i]) for i in range(len(texts))] == [True, True, True, True, False, False, False]


def plain_redact(text, found):
    out, at = [], 0
    for start, rank, end in found:
        out.append(text[at:start] if start > at else "")
        out.append(f"[{pii.KINDS[rank].upper()}]" if start >= at else "")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_redact_of_any_spans_in_long_texts(spark):
    rng = random.Random(11)
    rows = []
    for n in (0, 1, 5, 1023, 1024, 1025, 2048, 5000):
        text = "".join(rng.choice("ab é\n𝄞") for _ in range(n))
        found = sorted((a, rng.randrange(4), rng.randrange(a + 1, min(n, a + rng.choice([3, 40, 1500])) + 1)) for a in (rng.randrange(n) for _ in range(rng.choice([0, 1, 300]) if n else 0)))
        rows += [(text, found), (text, [(0, 1, n)] if n else [])]
    table = spark.createDataFrame(rows, "text string, found array<struct<start:int,rank:int,end:int>>")
    got = [r["t"] for r in table.select(pii.redact(F.col("text"), F.col("found")).alias("t")).collect()]
    assert got == [plain_redact(t, f) for t, f in rows]


def test_finds_of_one_text_do_not_cost_their_square(spark):
    text = " ".join(f"name{i}.surname@host{i % 97}.example.org" for i in range(30_000))
    table = spark.createDataFrame([(text,)], "text string").select("text", pii.base_spans(F.col("text")).alias("base"))
    began = time.perf_counter()
    row = table.select(F.size("base").alias("n"), pii.masked(F.col("text"), F.col("base")).alias("masked"), pii.redact(F.col("text"), F.col("base")).alias("redacted")).first()
    assert time.perf_counter() - began < 90
    assert row["n"] == 30_000 and row["redacted"] == " ".join(["[EMAIL]"] * 30_000) and len(row["masked"]) == len(text)
