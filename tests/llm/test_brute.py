"""Decontamination and the pipeline's stages against plain Python, and odd tables for the other operators."""

import itertools
import random

import pytest
import regex

import corpus_pipeline
import public_tokenizers
from lacuna.llm import common, decontaminate, queries, token_counts, warc
from pyspark.sql import functions as F


def template_words(text):
    """(named template, blind template, plain) of each word."""
    text = regex.sub(r"([0-9])[.,]([0-9])", r"\1\2", text or "")
    text = regex.sub(r"\n+|[.!?:;|]+", " . ", text)
    text = regex.sub(r"[^\p{L}\p{M}\p{N}.]+", " ", text)
    out = []
    for word in text.split(" "):
        if word in ("", "."):
            continue
        plain = word.lower()
        blind = "#number" if regex.search("[0-9]", word) else "#unit" if plain in decontaminate.UNITS else plain
        out.append(("#name" if blind == plain and word[0] != word[0].lower() else blind, blind, plain))
    return out


def windows(words, width):
    """(key, place, slot values)"""
    for at in range(len(words) - width + 1):
        part = words[at : at + width]
        plain = tuple(w[2] for w in part)
        keys = []
        for form in (0, 1):
            slots = [w[2] for w in part if w[form].startswith("#")]
            keys.append((plain if len(slots) == width else tuple(w[form] for w in part), slots))
        (named, named_slots), (blind, blind_slots) = keys
        some = len(named_slots) < width
        if some:
            yield named, at, named_slots
        if blind != named or not some:
            yield blind, at, blind_slots


def contaminated(docs, items, rule):
    out = {}
    made = {}
    for i, text in items.items():
        words = template_words(text)
        if words:
            width = min(rule.width, len(words))
            made[i] = width, list(windows(words, width))
    for d, text in docs.items():
        words = template_words(text)
        for i, (width, own) in made.items():
            runs = {}
            for key, at, slots in windows(words, width):
                for item_key, place, item_slots in own:
                    if key == item_key:
                        places, mapped = runs.setdefault(at - place, (set(), set()))
                        places.add(place)
                        mapped.update(itertools.zip_longest(item_slots, slots))
            good, shares = set(), []
            for places, mapped in runs.values():
                values = {a for a, _ in mapped}
                share = sum(sum(a == v for a, _ in mapped) == 1 for v in values) / len(values) if values else 1.0
                if share >= rule.consistency:
                    good |= places
                    shares.append(share)
            total = len({place for _, place, _ in own})
            if good and len(good) / total >= rule.coverage:
                out[d, i] = (round(len(good) / total, 9), round(min(shares), 9))
    return out


def test_decontamination_against_plain_python(spark):
    rng = random.Random(6)
    frames = ["{n} has {x} {u} of tea and buys {y} more in {m}.", "How many {u} does {n} carry from {m} to {k}?", "If {n} and {k} share {x} coins, who keeps {y}?", "the rest is plain words without any slot at all"]
    fill = lambda: rng.choice(frames).format(n=rng.choice(["Tom", "Élodie", "Ann", "bob"]), k=rng.choice(["Zoe", "Max"]), m=rng.choice(["Rome", "Malta", "town"]), x=rng.randrange(9), y=rng.choice(["3.5", "1,000", "7"]), u=rng.choice(["kg", "Miles", "cups"]))
    items = {i: " ".join(fill() for _ in range(rng.randrange(1, 4))) for i in range(25)} | {90: "two words", 91: "", 92: None}
    docs = {}
    for d in range(120):
        parts = [fill() for _ in range(rng.randrange(0, 5))]
        if d % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), items[rng.randrange(25)])
        text = " ".join(parts)
        docs[d] = rng.choice([text, text, text.upper(), text.lower(), "only two words here" if d % 7 == 0 else text])
    docs[200] = None
    for rule in (decontaminate.Rule(), decontaminate.Rule(width=4, coverage=0.8, consistency=1.0)):
        got = decontaminate.matches(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string"), rule=rule)
        got = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 9), round(r["consistency"], 9)) for r in got.collect()}
        want = contaminated(docs, items, rule)
        assert got == want and len(want) > 30


def test_clean_keeps_rows_that_share_a_key(spark):
    item = "Today Alice bought 12 apples and 5 pears for Bob on Monday, how many has she?"
    rows = [(None, item, 1), ("", "a clean text", 2), ("k", f"x {item}", 3), ("k", "another clean text", 4), (None, "clean too", 5), (None, None, 6), ("r", item, 7), ("r", item, 8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, row_id int")
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    assert sorted(r["row_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 4, 5, 6]
    assert decontaminate.clean(docs.limit(0), items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == 8


def test_stages_take_clashing_columns(spark, tmp_path):
    names = ["quality_score", "pii", "context_pii", "row_id", "__key", "base", "kept", "row", "masked", "content", "paths", "node"]
    rows = [(i, f"plain words of document {i} that mean nothing much " * 3, "en", "s", 150 + i, *["x"] * len(names)) for i in range(12)] + [(None, None, None, None, None, *[None] * len(names)), (3, "", "en", "s", 0, *["y"] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "an item of the benchmark that nobody holds at all")], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() >= 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_stages_keep_what_their_operators_say(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    ids = lambda frame: {r["doc_id"] for r in frame.select("doc_id").collect()}

    held = {d for d, _ in contaminated({d: r["text"] for d, r in rows.items()}, items, decontaminate.Rule())}
    assert ids(stages["decontamination"](spark, docs, sf)) == set(rows) - held

    words = {d: regex.findall(r"[\p{L}\p{M}\p{N}]+", (r["text"] or "").lower()) for d, r in rows.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items() if w}
    root = {d: d for d in rows}
    find = lambda d: d if root[d] == d else find(root[d])
    for a, b in itertools.combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert ids(stages["near_duplicates"](spark, docs, sf)) == {d for d in rows if find(d) == d}

    scores = {r["doc_id"]: r["quality_score"] for r in queries.op10_quality(spark, sf).collect()}
    kept = ids(stages["quality"](spark, docs, sf))
    assert kept <= set(rows) and sum((scores[d] >= queries.QUALITY_KEPT) != (d in kept) for d in rows) <= 1


def test_token_counts_and_archives_of_odd_tables(spark, tmp_path):
    pattern, ranks = public_tokenizers.PATTERN, queries.RANKS
    none = spark.createDataFrame([], "doc_id int, text string")
    assert token_counts.count(none, ranks, pattern).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1, "x"), (1, None, 2, "y"), (1, None, 2, "y")], "doc_id int, text string, block int, words string")
    assert sorted(r["n_tokens"] for r in token_counts.count(odd, ranks, pattern, keep=("doc_id", "block", "words")).collect()) == [0, 0, 2]
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    assert warc.read(common.staged(warc.write(pages, folder), "manifest"), folder).count() == 0
    more = spark.createDataFrame([(1, "u", "<a>", "k", "p"), (2, "u", None, "k", "p")], "page_id long, url string, html string, record_id string, payload string")
    folder = f"file://{tmp_path}/warc2"
    assert warc.read(common.staged(warc.write(more, folder), "manifest"), folder).count() == 2


def test_spread_of_beginnings_keeps_the_results(spark, monkeypatch):
    from lacuna.llm import wordblocks

    docs = spark.createDataFrame([(i, f"beginning{i} beginnings beginning{i % 7}abc " * 20) for i in range(40)], "doc_id int, text string").repartition(3)
    once = sorted(map(tuple, token_counts.count(docs, queries.RANKS, public_tokenizers.PATTERN).collect()))
    monkeypatch.setattr(wordblocks, "BLOCKS_A_SPREAD", 10)
    assert sorted(map(tuple, token_counts.count(docs, queries.RANKS, public_tokenizers.PATTERN, block_chars=200).collect())) == once


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session)


def test_long_runs_are_scanned_in_linear_time(spark):
    import time

    from lacuna.llm import secrets

    rng = random.Random(1)
    runs = ["".join(rng.choices(letters, k=1_000_000)) for letters in ("0123456789abcdef", "abcdefghij+/0123", "abcdefghijABCDEFGHIJ0123456789")]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id int, text string").repartition(3).cache()
    docs.count()
    begin = time.monotonic()
    got = {r["doc_id"]: r["n"] for r in secrets.scan(docs).select("doc_id", F.size(F.concat("secrets", "entropy_secrets")).alias("n")).collect()}
    assert len(got) == 3 and time.monotonic() - begin < 60
