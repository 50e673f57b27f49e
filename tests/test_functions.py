"""Functions and operators on small tables made here."""

import hashlib
import html
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lacuna.functions import scalars, text, vectors
from lacuna.operators import evaluation, matching, pages, passages, relations, search


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert str(one(spark, scalars.partial_date(F.lit("2021")), a=1)) == "2021-01-01"
    assert str(one(spark, scalars.partial_date(F.lit("2021-07")), a=1)) == "2021-07-01"
    with pytest.raises(Exception, match="not a date"):
        one(spark, scalars.partial_date(F.lit("2021-07-01-02")), a=1)
    assert one(spark, scalars.fingerprint(F.lit("a"), F.lit("b"), F.lit("c")), a=1) == hashlib.sha256(b"a\0b\0c").hexdigest()
    assert one(spark, scalars.reduction_ratio(F.lit(5.0), F.lit(0)), a=1) == float("inf")
    assert one(spark, scalars.collapse(F.lit("\u00a0a \u2003b\n")), a=1) == "a b"
    assert one(spark, scalars.percent_text(F.lit(None).cast("double")), a=1) == "n/a"
    assert one(spark, scalars.python_round4(F.lit(0.12345)), a=1) == round(0.12345, 4)
    assert one(spark, scalars.quoted_title(F.lit('"Table 1" of "A paper"')), a=1).asDict() == {"part": "Table 1", "paper": "A paper"}
    for kind, status, confidence, want in [("likelihood", "missing", 0.9, 3), ("likelihood", "uncertain", 0.4, 1), ("other", "published", 0.9, 0), ("new", "missing", 0.9, 1)]:
        assert one(spark, scalars.severity(scalars.type_weight(F.lit(kind)), F.lit(status), F.lit(confidence)), a=1) == want


def test_gap_status(spark):
    match = lambda s, o, c: F.struct(F.lit(s).alias("similarity"), F.lit(o).alias("overlap"), F.lit(c).alias("score"))
    none = F.when(F.lit(False), match(0.0, 0.0, 0.0))
    cases = [
        (False, False, match(0.9, 0.9, 0.9), none, "no_record"), (False, True, none, none, "missing"), (False, True, match(0.1, 0.6, 0.3), none, "published"),
        (True, True, match(0.1, 0.1, 0.1), match(0.5, 0.0, 0.3), "published"), (True, True, match(0.1, 0.1, 0.1), match(0.4, 0.0, 0.3), "uncertain"),
        (False, True, match(0.4, 0.4, 0.42), none, "uncertain"), (False, True, match(0.1, 0.1, 0.1), none, "missing"),
    ]
    for structural, record, best, typed, want in cases:
        assert one(spark, scalars.gap_status(F.lit(structural), F.lit(record), best, typed)["status"], a=1) == want


def test_text(spark):
    assert one(spark, text.strip_comments(F.lit("a 5\\% b % note\n  % only\nc\\\\% d\n\ne")), a=1) == "a 5\\% b\nc\\\\\n\ne"
    assert one(spark, text.clean_text(F.lit("<b>x</b> &amp; \\cite{k} \\alpha_{1}")), a=1) == "x & alpha 1"
    assert one(spark, text.located(F.lit("space.}"), F.lit("in space.\n} end"))["how"], a=1) == "whitespace"
    assert one(spark, text.located(F.lit("space.}"), F.lit("in space.\n} end"))["verbatim"], a=1) == "space.\n}"
    assert one(spark, text.located(F.lit(" ab "), F.lit("xaby"))["how"], a=1) == "exact"
    assert one(spark, text.located(F.lit("zz"), F.lit("xaby")), a=1) is None
    assert one(spark, text.latex_title(F.lit("$\\sqrt{s}=13$ TeV $\\bar{t}\\gamma$")), a=1) == "√s=13 TeV t\u0304γ"
    assert one(spark, text.unescape(F.lit("&lt;&eacute;")), a=1) == html.unescape("&lt;&eacute;")
    assert one(spark, text.fits_type(F.lit("cutflow"), F.lit("Cut flow table")), a=1)


def test_vectors(spark):
    assert one(spark, vectors.unit(F.array(F.lit(3.0), F.lit(4.0))), a=1) == [0.6, 0.8]
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0))), a=1) == [0.0, 0.0]
    assert abs(one(spark, vectors.norm(vectors.hashed_embedding(F.array(F.lit("a"), F.lit("b")), 16)), a=1) - 1) < 1e-9


def test_split_text(spark):
    value = "one two. three four; five\n\nsix seven\neight " + "x" * 50
    pieces = one(spark, passages.split_text(F.lit(value), 5), a=1)
    assert all(len(p) <= 20 and p in value and p == p.strip() for p in pieces)
    assert re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", value)
    assert one(spark, passages.chunk_numbers(F.array(*map(F.lit, [3, 3, 5, 1])), 6), a=1) == [0, 0, 1, 1]


PAPER = r"""\documentclass{article}
\begin{document}
Some words. % hidden
\input{parts/one}
\section{Data availability}
All tables are in HEPData.
\appendix
\section{Extra}
The upper limits are shown.

Nothing here.
\end{document}
"""


def test_candidates(spark):
    part = "\\section{Results}\nThe fiducial cross section is measured.\n\nPlain words.\n\\begin{figure}\\caption{Observed {data} yields.}\\end{figure}\n\\subsection{Feynman}\n\\begin{figure}\\caption{A Feynman diagram.}\\end{figure}"
    sources = spark.createDataFrame([("p1", {"main.tex": PAPER, "parts/one.tex": part})], "arxiv_id string, tex_files map<string,string>")
    papers = passages.bodies(passages.documents(sources))
    document = papers.first()["document"]
    found = passages.candidates(passages.sections(papers)).orderBy("ordinal", "start").collect()
    assert [(r["section_name"], r["kind"], r["text"].strip()) for r in found] == [
        ("Results", "paragraph", "The fiducial cross section is measured."),
        ("Results", "caption", "\\caption{Observed {data} yields.}"),
        ("Data availability", "data_statement_section", "All tables are in HEPData.\n\\appendix"),
        ("Appendix > Extra", "appendix_header", "\\section{Extra}"),
        ("Appendix > Extra", "paragraph", "The upper limits are shown."),
    ]
    assert all(r["text"] in document for r in found)
    circle = spark.createDataFrame([("p2", {"main.tex": "\\begin{document}\\input{a}\\end{document}", "a.tex": "\\input{a}"})], "arxiv_id string, tex_files map<string,string>")
    told = passages.documents(circle).first()
    assert "circle" in told["error"] and told["document"] is None


def test_verified(spark):
    products = spark.createDataFrame([(1, "The limits are given in table one", 2), (2, "short", 1), (3, "this is not in any of the passages", 1)], "id int, evidence_span string, passage_id int").withColumn("chunk", F.lit(0))
    texts = spark.createDataFrame([(0, 1, "s", "paragraph", "x The limits are\ngiven in table one y"), (0, 2, "t", "caption", "z")], "chunk int, passage_id int, section_name string, kind string, text string")
    got = {r["id"]: r for r in passages.verified(products, texts, ["chunk"]).collect()}
    assert (got[1]["evidence"], got[1]["match"], got[1]["evidence_section"]) == ("The limits are\ngiven in table one", "whitespace", "s")
    assert (got[2]["drop_reason"], got[3]["drop_reason"]) == ("too_short", "not_found")


def test_holding(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, None), (3, "")], "id int, t string")
    quotes = spark.createDataFrame([(7, "bcd"), (8, "x"), (9, ""), (10, None)], "q int, s string")
    assert sorted((r["id"], r["q"]) for r in passages.holding(texts, quotes, "t", "s").collect()) == [(1, 7), (1, 9), (3, 9)]


def test_matching(spark):
    products = spark.createDataFrame([(1, 10, "cutflow", ["cut", "flow"], [1.0, 0.0], 0.9), (1, 11, "other", ["mass"], [0.0, 1.0], 0.3), (2, 12, "likelihood", ["x1"], [1.0, 0.0], 0.9)], "inspire_id int, product int, product_type string, span_words array<string>, embedding array<double>, confidence double")
    tables = spark.createDataFrame([(1, 0, "d/t1", "Cut flow", "the cut flow", "", ["cut", "flow", "more"], [1.0, 0.0]), (1, 1, "d/t2", "Other", "nothing", "", ["none"], [0.6, 0.8])], "inspire_id int, ordinal int, table_doi string, name string, description string, resource_type string, words array<string>, embedding array<double>")
    best = matching.best_matches(matching.scored_pairs(products, tables), ["inspire_id", "product"])
    got = {r["product"]: r for r in matching.gaps(products, best, tables).collect()}
    assert (got[10]["status"], got[10]["match"]["table_doi"], got[10]["match"]["score"], got[10]["severity"]) == ("published", "d/t1", 1.1, 0)
    assert (got[11]["status"], got[12]["status"], got[12]["severity"], got[12]["match"]) == ("published", "no_record", 3, None)
    scores = {r["inspire_id"]: r["readiness_score"] for r in matching.readiness(spark.createDataFrame([(1,), (2,), (3,)], "inspire_id int"), matching.gaps(products, best, tables)).collect()}
    assert scores == {1: 100.0, 2: 0.0, 3: None}


def test_greedy(spark):
    rows = spark.createDataFrame([(1, "a", 0, 0.5, [1.0, 0.0]), (1, "a", 1, 0.9, [0.99, 0.1]), (1, "a", 2, 0.4, [0.0, 1.0]), (1, "b", 3, 0.1, [1.0, 0.0])], "inspire_id int, product_type string, ordinal int, confidence double, embedding array<double>")
    assert sorted((r["ordinal"], r["merged"]) for r in matching.merge_duplicates(rows).collect()) == [(1, 1), (2, 0), (3, 0)]
    pairs = spark.createDataFrame([(1, 0, "x", 50), (1, 0, "y", 60), (1, 1, "y", 70), (1, 1, "x", 10)], "p int, l int, r string, w int")
    assert sorted((r["l"], r["r"]) for r in matching.assign_one_to_one(pairs, "p", "l", "r", "w").collect()) == [(0, "x"), (1, "y")]


def test_relations(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z")], "k int, v string, w string")
    assert sorted(map(tuple, relations.upsert(stored, new, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")]
    assert sorted(map(tuple, relations.upsert(stored, new, ["k"], when=F.lit(False)).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "C", "Z")]
    again = relations.upsert(relations.upsert(stored, new, ["k"]), new, ["k"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, relations.upsert(stored, new, ["k"]).collect()))
    known = spark.createDataFrame([(2, 5)], "k int, id long")
    assert sorted((r["k"], r["id"]) for r in relations.with_stable_ids(spark.createDataFrame([(1,), (2,), (3,)], "k int"), known, ["k"], "id").collect()) == [(1, 6), (2, 5), (3, 7)]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_nearest_percentile(spark, q):
    values = {"a": [3.0, 1.0, 2.0, 2.0], "b": [5.0], "c": [float(i * 7919 % 3001) for i in range(3001)]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    got = dict(map(tuple, relations.nearest_percentile(rows, ["g"], "v", q, "p", accuracy=100).collect()))
    assert got == {g: sorted(vs)[round(q * (len(vs) - 1))] for g, vs in values.items()}


def test_search(spark):
    rows = spark.createDataFrame([(1, "upper limits on masses", "a title", "text"), (2, "cross sections", "limits of upper things", "x"), (3, "likelihood", "t", "upper limit")], "id int, description string, title string, evidence string")
    ids = lambda q: [r["id"] for r in search.search(rows, q).collect()]
    assert ids("limits") == [1, 2, 3]
    assert ids('"upper limit"') == [1, 3]
    assert ids("limit -likelihood") == [1, 2]
    assert ids("masses OR sections") == [1, 2]
    with pytest.raises(ValueError):
        search.parse("x")


def test_evaluation(spark):
    quote = "the measured fiducial cross section is given in table three of the paper"
    predicted = spark.createDataFrame([(1, 0, "before " + quote, "cross_section", "missing"), (1, 1, "something else entirely that matches nothing at all here", "other", "published")], "inspire_id int, prediction int, evidence_span string, product_type string, status string")
    gold = spark.createDataFrame([(1, "g1", [quote], "cross_section", ["other"], False), (1, "g2", ["never found by anything anywhere in the text"], "cutflow", [], None)], "inspire_id int, gold_id string, quotes array<string>, product_type string, accept_types array<string>, on_hepdata boolean")
    rows = evaluation.outcomes(predicted, gold, evaluation.matched(predicted, gold))
    assert sorted((r["outcome"], r["type"]) for r in rows.collect()) == [("fn", "cutflow"), ("fp", "other"), ("tp", "cross_section")]
    assert evaluation.gap_confusion(rows).first()["tp"] == 1
    assert {r["type"]: r["tp"] for r in evaluation.by_type(rows).collect()} == {"cutflow": 0, "other": 0, "cross_section": 1}


def test_quotes_on_pages(spark):
    long = "the observed upper limits on the production cross section of heavy resonances are shown in the last figure of this paper"
    shown = long.replace("in the last", "in \ufb01gure 12 the last")
    items = spark.createDataFrame([("d", 1, 0, "nothing here"), ("d", 2, 0, "Before. The observed upper limits on the pro-"), ("d", 2, 1, shown[len("the observed upper limits on the pro"):]), ("d", 2, 2, "another \ufb01ne sentence stands here")], "document string, page int, item int, text string")
    quotes = spark.createDataFrame([("d", 1, long.replace("shown", "shown~\\ref{f}")), ("d", 2, "another fine sentence"), ("d", 3, "too short"), ("d", 4, "this one is on none of the pages")], "document string, quote int, latex string")
    first, owners = pages.located(items, quotes)
    assert sorted((r["quote"], r["page"], r["from"]) for r in first.collect()) == [(1, 2, 6), (2, 2, first.where("quote = 2").first()["from"])]
    assert sorted((r["page"], r["item"], r["quote"]) for r in owners.collect()) == [(2, 0, 1), (2, 1, 1), (2, 2, 2)]


def test_nearest_percentile_of_every_group_size(spark):
    sizes = [*range(1, 30), 181, 190, 191, 211, 400]
    rows = [(n, float((i * 7919) % n)) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "g int, v double")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        want = {n: sorted(v for g, v in rows if g == n)[round(q * (n - 1))] for n in sizes}
        for accuracy in (10_000, 20):
            assert dict(map(tuple, relations.nearest_percentile(df, ["g"], "v", q, "p", accuracy).collect())) == want


def test_best_of_blocks_is_the_best_of_all_pairs(spark):
    """Ties by rounding and by copies, words, types, vectors with nulls, of other lengths and not of numbers; no plan has a row for each pair."""
    import random

    rng = random.Random(5)
    vector = lambda: rng.choice([None, [], [1.0, None], [float("nan"), 1.0], [3e38, 3e38], [1.0, 0.0], [round(rng.uniform(-1, 1), 1) for _ in range(2)], [rng.uniform(-1, 1) for _ in range(3)], *[[rng.uniform(-1, 1) for _ in range(2)] for _ in range(3)]])
    words = lambda: rng.choice([None, [], [f"w{rng.randrange(6)}" for _ in range(4)]])
    products = spark.createDataFrame([(i % 4, i, rng.choice(["cutflow", "upper_limit", "other"]), words(), vector()) for i in range(60)], "inspire_id int, product int, product_type string, span_words array<string>, embedding array<float>")
    tables = spark.createDataFrame([(i % 3, i, f"d/{i}", rng.choice(["cut flow", "upper limit", "x"]), "", "", words(), vector()) for i in range(90)], "inspire_id int, ordinal int, table_doi string, name string, description string, resource_type string, words array<string>, embedding array<float>")
    told = lambda rows: sorted(map(str, rows.select("inspire_id", "product", "best", "typed").collect()))
    want = told(matching.best_matches(matching.scored_pairs(products, tables), ["inspire_id", "product"]))
    for block in (7, 4096):
        found = matching.best_of(products, tables, ["inspire_id", "product"], block=block)
        assert told(found) == want
        assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()
    assert matching.best_of(products.limit(0), tables, ["product"]).count() == 0
    many = spark.range(6000).select(F.lit(1).alias("inspire_id"), F.col("id").alias("ordinal"), F.lit("d").alias("table_doi"), *[F.lit("").alias(c) for c in ("name", "description", "resource_type")], F.array().cast("array<string>").alias("words"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    asked = many.select("inspire_id", F.col("ordinal").alias("product"), F.lit("other").alias("product_type"), F.col("words").alias("span_words"), "embedding")
    assert matching.best_of(asked, many.withColumn("table_doi", F.col("ordinal").cast("string")), ["product"]).groupBy("best.table_doi").count().collect() == [("0", 6000)]


@pytest.mark.parametrize("worded", [True, False])
def test_a_block_of_pairs_takes_the_work_of_its_vectors(worded):
    """Few words make narrow matrices, and usual vectors are ruled out in single precision: a block's arrays stay small."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n, rng = 4096, np.random.default_rng(1)
    bag = lambda i, ways: [f"w{i % w}" for w in ways] if worded else []
    one = pd.DataFrame({"product_type": "other", "span_words": [bag(i, (7, 5)) for i in range(n)], "embedding": list(rng.normal(size=(n, 64))), "__flaw": False})
    other = pd.DataFrame({"ordinal": range(n), "table_doi": "d", "words": [bag(i, (6, 4)) for i in range(n)], "embedding": list(rng.normal(size=(n, 64))), "__flaw": False, "fits": [[]] * n})
    tracemalloc.start()
    try:
        found = matching._best_in_block(one, other)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == n and peak < 60e6, peak


def test_parts_that_single_precision_cannot_tell_apart(spark):
    """The best of all pairs is that of double precision, whatever the vectors' length: near ties are scored as they are."""
    import math
    import random

    rng = random.Random(3)
    near = lambda size: [size * math.cos(1 + rng.uniform(-1, 1) * 1e-8), size * math.sin(1 + rng.uniform(-1, 1) * 1e-8)]
    products = spark.createDataFrame([(1, i, "cutflow", ["a", "b"], near(s)) for i, s in enumerate([1.0, 1e-20, 1e9, 0.0] * 5)], "inspire_id int, product int, product_type string, span_words array<string>, embedding array<double>")
    tables = spark.createDataFrame([(1, i, f"d/{i}", "cut flow", "", "", ["a", f"w{i % 3}"], near(rng.choice([1.0, 0.99999999]))) for i in range(80)], "inspire_id int, ordinal int, table_doi string, name string, description string, resource_type string, words array<string>, embedding array<double>")
    told = lambda rows: sorted(map(str, rows.select("product", "best", "typed").collect()))
    assert told(matching.best_of(products, tables, ["product"])) == told(matching.best_matches(matching.scored_pairs(products, tables), ["product"]))


def test_near_ties_of_a_whole_block_leave_a_row_for_each_product():
    """Pairs that may be the best are settled strip by strip, not kept until the block ends."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n, rng = 1024, np.random.default_rng(2)
    vectors = 1 + 1e-7 * rng.normal(size=(2, n, 4))
    one = pd.DataFrame({"product_type": "cutflow", "span_words": [["a"]] * n, "embedding": list(vectors[0]), "__flaw": False})
    other = pd.DataFrame({"ordinal": range(n), "table_doi": "d", "words": [["a"]] * n, "embedding": list(vectors[1]), "__flaw": False, "fits": [["cutflow"]] * n})
    tracemalloc.start()
    try:
        found = matching._best_in_block(one, other)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    exact = sum(vectors[0][:, None, k] * vectors[1][None, :, k] for k in range(4))
    assert found[~found["typed"]]["ordinal"].tolist() == [0] * n and found[found["typed"]]["ordinal"].tolist() == exact.argmax(axis=1).tolist()
    assert peak < 100e6, peak


def test_runs_of_parts_hold_each_once_and_near_ones_are_found_across_them():
    """Kinds of many parts are several runs; what may be best is sought in the runs that can hold it."""
    import numpy as np

    rng = np.random.default_rng(4)
    kinds = np.concatenate([np.zeros(150, int), np.ones(64, int), np.arange(2, 12), np.zeros(3, int)])
    order, begins, ends = matching._runs(kinds)
    assert sorted(order.tolist()) == list(range(len(kinds))) and begins[0] == 0 and ends[-1] == len(kinds) and (begins[1:] == ends[:-1]).all()
    assert (ends - begins).max() <= matching.RUN and all(len(set(kinds[order[x:y]])) == 1 for x, y in zip(begins, ends))
    a, b = rng.normal(size=(20, 8)).astype(np.float32), rng.normal(size=(len(kinds), 8)).astype(np.float32)
    overlap, fits = rng.integers(0, 3, size=(12, 20)) / 2, rng.random(size=(12, 20)) < 0.3
    of_run = kinds[order[begins]]
    found = {which: (i, j) for which, i, j in matching._near_runs(a, b[order], (order, begins, ends), overlap[of_run], fits[of_run], np.full(20, 1e-5, np.float32))}
    raw, typed = a @ b.T, fits[kinds].T
    score = 0.5 * raw + 0.5 * overlap[kinds].T + 0.1 * typed
    for which, value in ((False, score), (True, np.where(typed, raw, -np.inf))):
        pairs = set(zip(*map(np.ndarray.tolist, found[which])))
        assert len(pairs) == len(found[which][0]) < 40
        assert {(i, int(j)) for i, j in enumerate(value.argmax(axis=1)) if np.isfinite(value[i, j])} <= pairs
