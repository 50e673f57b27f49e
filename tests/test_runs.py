"""What stages do around their work, rounding, keys, titles, pages, and streams that replace."""

import gzip
import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from lacuna.functions import scalars, text
from lacuna.operators import bucketed, evaluation, matching, relations, runs, stages
from lacuna.sources import archives, paged, readers, staged_json
from lacuna.streaming import increments


def values(spark, column, data, schema):
    return [r["x"] for r in spark.createDataFrame(data, schema).select(column.alias("x")).collect()]


def test_rounding_is_half_even_on_the_binary_value(spark):
    numbers = [6.25, 0.125, 2.675, 0.15, 93.75, -6.25, float("inf"), 1e300]
    for digits in (0, 1, 2, 4):
        assert values(spark, scalars.rounded(F.col("v"), digits), [(v,) for v in numbers], "v double") == [round(v, digits) for v in numbers]
    assert values(spark, scalars.percent_text(F.col("v")), [(0.125,), (0.135,), (1.0,), (None,)], "v double") == ["12%", f"{0.135:.0%}", "100%", "n/a"]
    products = spark.createDataFrame([(1, "cross_section", "missing")] * 7 + [(1, "other", "missing"), (1, "other", "published")], "inspire_id int, product_type string, status string")
    assert matching.readiness(spark.createDataFrame([(1,)], "inspire_id int"), products).first()["readiness_score"] == 6.2


def test_keys_of_requests(spark):
    data = [({"b": 'x"y\n', "a": "é", "c": None},), ({},)]
    got = values(spark, scalars.canonical_json(F.col("m")), data, "m map<string,string>")
    assert got == [json.dumps(m, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for (m,) in data]
    key = values(spark, scalars.cache_key(F.lit("p"), F.lit("m"), F.col("m")), data[1:], "m map<string,string>")
    assert key == [hashlib.sha256(b"p\0m\0{}").hexdigest()]


def test_titles(spark):
    titles = {"$x^{2}$": "x²", "H_{2}O": "H₂O", "95\\% CL": "95% CL", "a \\sim b": "a b", "$\\sqrt{s}=13$~TeV": "√s=13 TeV", "x^{ab} y_i": "x^ab y_i", "\\foo{z} \\alpha^{-1}": "fooz α⁻¹", "p^\\prime": "p^′", "\\mathrm{t\\bar{t}}": "tt\u0304"}
    assert values(spark, text.latex_title(F.col("t")), [(t,) for t in titles], "t string") == list(titles.values())


def test_texts_of_products_are_cleaned(spark):
    row = spark.createDataFrame([("<b>x</b> &lt; \\alpha",)], "d string").select(text.product_text(F.lit("upper_limit"), F.col("d")).alias("p"), text.table_text(F.lit("T&amp;1"), F.col("d")).alias("t")).first()
    assert (row["p"], row["t"]) == ("upper limit: x < alpha", "T&1: x < alpha")


def test_guard_pending_and_summary(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok", 4.0), (2, "no_latex", None), (3, None, None), (4, "ok", 2.675)], "k int, status string, reduction_ratio double")
    good, others = runs.guarded(rows, "filter")
    assert sorted(r["k"] for r in good.collect()) == [1, 4]
    assert {r["k"]: (r["status"], r["detail"]) for r in others.collect()} == {2: ("skipped", "filter status no_latex"), 3: ("skipped", "filter status unknown")}
    done = spark.createDataFrame([(1, "ok", "2"), (2, "ok", "1"), (3, "failed", "2")], "k int, status string, version string")
    assert sorted(r["k"] for r in runs.pending(rows, done, "k", "2").collect()) == [2, 3, 4]
    assert runs.pending(rows, done, "k", "2", force=True).count() == 4
    said = runs.summary(rows.na.fill("none", ["status"]))
    one = said.first()
    assert (one["papers"], one["statuses"], one["reduction_ratio_median"], one["reduction_ratio_min"]) == (4, {"ok": 2, "no_latex": 1, "none": 1}, round(3.3375, 2), round(2.675, 2))
    runs.write_stage(rows, said, str(tmp_path), "k")
    assert staged_json.read(spark, str(tmp_path), rows.schema).count() == 4 and staged_json.current(str(tmp_path))["summary"]["papers"] == 4
    seen, watch = runs.observed(rows, "stage", {"papers": F.count(F.lit(1)), "ok": F.count_if(F.col("status") == "ok")})
    assert seen.count() == 4 and watch.get == {"papers": 4, "ok": 2}
    assert runs.summary(rows.limit(0)).first()["papers"] == 0
    assert set(runs.stage_metrics()) >= {"papers", "ok", "ratio_mean"}


def test_slices_are_disjoint(spark):
    rows = spark.createDataFrame([(1, 2020), (2, 2021)], "k int, year int")
    assert runs.disjoint(rows, "k", "year").count() == 2
    for bad, message in [([(1, 2020), (1, 2021)], "more than one"), ([(1, 2020), (1, 2020)], "twice")]:
        with pytest.raises(Exception, match=message):
            runs.disjoint(spark.createDataFrame(bad, "k int, year int"), "k", "year").collect()
    with pytest.raises(Exception, match="wrong slice"):
        runs.disjoint(rows, "k", "year", F.col("year") == 2020).collect()


def test_pages_with_totals(spark):
    rows = spark.range(60)
    first = relations.counted_page(rows, [F.asc("id")]).collect()
    last = relations.counted_page(rows, [F.asc("id")], number=3).collect()
    assert (len(first), first[0]["total"], first[0]["has_next"], len(last), last[0]["has_next"]) == (25, 60, True, 10, False)
    assert relations.counted_page(rows.limit(0), [F.asc("id")]).count() == 0
    for number in (0, 4):
        with pytest.raises(LookupError):
            relations.counted_page(rows, [F.asc("id")], number)


def test_similar_pairs_are_those_of_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(90, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    label = [i % 3 if i < 60 else 0 for i in range(90)]
    rows = spark.createDataFrame([(i, label[i], v.tolist()) for i, v in enumerate(vectors)], "id long, label int, v array<double>")
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if label[i] == label[j] and vectors[i] @ vectors[j] >= 0.5}
    for block in (7, 512):
        assert [tuple(r)[:2] for r in sorted(matching.similar_pairs(rows, "label", "id", "v", 0.5, block).collect())] == sorted(want)
    assert matching.similar_pairs(rows.limit(0), "label", "id", "v", 0.5).count() == 0


def test_types_and_report(spark):
    rows = spark.createDataFrame([("tp", "a", True, "missing", False), ("tp", "a", False, "published", True), ("fp", "b", False, "missing", None)], "outcome string, type string, type_right boolean, status string, on_hepdata boolean")
    assert evaluation.type_accuracy(rows).first()["type_accuracy"] == 0.5
    assert evaluation.type_accuracy(rows.limit(0)).first()["type_accuracy"] is None
    metrics = spark.createDataFrame([("precision", 0.125), ("recall", None)], "name string, value double")
    cost = evaluation.cost(spark.createDataFrame([(1_000_000, 0)], "input_tokens long, output_tokens long"), 0.5, 1.0)
    said = evaluation.report(metrics, evaluation.by_type(rows), evaluation.gap_confusion(rows), cost, {"min_precision": 0.5})
    assert "| precision | 12% | 50% |" in said and "| recall | n/a |  |" in said and "| a | 100% | 100% | 100% | 2 | 0 | 0 |" in said and "| 0.5000 |" in said


def test_damaged_archives_are_rows(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        info = tarfile.TarInfo("a.tex")
        info.size = 4000
        tar.addfile(info, io.BytesIO(b"x" * 4000))
    whole = gzip.compress(out.getvalue())
    for name, raw in {"cut.tar.gz": whole[: len(whole) // 2], "short.tar": out.getvalue()[:1500], "bad.gz": b"\x1f\x8b" + b"rubbish", "good.tar.gz": whole}.items():
        (tmp_path / name).write_bytes(raw)
    kinds = {r["arxiv_id"]: r["kind"] for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert sorted(kinds.values()) == ["error", "error", "error", "tex"]


def test_links_to_other_services_are_loud():
    page = lambda following: {"hits": {"hits": ["x"], "total": 2}, "links": {"next": following}}
    with pytest.raises(ValueError, match="elsewhere"):
        list(paged.pages("https://one.org/a", lambda url: page("https://two.org/b")))
    with pytest.raises(ValueError, match="elsewhere"):
        list(paged.pages("a", lambda url: page("https://two.org/b")))


def test_pages_after_a_live_one_are_live(spark):
    url = lambda q, n: (q, n, f"{q}{n}", hashlib.sha256(f"{q}{n}".encode()).hexdigest())
    rows = [(*url("q", 1), 0), (*url("q", 2), 500), (*url("q", 3), 0), (*url("r", 1), 0)]
    pages = spark.createDataFrame(rows, "query string, page int, url string, key string, age int").withColumn("fetched_at", F.current_timestamp() - F.make_dt_interval(secs=F.col("age")))
    assert sorted((r["query"], r["page"]) for r in readers.usable_pages(pages, F.current_timestamp(), 100).collect()) == [("q", 1), ("r", 1)]


def test_stream_that_replaces(spark, tmp_path):
    schema = "paper int, k int, v string, is_current boolean, at int"
    source, table = tmp_path / "in", str(tmp_path / "table")
    spark.createDataFrame([(1, 1, "a", True, 1), (1, 1, "A", True, 2), (1, 2, "b", True, 1), (1, 3, "c", True, 1), (2, 9, "z", True, 1)], schema).write.parquet(f"{source}/one")
    each = increments.replacer(table, ["k"], "paper", lambda s: s.createDataFrame([(2,)], "k int"), order=["at"])
    increments.run_once(increments.arrivals(spark, f"{source}/*", schema), each, str(tmp_path / "cp"))
    spark.createDataFrame([(1, 1, "again", True, 3)], schema).write.parquet(f"{source}/two")
    increments.run_once(increments.arrivals(spark, f"{source}/*", schema), each, str(tmp_path / "cp"))
    stored = bucketed.Bucketed(table, ["paper", "k"], ["paper"])
    assert sorted((r["k"], r["v"], r["is_current"]) for r in bucketed.read(spark, stored, schema).collect()) == [(1, "again", True), (2, "b", False), (9, "z", True)]
    assert {r["v"] for r in bucketed.read(spark, stored, schema, version=1).where("k = 1").collect()} == {"A"}


def test_first_seen_and_stage_text(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 00:00:00")], "k int, ts string").write.parquet(str(tmp_path / "in/one"))
    got = []
    increments.run_once(increments.first_seen(increments.arrivals(spark, f"{tmp_path}/in/*", "k int, ts string"), ["k"], "ts", late="7 days"), lambda batch, _: got.extend(r["k"] for r in batch.collect()), str(tmp_path / "cp"))
    assert sorted(got) == [1, 2]
    found = spark.createDataFrame([("p", 0, 0, "s", "caption", "some text")], "arxiv_id string, ordinal int, start int, section_name string, kind string, text string")
    assert "### Passage 1 (caption; section: s)\nsome text" in stages.prompts(found).first()["prompt"]


def test_reconcile_statuses(spark):
    frame = spark.createDataFrame
    papers = frame([(1, "ok"), (2, "ok"), (3, "ok"), (4, "schema_error"), (5, "ok")], "inspire_id int, status string")
    records = frame([(1,), (1,)], "inspire_id int")
    links = frame([(1, True), (2, True), (3, False), (4, True)], "inspire_id int, linked boolean")
    statuses = stages.reconcile_statuses(papers, records, links)
    assert {r["inspire_id"]: (r["status"], r["detail"] is None) for r in statuses.collect()} == {1: ("ok", True), 2: ("lookup_error", False), 3: ("ok", True), 4: ("skipped", False), 5: ("ok", True)}
    said = stages.reconcile_summary(statuses, frame([("missing",), ("missing",), ("published",)], "status string"), frame([(6.25,), (6.25,), (None,)], "readiness_score double")).first()
    assert (said["papers"], said["lookup_errors"], said["products_by_status"], said["mean_readiness_score"]) == (5, 1, {"missing": 2, "published": 1}, 6.2)


def test_labels(spark):
    from lacuna.functions import constants as K

    assert values(spark, scalars.label(F.col("v")), [("no_record",), ("cutflow",), ("else",), (None,)], "v string") == ["No HEPData record", "Cut-flow", None, None]
    assert values(spark, scalars.label(F.col("v"), K.SEVERITY_LABELS), [(3,), (9,)], "v int") == ["High", None]


def test_versions_are_published_whole(spark, tmp_path):
    import dataclasses

    from lacuna.operators import store

    root = str(tmp_path / "store")
    assert store.current(spark, root).paper.count() == 0
    one = store.empty(spark)
    paper = spark.createDataFrame([(1, "a")], "inspire_id long, title string")
    first = store.publish(dataclasses.replace(one, paper=store._typed(paper, "paper")), root)
    store.write(one, f"{root}/version-broken")
    assert [r["title"] for r in store.current(spark, root).paper.collect()] == ["a"]
    second = store.publish(one, root)
    assert first != second and store.current(spark, root).paper.count() == 0
