"""A run's results in the tables, again, and changed; and the queries over them."""

import datetime

import pytest
from pyspark.sql import functions as F

from lacuna.operators import serve, stages, store

PAPERS = [(1, "2401.1", "Limits on masses", ["A", "B"], "2024-03", False), (2, None, "Cross sections", [], "2021", True)]
MATCH = "struct<table_doi:string,similarity:double,overlap:double,score:double>"
PRODUCTS = [
    (1, 0, "likelihood", "the full likelihood", "the full likelihood is given", 0.9, "missing", 3, ("r/1/t1", 0.1, 0.1, 0.1)),
    (1, 1, "upper_limit", "upper limits on the mass", "limits on the mass", 0.9, "published", 0, ("r/1/t2", 0.9, 0.9, 0.9)),
    (1, 2, "other", "other things", "other words", 0.6, "uncertain", 1, ("r/9/t1", 0.5, 0.5, 0.5)),
    (2, 0, "cross_section", "fiducial cross section", "the cross section", 0.9, "no_record", 2, None),
]
PARTS = [(1, 0, "r/1/t2", "T2", "limits", "table", ""), (1, 1, "r/1/t1", "T1", "x", "table", ""), (1, 2, "r/1/t10", "T10", "x", "table", ""), (1, 3, "r/1/r1", "R1", "x", "resource", "code")]


def run(spark, tables, products, only=(1, 2)):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    harvested = frame(PAPERS, "inspire_id long, arxiv_id string, title string, collaborations array<string>, earliest_date string, inspire_links_hepdata boolean")
    filtered = frame([(1, "ok"), (2, "no_arxiv_id")], "inspire_id long, status string")
    extracted = frame([(1, "ok", "v1", datetime.datetime(2024, 1, 1))], "inspire_id long, status string, extraction_version string, modified timestamp")
    done = [r for r in [(1, "ok", 7, "r/1", 1, 50.0), (2, "ok", None, None, None, 0.0)] if r[0] in only]
    reconciled = frame(done, "inspire_id long, status string, hepdata_record_id int, hepdata_record_doi string, hepdata_version int, readiness_score double")
    rows = frame([p for p in products if p[0] in only], f"inspire_id long, ordinal int, product_type string, description string, evidence_span string, confidence double, status string, severity int, match {MATCH}")
    rows = rows.withColumns({"embedding": F.when(F.col("ordinal") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))), "merged_duplicates": F.lit(0)})
    parts = frame(PARTS, "inspire_id long, ordinal int, table_doi string, name string, description string, kind string, resource_type string").withColumn("embedding", F.array(F.lit(1.0)))
    versions = reconciled.select("inspire_id", "hepdata_record_id", F.lit("v1").alias("extraction_version"), F.lit("r1").alias("reconcile_version"))
    return store.run_into(tables, store.papers(harvested, filtered, extracted, reconciled), rows, parts, versions)


def kept(spark, tables, tmp_path, name):
    store.write(tables, str(tmp_path / name))
    return store.read(spark, str(tmp_path / name))


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    return kept(spark, run(spark, store.empty(spark), PRODUCTS), tmp_path_factory.mktemp("store"), "one")


def test_store_is_idempotent(spark, first, tmp_path):
    again = kept(spark, run(spark, first, PRODUCTS), tmp_path, "two")
    for name in store.SCHEMAS:
        assert rows(getattr(first, name)) == rows(getattr(again, name))


def test_reviewed_products_are_superseded(spark, first, tmp_path):
    ids = {r["description"]: r["id"] for r in first.product.collect()}
    reviewed = store.add_review(first, ids["the full likelihood"], "accepted", "curator", "", datetime.datetime(2024, 1, 1))
    later = kept(spark, run(spark, reviewed, PRODUCTS[1:2] + PRODUCTS[3:]), tmp_path, "three")
    got = {r["description"]: r["is_current"] for r in later.product.collect()}
    assert got == {"the full likelihood": False, "upper limits on the mass": True, "fiducial cross section": True}
    assert {r["declared_product_id"] for r in later.gap.collect()} == {ids[d] for d in got}
    assert {r["description"]: r["id"] for r in later.product.collect()}.items() <= ids.items()
    assert serve.reviews(later, ids["the full likelihood"]).count() == 1
    with pytest.raises(LookupError):
        store.add_review(later, ids["the full likelihood"], "accepted", "c", "", datetime.datetime(2024, 1, 1))


def test_unreconciled_papers_keep_their_record(spark, first, tmp_path):
    later = kept(spark, run(spark, first, PRODUCTS, only=(2,)), tmp_path, "four")
    paper = later.paper.where("inspire_id = 1").first()
    assert (paper["hepdata_record_id"], paper["readiness_score"], paper["processing_status"]) == (7, 50.0, "extracted")
    assert later.product.where("inspire_id = 1 AND is_current").count() == 3


def test_queries(first):
    queue = serve.gaps(first).collect()
    assert [r["severity"] for r in queue] == [3, 2, 1]
    assert [r["matched_table"] and r["matched_table"]["table_doi"] for r in queue] == ["r/1/t1", None, None]
    assert [r["match"] is None for r in queue] == [False, True, False]
    assert serve.gaps(first, status=",").count() == 3 and serve.gaps(first, status="published", product_type=",").count() == 1
    assert serve.gaps(first, year=2021).count() == 1 and serve.gaps(first, min_severity=2).count() == 2 and serve.gaps(first, severity=1).count() == 1
    with pytest.raises(ValueError):
        serve.gaps(first, status="new")
    with pytest.raises(ValueError):
        serve.gaps(first, min_severity=4)
    assert [r["inspire_id"] for r in serve.papers(first).collect()] == [1, 2]
    assert [r["inspire_id"] for r in serve.papers(first, ordering="readiness").collect()] == [2, 1]
    assert [r["inspire_id"] for r in serve.papers(first, has_hepdata="false").collect()] == [2]
    with pytest.raises(ValueError):
        serve.papers(first, has_hepdata="")
    _, gaps, parts = serve.paper_gaps(first, 1)
    assert gaps.count() == 3 and [r["table_doi"] for r in parts.collect()] == ["r/1/t1", "r/1/t2", "r/1/t10", "r/1/r1"]
    with pytest.raises(LookupError):
        serve.paper_gaps(first, 99)
    stats = {(r["section"], r["name"]): r["value"] for r in serve.stats(first).collect()}
    assert stats["gaps", "open"] == 3 and stats["products", "total"] == 4 and stats["papers", "mean_readiness_score"] == 25.0 and stats["gaps by severity", "3"] == 1
    found = serve.search(first, '"cross section" OR masses').collect()
    assert {r["description"] for r in found} == {"fiducial cross section", "the full likelihood", "upper limits on the mass", "other things"} and found[0]["description"] in ("fiducial cross section", "upper limits on the mass")
    one = first.product.where("description = 'the full likelihood'").first()["id"]
    near = serve.similar(first, one).collect()
    assert len(near) == 3 and near[-1]["description"] == "upper limits on the mass"
    with pytest.raises(ValueError):
        serve.similar(first, one, 0)
    assert {r["status"]: r["n"] for r in serve.reuse_profile(first, 1).collect()} == {"missing": 1, "published": 1, "uncertain": 1}


def test_stages_end_to_end(spark):
    tex = "\\documentclass{a}\\begin{document}\\section{Results}\nThe fiducial cross section is measured in ten bins.\n\\section{Data availability}\nThe full likelihood is published on HEPData for reuse.\n\\end{document}"
    sources = spark.createDataFrame([("p1", {"main.tex": tex})], "arxiv_id string, tex_files map<string,string>")
    summary, found = stages.select_passages(sources)
    assert summary.first()["reduction_ratio"] > 1 and found.count() == 2
    assert "### Passage 2 (data_statement_section; section: Data availability)" in stages.prompts(found).first()["prompt"]
    from lacuna.operators import passages

    answer = [("cross_section", "fiducial cross section", "The fiducial cross  section is measured", 1, 0.9), ("likelihood", "full likelihood", "The full likelihood is published on HEPData", 1, 0.8), ("other", "x", "never written anywhere here", 1, 0.5)]
    answers = spark.createDataFrame([("p1", 0, answer)], "arxiv_id string, chunk int, products array<struct<product_type:string,description:string,evidence_span:string,passage_id:int,confidence:double>>")
    good, dropped = stages.extracted(answers, passages.chunks(found))
    assert sorted((r["product_type"], r["match"], r["evidence_section"]) for r in good.collect()) == [("cross_section", "whitespace", "Results"), ("likelihood", "exact", "Data availability")]
    assert [r["drop_reason"] for r in dropped.collect()] == ["not_found"]
    products = good.select(F.lit(1).alias("inspire_id"), "ordinal", "product_type", "description", F.col("evidence").alias("evidence_span"), "confidence")
    parts = spark.createDataFrame([(1, 0, "d/t1", "Table 1", "Fiducial cross section measured", "")], "inspire_id int, ordinal int, table_doi string, name string, description string, resource_type string")
    got = {r["product_type"]: r["status"] for r in stages.reconciled(products, parts, parts).collect()}
    assert got == {"cross_section": "published", "likelihood": "missing"}
