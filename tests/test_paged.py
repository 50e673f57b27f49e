"""Filters that reach the search source, and keys that do not get out of it."""

import json

import pytest

from lacuna.sources import paged


@pytest.fixture
def source(spark, tmp_path):
    for year in range(2018, 2024):
        hits = [{"id": year * 10 + i, "metadata": {"titles": [{"title": "t", "Email": "x"}], "collaborations": [{"value": "c", "deep": {"contact_emails": ["a@b.c"], "kept": [1, {"EMAIL_OF": 2}]}}], "other": 1}} for i in range(3)]
        pages = [hits[:2], hits[2:]]
        for n, part in enumerate(pages, 1):
            page = {"hits": {"hits": part, "total": 3}, "links": {"next": f"{year}-2.json"} if n == 1 else {}}
            (tmp_path / f"{year}-{n}.json").write_text(json.dumps(page))
    spark.dataSource.register(paged.Search)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark.read.format("paged_search").option("path", str(tmp_path)).option("startYear", 2018).option("endYear", 2023).option("pushYears", "true").load(), tmp_path
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("condition, years", [("year = 2020", [2020]), ("year >= 2021 AND year < 2023", [2021, 2022]), ("year IN (2018, 2023, 1999)", [2018, 2023]), ("year > 2030", []), ("value LIKE '%20201%'", range(2018, 2024))])
def test_slices_of_the_filter_alone_are_read(source, condition, years):
    rows, folder = source
    found = rows.where(condition)
    assert found.rdd.getNumPartitions() == max(1, len(years))
    kept = sorted(json.loads(r["value"])["id"] for r in found.collect())
    assert kept == ([20201] if "LIKE" in condition else sorted(y * 10 + i for y in years for i in range(3)))
    if len(years) == 1:
        # Other years are not even asked for.
        for other in folder.glob("202[13]-*.json"):
            other.unlink()
        assert found.count() == 3


def test_keys_with_addresses_are_removed_at_any_depth(source):
    rows, _ = source
    value = json.loads(rows.where("year = 2018").first()["value"])
    assert value["metadata"] == {"titles": [{"title": "t"}], "collaborations": [{"value": "c", "deep": {"kept": [1, {}]}}]}
    assert paged.parsed('{"a": "email", "b": [{"eMail": 1}]}') == {"a": "email", "b": [{}]}
