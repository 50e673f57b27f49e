"""Sources and streams on files made here."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from lacuna.operators import bucketed
from lacuna.sources import archives, paged, readers
from lacuna.streaming import increments


def page(hits, total, following=None):
    return json.dumps({"hits": {"hits": hits, "total": total}, "links": {"next": following} if following else {}})


def hit(n):
    return {"id": str(n), "metadata": {"control_number": n, "titles": [{"title": ""}, {"title": f"T{n}"}], "earliest_date": "2021-02", "external_system_identifiers": [{"schema": "HEPDATA"}], "author_email": "x@y.z"}}


def test_paged_search(spark, tmp_path):
    (tmp_path / "2020-1.json").write_text(page([hit(1), hit(2)], 3, "2020-2.json"))
    (tmp_path / "2020-2.json").write_text(page([hit(3)], 3))
    (tmp_path / "2021-1.json").write_text(page([], 0))
    spark.dataSource.register(paged.Search)
    raw = spark.read.format("paged_search").option("path", str(tmp_path)).option("startYear", 2020).option("endYear", 2021).load()
    papers = readers.hits(raw).orderBy("inspire_id").collect()
    assert [(p["inspire_id"], p["title"], p["inspire_links_hepdata"], p["collaborations"]) for p in papers] == [(n, f"T{n}", True, []) for n in (1, 2, 3)]
    assert raw.where(F.contains("value", F.lit("email"))).isEmpty()


@pytest.mark.parametrize(("pages", "message"), [
    ({"a": (["x"], 20000, None)}, "at most"), ({"a": (["x"], 2, "b"), "b": (["y"], 3, None)}, "changed"), ({"a": ([], 2, "b")}, "empty"), ({"a": (["x"], 2, "else/b")}, "elsewhere"), ({"a": (["x"], 2, None)}, "announced"),
])
def test_paged_search_is_loud(pages, message):
    fetch = lambda url: json.loads(page(*pages[url]))
    with pytest.raises(ValueError, match=message):
        list(paged.pages("a", fetch, origin="b" if "b" in str(pages) else ""))


def test_archives(spark, tmp_path):
    def tar(files):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, data in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    for name, raw in {"p1.tar.gz": tar({"a.tex": "é".encode("latin-1"), "b.png": b"x"}), "p2.gz": gzip.compress(b"\\documentclass{a}"), "p3.gz": b"%PDF-1.4", "p4.tar.gz": tar({"../a.tex": b"x"}), "p5.gz": gzip.compress(b"nothing")}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["arxiv_id"]: (r["kind"], r["tex_files"]) for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"p1": ("tex", {"a.tex": "é"}), "p2": ("tex", {"main.tex": "\\documentclass{a}"}), "p3": ("pdf", {}), "p4": ("error", {}), "p5": ("error", {})}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"inspire_id": 1, "title": "t"}\n\n')
    assert readers.unique(readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), readers.PAPER), "inspire_id").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|exist"):
        readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), readers.PAPER)
    with pytest.raises(ValueError):
        readers.Corpus("a/b", "q", 2020, 2021)
    assert readers.read_config('[corpus]\nname="c"\nquery="q"\nstart_year=2020\nend_year=2021').slices(spark).count() == 2
    rows = [("stop", '{"products": [{"product_type": "other", "description": "d", "evidence_span": "e", "passage_id": 1, "confidence": 0.5}]}'), ("length", "{}"), ("stop", "no"), ("stop", '{"products": [], "more": 1}'), ("stop", '{"products": [{"product_type": "other", "description": "d", "evidence_span": "e", "passage_id": 0, "confidence": 0.5}]}')]
    failed = [r["failed"] for r in readers.answers(spark.createDataFrame(rows, "finish_reason string, text string").coalesce(1)).collect()]
    assert failed == [None, "output incomplete: length", "not the expected JSON", "unknown keys", "a value is out of range"]


def test_streaming_merge_is_idempotent(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(f"{source}/one")
    merge = increments.merger(table, ["k"])
    increments.run_once(increments.arrivals(spark, f"{source}/*", "k int, v string"), merge, str(tmp_path / "cp"))
    spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string").write.parquet(f"{source}/two")
    increments.run_once(increments.arrivals(spark, f"{source}/*", "k int, v string"), merge, str(tmp_path / "cp"))
    assert sorted(map(tuple, bucketed.read(spark, bucketed.Bucketed(table, ["k"]), "k int, v string").collect())) == [(1, "a"), (2, "B"), (3, "c")]
