"""WARC round trips, revisits and broken archives."""

import base64
import gzip
import hashlib
import io

import pytest

from lacuna.llm import warc
from lacuna.llm.common import staged

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/ \r\n", "\r\n\r\nWARC/1.1 é"), (6, "http://f/", "y" * 700_000), (6, "http://f/", "y" * 700_000)]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def round_trip(spark, folder, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = staged(warc.write(pages, folder, **options), "manifest")
    return manifest, sorted((int(r["record_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(manifest, folder).collect())


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_round_trip(spark, tmp_path, archive_bytes):
    manifest, got = round_trip(spark, f"file://{tmp_path}", PAGES, archive_bytes=archive_bytes)
    want = []
    for key, _, html in PAGES:
        top = max(k for k, _, h in PAGES if (h or "") == (html or ""))
        want.append((key, "response" if top == key else "revisit", None if top == key else str(top), len((html or "").encode()), digest(html)))
    assert got == sorted(want)
    files = [r["path"] for r in manifest.collect()]
    members = b"".join(gzip.open(f).read() for f in files)
    assert members.count(b"WARC-Type:") == len(PAGES)


def test_small_payloads_are_responses(spark, tmp_path):
    _, got = round_trip(spark, f"file://{tmp_path}", PAGES[:2], at_least=100)
    assert [g[1] for g in got] == ["response", "response"]


def test_empty(spark, tmp_path):
    assert round_trip(spark, f"file://{tmp_path}", [])[1] == []


def read_all(raw):
    return [warc.read_record(m) for m in warc.members(io.BytesIO(raw))]


def test_broken_archives():
    good = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    assert [r.payload_bytes for r in read_all(good + good)] == [7, 7]
    with pytest.raises(ValueError, match="ends within"):
        read_all(good[:-6])
    text = gzip.decompress(good)
    for bad in (text.replace(b"payload\r\n", b"pAyload\r\n"), text[:-2], text + b"x"):
        with pytest.raises(ValueError):
            read_all(gzip.compress(bad))
