"""A Spark data source over a paginated search: a partition for each year, which follows the pages' links.

The pages come from files of a folder that stands for the service (page URLs are file names); pages() takes any other fetch function.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

MAX_TOTAL = 10_000
FIELDS = ["control_number", "titles", "arxiv_eprints", "collaborations", "earliest_date", "external_system_identifiers"]


def pages(first: str, fetch: Callable[[str], dict], origin: str = "") -> Iterator[dict]:
    """The hits of all pages from first on. Loud about what would lose some: too many hits, a total that changes, an empty page with a
    next one, a link to another service, or another number of hits than announced. origin: what all links begin with; by default the first page's scheme and host."""
    parts = urlsplit(first)
    origin = origin or (f"{parts.scheme}://{parts.netloc}/" if parts.netloc else "")
    url, total, seen = first, None, 0
    while url:
        page = fetch(url)
        found, now = page["hits"]["hits"], page["hits"]["total"]
        if now > MAX_TOTAL:
            raise ValueError(f"{now} hits, the service gives {MAX_TOTAL} at most: cut smaller slices")
        if total is not None and now != total:
            raise ValueError(f"the total changed from {total} to {now}")
        following = page.get("links", {}).get("next")
        if following and not found:
            raise ValueError(f"{url} is empty but has a next page")
        if following and not (following.startswith(origin) if origin else not urlsplit(following).netloc):
            raise ValueError(f"{following} leads elsewhere")
        yield from found
        url, total, seen = following, now, seen + len(found)
    if seen != total:
        raise ValueError(f"{seen} hits came, {total} were announced")


def parsed(text: str) -> dict:
    """A page's JSON. Keys that hold the word email, whatever their case and depth, are left out as it is read."""
    return json.loads(text, object_pairs_hook=lambda pairs: dict(p for p in pairs if "email" not in p[0].lower()))


class Slice(InputPartition):
    def __init__(self, year: int | None):
        self.year = year


class SearchReader(DataSourceReader):
    """A partition for each year from startYear to endYear."""

    def __init__(self, options: dict):
        self.folder, self.start, self.end = options["path"], int(options["startYear"]), int(options["endYear"])
        self.fields = [f for f in options.get("fields", ",".join(FIELDS)).split(",") if f]
        self.years = range(self.start, self.end + 1)

    def partitions(self) -> list[InputPartition]:
        # Of no year at all there is a partition too, that reads nothing.
        return [Slice(year) for year in self.years] or [Slice(None)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if partition.year is None:
            return
        fetch = lambda url: parsed((Path(self.folder) / url).read_text())
        for hit in pages(f"{partition.year}-1.json", fetch, origin=f"{partition.year}-"):
            kept = {k: v for k, v in hit.get("metadata", {}).items() if k in self.fields}
            yield partition.year, json.dumps({"id": hit.get("id"), "metadata": kept})


class FilteredReader(SearchReader):
    """A partition for each of these years that the query's filters leave. Spark asks for it that spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on the year decide which slices are asked for; the others are left to Spark."""
        for f in filters:
            holds = self._holds(f)
            if holds is None:
                yield f
            else:
                self.years = [y for y in self.years if holds(y)]

    @staticmethod
    def _holds(f: Filter) -> Callable[[int], bool] | None:
        if getattr(f, "attribute", None) != ("year",):
            return None
        if isinstance(f, IsNotNull):
            return lambda y: True
        if isinstance(f, In):
            return lambda y: y in f.value
        compare = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}.get(type(f))
        return (lambda y: compare(y, f.value)) if compare else None


class Search(DataSource):
    """format("paged_search"), options path, startYear, endYear, fields and pushYears (true: conditions on the year reach the source)."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "year int, value string"

    def reader(self, schema) -> DataSourceReader:
        return FilteredReader(self.options) if self.options.get("pushYears", "").lower() == "true" else SearchReader(self.options)
