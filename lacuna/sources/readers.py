"""Readers with declared schemas. Nothing is inferred, and a row that does not fit is an error."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = "inspire_id long, arxiv_id string, title string, collaborations array<string>, earliest_date string, inspire_links_hepdata boolean"
CANDIDATES = (
    "inspire_id long, arxiv_id string, status string, filter_version string, detail string, main_file string, body_tokens int, candidate_tokens int, reduction_ratio double, "
    "missing_inputs array<string>, candidates array<struct<section_name:string,kind:string,text:string>>"
)
GOLD = (
    "inspire_id long, arxiv_id string, labeled_by string, reviewed_by_human boolean, revision int, revision_note string, "
    "items array<struct<id:string,product_type:string,accept_types:array<string>,description:string,evidence:array<string>,on_hepdata:boolean,hepdata_table:string>>"
)
ANSWER = "products array<struct<product_type:string,description:string,evidence_span:string,passage_id:int,confidence:double>>"
HIT = (
    "id string, metadata struct<control_number:long,titles:array<struct<title:string>>,arxiv_eprints:array<struct<value:string>>,collaborations:array<struct<value:string>>,"
    "earliest_date:string,external_system_identifiers:array<struct<schema:string,value:string>>>"
)


@dataclass(frozen=True)
class Corpus:
    name: str
    query: str
    start_year: int
    end_year: int

    def __post_init__(self):
        if not self.name or PurePosixPath(self.name).name != self.name or self.name in (".", ".."):
            raise ValueError(f"not a plain directory name: {self.name!r}")
        if self.start_year > self.end_year:
            raise ValueError("start_year is after end_year")

    def slices(self, spark: SparkSession) -> DataFrame:
        years = spark.range(self.start_year, self.end_year + 1).select(F.col("id").cast("int").alias("year"))
        return years.select("year", F.concat(F.lit(f"{self.query} and de "), F.col("year").cast("string")).alias("query"))


def read_config(text: str) -> Corpus:
    return Corpus(**tomllib.loads(text)["corpus"])


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object a line. A missing path and a line that does not fit are errors; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str, schema: str, only: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """A folder of one JSON document a file, in order of file name; names that begin with _ are skipped by Spark. modified: the file's time. Without a limit the order is the file column's:
    a table has none of its own."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path).withColumns({"file": F.col("_metadata.file_name"), "modified": F.col("_metadata.file_modification_time")})
    rows = rows.where(F.col("inspire_id").isin(*only)) if only else rows
    return rows.orderBy("file").limit(limit) if limit else rows


def unique(rows: DataFrame, key: str) -> DataFrame:
    """rows, or an error where a key repeats."""
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][key]} repeats")
    return rows


def hits(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON search hits -> papers. Only named fields are read, so e-mail addresses never get in; a hit without id, title or date is an error."""
    hit = F.from_json(F.col(column), HIT, {"mode": "FAILFAST"})
    m = F.col("hit.metadata")
    filled = lambda values: F.filter(values, lambda v: v.isNotNull() & (v != ""))
    first = lambda values: F.get(filled(values), F.lit(0))
    needed = lambda c, name: F.coalesce(c, F.raise_error(F.concat(F.lit(f"a hit without {name}: "), F.coalesce("hit.id", F.lit("?")))).cast("string"))
    links = F.coalesce(F.exists(m["external_system_identifiers"], lambda x: x["schema"] == "HEPDATA"), F.lit(False))
    return raw.select(hit.alias("hit")).select(
        needed(m["control_number"].cast("string"), "id").cast("long").alias("inspire_id"),
        first(m["arxiv_eprints"]["value"]).alias("arxiv_id"),
        needed(first(m["titles"]["title"]), "title").alias("title"),
        F.coalesce(filled(m["collaborations"]["value"]), F.array().cast("array<string>")).alias("collaborations"),
        needed(m["earliest_date"], "date").alias("earliest_date"),
        links.alias("inspire_links_hepdata"),
    )


def answers(raw: DataFrame, column: str = "text") -> DataFrame:
    """Model answers -> products, or failed with the reason: the answer was cut off, is no such JSON, has other keys or values out of range."""
    text = F.col(column)
    parsed = raw.withColumn("answer", F.from_json(text, ANSWER)).withColumn("keys", F.json_object_keys(text))
    p = F.col("answer.products")
    good = lambda x: (
        F.length(x["description"]).between(1, 600) & F.length(x["evidence_span"]).between(1, 2000) & (x["passage_id"] >= 1) & x["confidence"].between(0, 1) & x["product_type"].isNotNull()
    )
    failed = (
        F.when(~F.col("finish_reason").isin("stop", ""), F.concat(F.lit("output incomplete: "), "finish_reason"))
        .when(p.isNull(), "not the expected JSON")
        .when(F.size(F.array_except("keys", F.array(F.lit("products")))) > 0, "unknown keys")
        .when(~F.forall(p, lambda x: F.coalesce(good(x), F.lit(False))), "a value is out of range")
    )
    return parsed.withColumn("failed", failed).withColumn("products", F.when(failed.isNull(), p)).drop("answer", "keys")


def latest_record(records: DataFrame, paper_doi: Column) -> DataFrame:
    """The highest version of the one record that supplements each paper; two records for one paper are an error."""
    own = records.where(F.col("supplements") == paper_doi)
    best = own.groupBy("inspire_id").agg(F.max_by(F.struct("record_doi", "record_id", "version"), "version").alias("r"), F.count_distinct("record_id").alias("n"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("more than one record: "), F.col("inspire_id").cast("string"))).cast("long")).otherwise(F.col("inspire_id"))
    return best.select(checked.alias("inspire_id"), "r.*")


def check_parts(listed: DataFrame, expected: DataFrame, key: str = "table_doi") -> tuple[DataFrame, DataFrame]:
    """(expected parts that are not listed and must be fetched, listed parts that no record has)."""
    return expected.join(listed, key, "left_anti"), listed.join(expected, key, "left_anti")


def fresh(cache: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Cached responses that are younger than so many seconds and whose URL is the one that their key names."""
    return cache.where((F.col("fetched_at") > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.sha2(F.col("url").cast("binary"), 256) == F.col("key")))


def usable_pages(pages: DataFrame, now: Column, seconds: int, query: str = "query", number: str = "page") -> DataFrame:
    """The cached pages of each query that may stand: those that are fresh and before the first one that is not. From that page on all are fetched live, so that
    a result is never put together of two times."""
    stale = pages.join(fresh(pages, now, seconds).select(query, number), [query, number], "left_anti").groupBy(query).agg(F.min(number).alias("__first"))
    return pages.join(stale, query, "left").where(F.col("__first").isNull() | (F.col(number) < F.col("__first"))).drop("__first")


def cached_answers(requests: DataFrame, cache: DataFrame, providers: list[str]) -> DataFrame:
    """requests (request, hash by provider) with the response of the first provider, in order, that has one."""
    rank = F.array_position(F.array(*map(F.lit, providers)), F.col("provider"))
    hits_ = requests.join(cache, ["provider", "key"]).groupBy("request").agg(F.min_by(F.struct("provider", "response"), rank).alias("hit"))
    return requests.select("request").distinct().join(hits_, "request", "left").select("request", "hit.*")
