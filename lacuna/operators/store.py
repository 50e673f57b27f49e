"""The tables that results are kept in, and how a run's results get into them without losing ids or reviews."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import scalars
from lacuna.operators import relations

SCHEMAS = {
    "paper": "inspire_id long, arxiv_id string, title string, collaboration string, earliest_date date, hepdata_record_id int, hepdata_record_doi string, hepdata_version int, readiness_score double, "
    "extraction_version string, last_extracted_at timestamp, processing_status string",
    "product": "id long, inspire_id long, fingerprint string, product_type string, description string, evidence_span string, evidence_section string, evidence_kind string, confidence double, embedding array<float>, "
    "is_current boolean, extraction_version string, provider string, model string, merged_duplicates int",
    "part": "id long, table_doi string, hepdata_record_id int, name string, description string, kind string, resource_type string, embedding array<float>",
    "gap": "id long, declared_product_id long, status string, severity int, matched_table_id long, match_score double, embedding_similarity double, caption_overlap double, reconcile_version string",
    "review": "id long, declared_product_id long, verdict string, reviewer string, note string, created_at timestamp",
}
RECORD_FIELDS = ["hepdata_record_id", "hepdata_record_doi", "hepdata_version", "readiness_score"]


@dataclass(frozen=True)
class Tables:
    paper: DataFrame
    product: DataFrame
    part: DataFrame
    gap: DataFrame
    review: DataFrame


def empty(spark: SparkSession) -> Tables:
    return Tables(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def read(spark: SparkSession, folder: str) -> Tables:
    return Tables(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()})


def write(tables: Tables, folder: str) -> None:
    """All tables under a folder of their own: a version is there whole once the caller points to it."""
    for f in fields(tables):
        getattr(tables, f.name).select(*[c.split(" ")[0] for c in SCHEMAS[f.name].split(", ")]).write.parquet(f"{folder}/{f.name}")


POINTER = "number long, folder string"


def publish(tables: Tables, root: str) -> str:
    """Write tables as a new version under root, and then the row that points to it: readers see the version before until all tables are there. The version's folder.

    A run at a time: of two that publish at once, the one that points last is current. A run that breaks off leaves a folder that nothing points to.
    """
    spark = tables.paper.sparkSession
    folder = f"{root}/version-{uuid.uuid4().hex}"
    write(tables, folder)
    last = _pointers(spark, root).agg(F.max("number")).first()[0]
    spark.createDataFrame([((last or 0) + 1, folder)], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/current")
    return folder


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(POINTER).parquet(f"{root}/current")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def current(spark: SparkSession, root: str) -> Tables:
    """The tables of the version that root points to; empty ones before the first."""
    found = _pointers(spark, root).orderBy(F.desc("number")).first()
    return read(spark, found["folder"]) if found else empty(spark)


def _typed(rows: DataFrame, name: str) -> DataFrame:
    """rows as the table's columns and types; columns that rows lack are null."""
    kinds = dict(c.split(" ", 1) for c in SCHEMAS[name].split(", "))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def papers(harvested: DataFrame, filtered: DataFrame, extracted: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Paper rows of a run. A later stage may not have seen a paper. reconciled: whether the record's fields are this run's."""
    joined = (
        harvested.join(filtered.select("inspire_id", F.col("status").alias("filtered")), "inspire_id", "left")
        .join(extracted.select("inspire_id", F.col("status").alias("extracted"), "extraction_version", F.col("modified").alias("last_extracted_at")), "inspire_id", "left")
        .join(reconciled.select("inspire_id", F.col("status").alias("reconciled"), *RECORD_FIELDS), "inspire_id", "left")
    )
    status = scalars.processing_status(F.col("filtered"), F.col("extracted"), F.col("reconciled"))
    ready = joined.withColumns({
        "collaboration": F.array_join(F.coalesce("collaborations", F.array().cast("array<string>")), "; "),
        "earliest_date": scalars.partial_date(F.col("earliest_date")),
        "extraction_version": F.coalesce("extraction_version", F.lit("")),
        "hepdata_record_doi": F.coalesce("hepdata_record_doi", F.lit("")),
        "processing_status": status,
    })
    return _typed(ready, "paper").join(joined.select("inspire_id", (F.coalesce("reconciled", F.lit("")) == "ok").alias("fresh")), "inspire_id")


def run_into(tables: Tables, new_papers: DataFrame, products: DataFrame, parts: DataFrame, reconciled: DataFrame) -> Tables:
    """tables after a run. new_papers: as of papers(). products: inspire_id, ordinal, the product's fields, status, severity and match.
    parts: inspire_id, ordinal and the part's fields. reconciled: inspire_id, hepdata_record_id, extraction_version, reconcile_version of this run's papers.

    Running the same results again changes nothing. A paper that is not reconciled in this run keeps its record's fields. Of a part
    or product that comes twice the last counts. Products of reconciled papers that did not come again are superseded if they have reviews, else deleted with their gaps.
    """
    plain = [c for c in tables.paper.columns if c not in ("inspire_id", *RECORD_FIELDS)]
    fresh = new_papers.where("fresh").drop("fresh")
    paper = relations.upsert(tables.paper, new_papers.where("NOT fresh").drop("fresh"), ["inspire_id"], plain)
    paper = relations.upsert(paper, fresh, ["inspire_id"])

    own = parts.join(reconciled.select("inspire_id", "hepdata_record_id"), "inspire_id")
    part_rows = relations.last_wins(own.select("table_doi", F.struct("inspire_id", "ordinal").alias("place"), "hepdata_record_id", "name", "description", "kind", "resource_type", "embedding"), ["table_doi"], "place")
    part_rows = relations.with_stable_ids(part_rows.drop("place", "seen"), tables.part, ["table_doi"], "id")
    part = relations.upsert(tables.part, _typed(part_rows, "part"), ["table_doi"])

    keyed = products.join(reconciled.select("inspire_id", "extraction_version", "reconcile_version"), "inspire_id")
    keyed = keyed.withColumns({"fingerprint": scalars.fingerprint(F.col("product_type"), F.col("evidence_span"), F.col("description")), "is_current": F.lit(True)})
    product_rows = relations.last_wins(keyed, ["inspire_id", "fingerprint"], "ordinal").drop("seen")
    product_rows = relations.with_stable_ids(product_rows, tables.product, ["inspire_id", "fingerprint"], "id")
    product = relations.upsert(tables.product, _typed(product_rows, "product"), ["inspire_id", "fingerprint"])

    owned = own.select("inspire_id", "table_doi").distinct().join(part.select("table_doi", F.col("id").alias("part_id")), "table_doi")
    linked = product_rows.withColumn("table_doi", F.when(F.col("status") != "no_record", F.col("match.table_doi"))).join(owned, ["inspire_id", "table_doi"], "left")
    gap_rows = linked.select(
        F.col("id").alias("declared_product_id"), "status", "severity", F.col("part_id").alias("matched_table_id"),
        F.col("match.score").alias("match_score"), F.col("match.similarity").alias("embedding_similarity"), F.col("match.overlap").alias("caption_overlap"), "reconcile_version",
    )
    gap_rows = relations.with_stable_ids(gap_rows, tables.gap, ["declared_product_id"], "id")
    gap = relations.upsert(tables.gap, _typed(gap_rows, "gap"), ["declared_product_id"])

    stored = product.join(reconciled.select("inspire_id"), "inspire_id", "left_semi")
    reviews = tables.review.select(F.col("declared_product_id").alias("id"))
    superseded, deleted = relations.split_stale(stored.select("id"), product_rows, reviews, "id")
    product = product.join(deleted, "id", "left_anti")
    product = relations.upsert(product, superseded.withColumn("is_current", F.lit(False)), ["id"], ["is_current"])
    gap = gap.join(deleted.withColumnRenamed("id", "declared_product_id"), "declared_product_id", "left_anti")
    return replace(tables, paper=_typed(paper, "paper"), part=_typed(part, "part"), product=_typed(product, "product"), gap=_typed(gap, "gap"))


def counts(tables: Tables, products: DataFrame, parts: DataFrame) -> DataFrame:
    """What a run brought, repeats included, beside what the tables hold."""
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("products", products).union(count("parts", parts)).union(count("superseded", tables.product.where("NOT is_current")))


def add_review(tables: Tables, product_id: int, verdict: str, reviewer: str, note: str, at) -> Tables:
    """tables with one more review of a current product."""
    if verdict not in ("accepted", "rejected"):
        raise ValueError(f"unknown verdict {verdict!r}")
    if len(note) > 2000:
        raise ValueError("a note has 2000 characters at most")
    if tables.product.where((F.col("id") == product_id) & F.col("is_current")).isEmpty():
        raise LookupError(f"no current product {product_id}")
    last = tables.review.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    row = tables.review.sparkSession.createDataFrame([(last + 1, product_id, verdict, reviewer, note, at)], SCHEMAS["review"])
    return replace(tables, review=tables.review.union(row))
