"""The queries over the tables: triage queue, papers, one paper, statistics, search, similar products, reviews. No model is asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import scalars
from lacuna.operators import matching, relations
from lacuna.operators import search as text_search
from lacuna.operators.store import Tables

# Names that callers use.
PROCESSING = ["harvested", "no_arxiv_id", "no_latex", "source_error", "filter_error", "extracted", "extraction_error", "reconciled", "reconcile_error"]
ORDERINGS = {"readiness": F.asc_nulls_last, "-readiness": F.desc_nulls_first, "date": F.asc_nulls_last, "-date": F.desc_nulls_first}


def choices(raw: str | None, allowed: Sequence[str]) -> list[str]:
    """A comma-separated list; blanks do not count, values that are not allowed are an error."""
    values = [v.strip() for v in (raw or "").split(",") if v.strip()]
    if unknown := sorted(set(values) - set(allowed)):
        raise ValueError(f"unknown values {unknown}, allowed are {list(allowed)}")
    return values


def number(value: int | str | None, low: int, high: int) -> int | None:
    if value is None or value == "":
        return None
    value = int(value)
    if not low <= value <= high:
        raise ValueError(f"{value} is not between {low} and {high}")
    return value


def _in_year(year: int) -> Column:
    """A range, so that files are skipped by their statistics."""
    return (F.col("earliest_date") >= F.make_date(F.lit(year), F.lit(1), F.lit(1))) & (F.col("earliest_date") < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1)))


def _paper_struct() -> Column:
    link = lambda base, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(base), c.cast("string")))
    return F.struct(
        "inspire_id", "arxiv_id", "title", "collaboration", "earliest_date", F.year("earliest_date").alias("year"), "readiness_score", "processing_status",
        link("https://inspirehep.net/literature/", F.col("inspire_id")).alias("inspire_url"), link("https://arxiv.org/abs/", F.col("arxiv_id")).alias("arxiv_url"),
        link("https://www.hepdata.net/record/", F.col("hepdata_record_id")).alias("hepdata_url"),
    )


def papers(tables: Tables, year: int | None = None, processing_status: str | None = None, has_hepdata: str | None = None, ordering: str = "-date") -> DataFrame:
    if has_hepdata not in (None, "true", "false"):
        raise ValueError("has_hepdata is true or false")
    if ordering not in ORDERINGS:
        raise ValueError(f"ordering is one of {list(ORDERINGS)}")
    rows = tables.paper
    if (year := number(year, 1900, 2100)) is not None:
        rows = rows.where(_in_year(year))
    if statuses := choices(processing_status, PROCESSING):
        rows = rows.where(F.col("processing_status").isin(*statuses))
    if has_hepdata:
        rows = rows.where(F.col("hepdata_record_id").isNotNull() if has_hepdata == "true" else F.col("hepdata_record_id").isNull())
    column = "readiness_score" if "readiness" in ordering else "earliest_date"
    return rows.orderBy(ORDERINGS[ordering](column), "inspire_id").select(_paper_struct().alias("paper")).select("paper.*")


def _gap_rows(tables: Tables) -> DataFrame:
    """Gaps of current products with product, latest review, part and match, nested."""
    reviews = relations.latest(tables.review.select("declared_product_id", "created_at", "id", "verdict", "reviewer"), ["declared_product_id"], ["created_at", "id"])
    reviews = reviews.select("declared_product_id", F.struct("verdict", "reviewer", "created_at").alias("latest_review"))
    part = tables.part.select(F.col("id").alias("matched_table_id"), F.struct("table_doi", "name", "description", "kind", "resource_type", F.concat(F.lit("https://doi.org/"), "table_doi").alias("url")).alias("matched_table"))
    product = tables.product.where("is_current").withColumnRenamed("id", "declared_product_id")
    rows = tables.gap.join(product, "declared_product_id").join(reviews, "declared_product_id", "left").join(part, "matched_table_id", "left")
    nested = F.struct(F.col("declared_product_id").alias("id"), "product_type", "description", "evidence_span", "evidence_section", "evidence_kind", "confidence", "merged_duplicates", "extraction_version", "latest_review")
    match = F.when(F.col("match_score").isNotNull(), F.struct(F.col("match_score").alias("score"), "embedding_similarity", "caption_overlap"))
    return rows.select("id", "status", "severity", "inspire_id", nested.alias("product"), "matched_table", match.alias("match"))


def _in_triage_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("severity"), F.desc("product.confidence"), F.asc("id"))


def gaps(tables: Tables, status: str | None = None, product_type: str | None = None, year: int | None = None, severity: int | None = None, min_severity: int | None = None) -> DataFrame:
    """The triage queue. No status, or one of separators alone, means open gaps."""
    rows = _gap_rows(tables).where(F.col("status").isin(*(choices(status, K.GAP_STATUSES) or K.OPEN_STATUSES)))
    if types := choices(product_type, K.PRODUCT_TYPES):
        rows = rows.where(F.col("product.product_type").isin(*types))
    if (severity := number(severity, 0, 3)) is not None:
        rows = rows.where(F.col("severity") == severity)
    if (min_severity := number(min_severity, 0, 3)) is not None:
        rows = rows.where(F.col("severity") >= min_severity)
    paper = tables.paper
    if (year := number(year, 1900, 2100)) is not None:
        paper = paper.where(_in_year(year))
    rows = rows.join(paper.select("inspire_id", _paper_struct().alias("paper")), "inspire_id")
    return _in_triage_order(rows).select("id", "status", "severity", "product", "paper", "matched_table", "match")


def paper_gaps(tables: Tables, inspire_id: int, status: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the paper, its gaps, the parts of its record's version in the record's order); an unknown paper is an error."""
    paper = tables.paper.where(F.col("inspire_id") == inspire_id)
    if paper.isEmpty():
        raise LookupError(f"no paper {inspire_id}")
    rows = _gap_rows(tables).where(F.col("inspire_id") == inspire_id)
    if statuses := choices(status, K.GAP_STATUSES):
        rows = rows.where(F.col("status").isin(*statuses))
    # One row, so its prefix goes into the plan as a literal, and files are skipped by it.
    doi = paper.first()["hepdata_record_doi"]
    own = F.col("table_doi").startswith(f"{doi}/") if doi else F.lit(False)
    parts = tables.part.where(own).drop("embedding").orderBy(*scalars.part_order(F.col("table_doi")))
    return paper.select(_paper_struct().alias("paper")).select("paper.*"), _in_triage_order(rows).drop("inspire_id"), parts


def stats(tables: Tables) -> DataFrame:
    """section, name, value: totals, and counts by status, type and severity. One pass over each table, by grouping sets."""
    current = tables.product.where("is_current")
    open_ = F.col("status").isin(*K.OPEN_STATUSES)
    gap = tables.gap.join(current.select(F.col("id").alias("declared_product_id")), "declared_product_id", "left_semi").select("status", F.when(open_, F.col("severity")).alias("severity"), open_.cast("int").alias("open"))
    count, n = F.count("*").cast("double"), F.col("n")

    def sets(rows: DataFrame, columns: list[str], *more: Column) -> DataFrame:
        out = rows.groupingSets([[], *([c] for c in columns)], *columns).agg(F.grouping_id().alias("g"), count.alias("n"), *more)
        whole = 2 ** len(columns) - 1
        return out.withColumn("by", F.when(F.col("g") == whole, "").otherwise(F.coalesce(*[F.when(F.col("g") == whole - 2 ** (len(columns) - 1 - i), c) for i, c in enumerate(columns)])))

    def row(section: str, name, value) -> Column:
        return F.struct(F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name.cast("string")).alias("name"), value.cast("double").alias("value"))

    def told(rows: DataFrame, totals: list[Column], parts: dict[str, tuple[str, str]]) -> DataFrame:
        made = F.when(F.col("by") == "", F.array(*totals))
        for c, section in parts.items():
            made = made.when(F.col("by") == c, F.array(row(section, F.col(c), n)))
        return rows.select(F.inline(made))

    paper = told(
        sets(tables.paper.select("processing_status", "hepdata_record_id", "readiness_score"), ["processing_status"], F.count("hepdata_record_id").alias("records"), F.avg("readiness_score").alias("mean")),
        [row("papers", "total", n), row("papers", "with_record", F.col("records")), row("papers", "mean_readiness_score", F.col("mean"))], {"processing_status": "papers by processing_status"},
    )
    product = told(sets(current.select("product_type"), ["product_type"]), [row("products", "total", n)], {"product_type": "products by type"})
    gaps_ = told(sets(gap, ["status", "severity"], F.sum("open").alias("opened")), [row("gaps", "open", F.coalesce("opened", F.lit(0)))], {"status": "gaps by status", "severity": "gaps by severity"})
    # Gaps that are not open have no severity here.
    return paper.union(product).union(gaps_.where("section <> 'gaps by severity' OR name IS NOT NULL")).orderBy("section", "name")


def search(tables: Tables, text: str) -> DataFrame:
    """Current products by weighted text rank over description, paper title and quote."""
    product = tables.product.where("is_current").join(tables.paper.select("inspire_id", "title", _paper_struct().alias("paper")), "inspire_id")
    ranks = text_search.search(product.select("id", "description", "title", F.col("evidence_span").alias("evidence")), text)
    gap = tables.gap.select(F.col("declared_product_id").alias("id"), F.col("status").alias("gap_status"), "severity")
    found = ranks.join(product, "id").join(gap, "id", "left")
    return found.orderBy(F.desc("rank"), "id").select("id", "product_type", "description", "evidence_span", "rank", "gap_status", "severity", "paper")


def similar(tables: Tables, product_id: int, limit: int | None = None) -> DataFrame:
    """Current products by cosine distance to a current one; limit 1 to 50, 10 if none."""
    current = tables.product.where("is_current")
    one = current.where(F.col("id") == product_id)
    if one.isEmpty():
        raise LookupError(f"no current product {product_id}")
    near = matching.nearest(current, one, 10 if limit is None else limit)
    gap = tables.gap.select(F.col("declared_product_id").alias("id"), F.col("status").alias("gap_status"))
    rows = near.join(gap, "id", "left").join(tables.paper.select("inspire_id", _paper_struct().alias("paper")), "inspire_id")
    return rows.orderBy("distance", "id").select("id", "product_type", "description", "distance", "gap_status", "paper")


def reviews(tables: Tables, product_id: int) -> DataFrame:
    """A product's reviews, newest first, superseded or not."""
    if tables.product.where(F.col("id") == product_id).isEmpty():
        raise LookupError(f"no product {product_id}")
    return tables.review.where(F.col("declared_product_id") == product_id).orderBy(F.desc("created_at"), F.desc("id"))


def reuse_profile(tables: Tables, inspire_id: int) -> DataFrame:
    """A paper's gaps by status, for a summary."""
    return paper_gaps(tables, inspire_id)[1].groupBy("status").agg(F.count("*").alias("n")).orderBy("status")
