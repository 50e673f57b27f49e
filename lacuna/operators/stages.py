"""The batch stages end to end: sources to passages, answers to products, products and records to gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import scalars, text, vectors
from lacuna.operators import matching, passages, runs


def select_passages(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sources (arxiv_id, tex_files) -> (papers with status, detail, token counts and reduction ratio, their candidate passages). A paper whose files make no
    document, or whose groups do not close, has status filter_error with the reason as detail, and no passages."""
    papers = passages.bodies(passages.documents(sources))
    found = passages.candidates(passages.sections(papers.where("error IS NULL")))
    tokens = found.groupBy("arxiv_id").agg(F.sum(scalars.approx_tokens(F.col("text"))).alias("candidate_tokens"))
    summary = papers.join(tokens, "arxiv_id", "left").withColumn("candidate_tokens", F.when(F.col("error").isNull(), F.coalesce("candidate_tokens", F.lit(0).cast("long"))))
    ratio = F.when(F.col("error").isNull(), scalars.reduction_ratio(F.col("body_tokens").cast("double"), F.col("candidate_tokens")))
    status = F.when(F.col("error").isNull(), "ok").otherwise("filter_error")
    return summary.select("arxiv_id", status.alias("status"), F.col("error").alias("detail"), "main_file", "body_tokens", "candidate_tokens", ratio.alias("reduction_ratio"), "missing_inputs", "skipped_inputs"), found


def prompts(found: DataFrame, paper: str = "arxiv_id", budget: int = 2000) -> DataFrame:
    """A request text for each chunk of a paper's passages."""
    rows = passages.chunks(found, paper, budget)
    ordered = F.array_sort(F.collect_list(F.struct("passage_id", "kind", "section_name", "text")))
    return rows.groupBy(paper, "chunk").agg(text.prompt(ordered).alias("prompt"))


def extracted(answers: DataFrame, chunks: DataFrame, paper: str = "arxiv_id") -> tuple[DataFrame, DataFrame]:
    """answers (paper, chunk, products) against the passages they were asked about -> (verified products, dropped ones with the reason)."""
    rows = answers.select(paper, "chunk", F.posexplode("products").alias("place", "p")).select(paper, "chunk", "place", "p.*")
    checked = passages.verified(rows, chunks, [paper, "chunk"])
    ordinal = F.col("chunk") * 10_000 + F.col("place")
    good = passages.deduped(checked.where("drop_reason IS NULL").withColumn("ordinal", ordinal), [paper])
    return good, checked.where("drop_reason IS NOT NULL")


def reconciled(products: DataFrame, parts: DataFrame, records: DataFrame, embed: Column | None = None, paper: str = "inspire_id") -> DataFrame:
    """products (paper, ordinal, product_type, description, evidence_span, confidence) and parts (paper, ordinal, table_doi, name, description,
    resource_type) -> products without near duplicates, with status, match and severity.

    embed: a function of a text column that gives unit vectors; a bag of hashed words if none.
    """
    embed = embed or (lambda c: vectors.hashed_embedding(text.content_words(c)).cast("array<float>"))
    # Entities are resolved in Python, which higher-order functions take as columns only.
    p = products.withColumn("__clean", text.product_text(F.col("product_type"), F.col("description"))).withColumn("embedding", embed(F.col("__clean"))).drop("__clean")
    p = matching.merge_duplicates(p, paper).withColumn("product", F.col("ordinal"))
    t = parts.withColumns({"__clean": text.table_text(F.col("name"), F.col("description")), "__words": text.clean_text(F.col("description"))})
    t = t.withColumns({"embedding": embed(F.col("__clean")), "words": text.content_words(F.col("__words"))})
    t = t.select(paper, "ordinal", "table_doi", "name", "description", "resource_type", "words", "embedding")
    asked = p.withColumn("__words", text.clean_text(F.col("evidence_span"))).select(paper, "product", "product_type", "embedding", text.content_words(F.col("__words")).alias("span_words"))
    best = matching.best_of(asked, t, [paper, "product"], paper)
    return matching.gaps(p, best, records, paper).drop("product")


def reconcile_statuses(extractions: DataFrame, records: DataFrame, links: DataFrame, paper: str = "inspire_id") -> DataFrame:
    """extractions (paper, status), records (the papers that have one) and links (paper, linked: whether the paper's entry names a record; false for papers without a row)
    -> paper, status, detail: skipped where the extraction is not ok, lookup_error where a record is named but was not found, else ok. Only ok papers are reconciled: a paper
    whose lookup failed has no gaps, and not the gap of a paper without a record."""
    good, others = runs.guarded(extractions.select(paper, "status"), "extract")
    known = good.join(records.select(paper).distinct().withColumn("__record", F.lit(True)), paper, "left").join(links.groupBy(paper).agg(F.bool_or("linked").alias("__linked")), paper, "left")
    lost = F.coalesce("__linked", F.lit(False)) & F.col("__record").isNull()
    looked = known.select(paper, F.when(lost, "lookup_error").otherwise("ok").alias("status"), F.when(lost, "a record is named but was not found").alias("detail"))
    return looked.unionByName(others.select(paper, "status", "detail"))


def extraction_summary(fresh: DataFrame, before: DataFrame | None = None, version: str = "1", stopped: str | None = None) -> DataFrame:
    """One row: extraction_version, papers_attempted, statuses (map of counts), products, dropped_spans, input_tokens, output_tokens and stopped_early (why the run ended early, or null).

    fresh: status, products (array), dropped_spans, input_tokens, output_tokens of the papers that this run asked about. before: the same of papers that were done
    already; they count with their status and products, but this run dropped nothing of theirs and spent nothing on them. Nulls count as none.
    """
    columns = ["status", "products", "dropped_spans", "input_tokens", "output_tokens"]
    rows = fresh.select(*columns).withColumn("__fresh", F.lit(True))
    if before is not None:
        rows = rows.unionByName(before.select(*columns).withColumn("__fresh", F.lit(False)))
    spent = lambda c: F.coalesce(F.sum(F.when(F.col("__fresh"), F.col(c))), F.lit(0)).cast("long").alias(c)
    by = rows.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("products"), F.lit(0))).alias("products"), *[spent(c) for c in columns[2:]])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    named = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("status", F.lit("unknown")).alias("status"), "n"))))
    whole = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("papers_attempted"), named.alias("statuses"), *[total(c) for c in columns[1:]])
    return whole.select(F.lit(version).alias("extraction_version"), "*", F.lit(stopped).cast("string").alias("stopped_early"))


def reconcile_summary(statuses: DataFrame, gaps: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: papers, lookup_errors, products_by_status (map) and mean_readiness_score to one place (null without scores)."""
    one = F.lit(1).alias("__one")
    seen = statuses.agg(F.count("*").alias("papers"), F.count_if(F.col("status") == "lookup_error").alias("lookup_errors")).withColumn("__one", one)
    by = gaps.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("products_by_status")).withColumn("__one", one)
    mean = papers.agg(F.avg("readiness_score").alias("mean")).withColumn("__one", one)
    return seen.join(by, "__one").join(mean, "__one").select("papers", "lookup_errors", "products_by_status", scalars.rounded(F.col("mean"), 1).alias("mean_readiness_score"))
