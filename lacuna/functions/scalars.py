"""Scalar functions of the domain as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions import constants as K


def approx_tokens(text: Column, per_token: float = 4) -> Column:
    return F.ceil(F.length(text) / per_token)


def request_tokens(text: Column, max_output: int, per_token: float = 3.5) -> Column:
    """Tokens that a JSON request may take: characters of all keys and string values, and the output."""
    strings = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    chars = F.aggregate(strings, F.lit(0), lambda a, s: a + F.length(F.regexp_replace(s, r"\\(u[0-9a-fA-F]{4}|.)", "x")))
    return F.ceil(chars / per_token) + max_output


def partial_date(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD; what is missing counts as 1. More parts are an error."""
    parts = F.split(text, "-")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).cast("int"), F.lit(1))
    return F.when(F.size(parts) > 3, F.raise_error(F.concat(F.lit("not a date: "), text))).otherwise(F.make_date(part(0), part(1), part(2)))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, NUL between them; null parts count as empty, so places are kept."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def type_weight(product_type: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in K.TYPE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, product_type), F.lit(1))


def severity(weight: Column, status: Column, confidence: Column) -> Column:
    level = weight - (status == "uncertain").cast("int") - (confidence < 0.5).cast("int")
    return F.when(status == "published", 0).otherwise(F.greatest(F.lit(1), level))


def combined_score(similarity: Column, overlap: Column, bonus: Column) -> Column:
    return 0.5 * similarity + 0.5 * overlap + bonus


def gap_status(structural: Column, has_record: Column, match: Column, typed: Column) -> Column:
    """struct(status, match): the first rule that holds decides. match and typed are structs with similarity, overlap and score, or null."""
    verdict = lambda status, m: F.struct(F.lit(status).alias("status"), m.alias("match"))
    found = (match["overlap"] >= K.PUBLISHED_OVERLAP) | (match["similarity"] >= K.PUBLISHED_SIMILARITY) | (match["score"] >= K.PUBLISHED_SCORE)
    nothing = F.when(F.lit(False), match)
    return (
        F.when(~has_record, verdict("no_record", nothing))
        .when(match.isNull(), verdict("missing", nothing))
        .when(found, verdict("published", match))
        .when(structural & typed.isNotNull() & (typed["similarity"] >= K.STRUCTURAL_SIMILARITY), verdict("published", typed))
        .when(structural & typed.isNotNull(), verdict("uncertain", typed))
        .when(match["score"] >= K.UNCERTAIN_SCORE, verdict("uncertain", match))
        .otherwise(verdict("missing", match))
    )


def reduction_ratio(body: Column, candidate: Column) -> Column:
    return F.when(candidate == 0, F.lit(float("inf"))).otherwise(body / candidate)


def processing_status(filtered: Column, extracted: Column, reconciled: Column) -> Column:
    """How far a paper came; a later stage overrides an earlier one. Null: the stage never saw the paper."""
    return (
        F.when(reconciled == "lookup_error", "reconcile_error")
        .when(reconciled == "ok", "reconciled")
        .when(extracted == "schema_error", "extraction_error")
        .when(extracted == "ok", "extracted")
        .when(filtered.isin("no_arxiv_id", "no_latex", "source_error", "filter_error"), filtered)
        .otherwise("harvested")
    )


def credit(status: Column) -> Column:
    return F.when(status == "published", 1.0).when(status == "uncertain", 0.5).otherwise(0.0)


def readiness(weight: Column, status: Column) -> Column:
    """An aggregate: 0 to 100, null for a group without products."""
    return F.try_divide(100 * F.sum(weight * credit(status)), F.sum(weight).cast("double"))


def percent_text(share: Column) -> Column:
    return F.when(share.isNull(), "n/a").otherwise(F.format_string("%.0f%%", rounded(share * 100, 0)))


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def excerpt(text: Column, limit: int = 400) -> Column:
    return F.substring(collapse(text), 1, limit)


def reader_kind(status: Column) -> Column:
    return F.when(status == "published", "on").when(status == "uncertain", "review").otherwise("missing")


def label(value: Column, labels: dict = K.STATUS_LABELS | K.TYPE_LABELS) -> Column:
    """What a status or a type (or, with other labels, a severity) is called; null for other values."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value)


def part_order(doi: Column) -> list[Column]:
    """Tables before resources, each by number; a suffix without number counts as 0."""
    suffix = F.regexp_extract(doi, r"/([tr])(\d*)$", 2)
    return [F.when(doi.rlike(r"/t\d*$"), 0).otherwise(1).asc(), F.coalesce(suffix.try_cast("int"), F.lit(0)).asc()]


def quoted_title(title: Column) -> Column:
    """struct(part, paper) of a title like "Part" of "Paper"; the second quote may be cut off. Other titles are an error."""
    pattern = r'^"(.+?)" of "(.+?)"?$'
    return F.when(title.rlike(pattern), F.struct(F.regexp_extract(title, pattern, 1).alias("part"), F.regexp_extract(title, pattern, 2).alias("paper"))).otherwise(
        F.raise_error(F.concat(F.lit("not a part's title: "), title)).cast("struct<part:string,paper:string>")
    )


def rounded(value: Column, digits: int) -> Column:
    """Half-even on the exact binary value, to so many digits: built-in rounding looks at the decimal rendering."""

    @F.pandas_udf(T.DoubleType())
    def half_even(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in values:
            yield series.map(lambda x: None if x is None or x != x else round(x, digits))

    return half_even(value.cast("double"))


def python_round4(value: Column) -> Column:
    return rounded(value, 4)


def canonical_json(value: Column) -> Column:
    """A map of strings as JSON with its keys in order and no white space: the same map always gives the same text."""
    quoted = lambda text: F.regexp_replace(F.to_json(F.struct(text.alias("k"))), r"(?s)^\{\"k\":(.*)\}$", "$1")
    pairs = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["value"].isNull(), "null").otherwise(quoted(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def cache_key(provider: Column, model: Column, request: Column) -> Column:
    """What a model's answer to a request (a map) is kept under."""
    return fingerprint(provider, model, canonical_json(request))
