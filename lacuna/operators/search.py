"""Weighted full-text search over products.

A posting holds the positions of a term in one field of a product. A query's terms, phrases and exclusions become one aggregation of the postings of its
terms alone, which are made from the products at hand (search) or read from a stored index (text_index.py). Ranks are sums of the weights of the fields that a term
stands in, damped by repeats; they order like a weighted text rank, but their values are this engine's own.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.stems import stem
from lacuna.staging import small_batches

WEIGHTS = {"description": 1.0, "title": 0.4, "evidence": 0.2}
STOP = "a an and are as at be by for from in is it its of on or that the their this to was were which with".split()


@functools.lru_cache(1 << 18)
def _stem(word: str) -> str:
    """stem(), once for each word that a worker still knows."""
    return stem(word)


def documents(products: DataFrame, key: str = "id", fields: dict[str, float] = WEIGHTS, terms: list[str] | None = None) -> DataFrame:
    """key, field, weight, postings (array of term and sorted positions): a row for each field of each row of products that holds any term. Rows are not put together.

    terms: those that are wanted, all if None. All but the last two letters of a stem begin its words, so other words are dropped before they are stemmed. A word is stemmed
    once for each batch of rows, and no row of a word carries its text.
    """
    parts = [F.struct(F.lit(f).alias("field"), F.lit(w).cast("double").alias("weight"), F.lower(F.col(f)).alias("text")) for f, w in fields.items()]
    rows = products.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.field", "p.weight", "p.text").where("text IS NOT NULL")
    begins = None if terms is None else re.compile("|".join(sorted({re.escape(t[: max(1, len(t) - 2)]) for t in terms})) or "(?!)")
    wanted = None if terms is None else set(terms)

    def term(word: str) -> str | None:
        if not word or word in STOP or (begins and not begins.match(word)):
            return None
        found = _stem(word)
        return found if wanted is None or found in wanted else None

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern_regex(batch.column(3), "[^a-z0-9]+")
            row, words = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists).dictionary_encode()
            names = pa.array([term(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
            of_word = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            of_place = of_word[words.indices.to_numpy(zero_copy_only=False)] if len(row) else row
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(batch.num_rows))[row]
            kept = np.flatnonzero(of_place >= 0)
            group = row[kept] * max(1, len(names.dictionary)) + of_place[kept]
            order = np.argsort(group, kind="stable")
            group, kept = group[order], kept[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(kept)), pa.int32()), pa.array(place[kept], pa.int32()))
            found = pa.StructArray.from_arrays([names.dictionary.take(pa.array(of_place[kept[first]])), positions], ["term", "positions"])
            rows, starts = np.unique(row[kept[first]], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(first)), pa.int32()), found)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(rows)) for i in range(3)], lists], names=[key, "field", "weight", "postings"])

    small_batches(products.sparkSession)
    kind = products.schema[key].dataType.simpleString()
    return rows.mapInArrow(posted, f"`{key}` {kind}, field string, weight double, postings array<struct<term:string,positions:array<int>>>")


def postings(products: DataFrame, key: str = "id", fields: dict[str, float] = WEIGHTS, terms: list[str] | None = None) -> DataFrame:
    """term, key, field, weight, positions (sorted): a row for each term of a product's field; stop words keep their positions but give no rows. terms: as for documents()."""
    rows = documents(products, key, fields, terms).select(key, "field", "weight", F.explode("postings").alias("p")).select("p.term", key, "field", "weight", "p.positions")
    return rows.groupBy("term", key, "field", "weight").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


@dataclass(frozen=True)
class Clause:
    """Terms that stand one after the other, at these distances from the first."""

    terms: tuple[str, ...]
    places: tuple[int, ...]
    excluded: bool = False


def parse(text: str) -> list[list[Clause]]:
    """Web-search syntax: "quoted phrases", OR between alternatives, - before what must not be there. A list of alternatives, of clauses that all hold."""
    if not 2 <= len(text.strip()) <= 200:
        raise ValueError("a query has 2 to 200 characters")
    alternatives: list[list[Clause]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word == "OR" and not minus:
            alternatives.append([])
            continue
        words = [w for w in re.split(r"[^a-z0-9]+", (phrase or word).lower()) if w]
        kept = [(i, stem(w)) for i, w in enumerate(words) if w not in STOP]
        if kept:
            alternatives[-1].append(Clause(tuple(t for _, t in kept), tuple(i - kept[0][0] for i, _ in kept), bool(minus)))
    return [a for a in alternatives if any(not c.excluded for c in a)]


def terms_of(text: str) -> list[str]:
    """The stems that a query asks for."""
    return sorted({t for a in parse(text) for c in a for t in c.terms})


def ranked(found: DataFrame, text: str, key: str = "id") -> DataFrame:
    """found: postings of the query's terms at least -> key and rank of the products that fit the query, best first, ties by key."""
    alternatives = parse(text)
    clauses = list(dict.fromkeys(c for a in alternatives for c in a))
    terms = terms_of(text)
    if not alternatives:
        # Stop words alone fit nothing.
        return found.select(key, F.lit(0.0).alias("rank")).limit(0)
    none = F.array().cast("array<int>")
    hits = found.groupBy(key, "field", "weight").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), none).alias(f"t{i}") for i, t in enumerate(terms)])

    def shifted(column: Column, distance: int) -> Column:
        return F.transform(column, lambda p: p - distance)

    def occurrences(clause: Clause) -> Column:
        columns = [shifted(F.col(f"t{terms.index(t)}"), d) for t, d in zip(clause.terms, clause.places, strict=True)]
        together = columns[0]
        for other in columns[1:]:
            together = F.array_intersect(together, other)
        return F.size(together)

    sums = [F.sum(F.col("weight") * (1 - F.pow(F.lit(0.5), occurrences(c)))).alias(f"c{i}") for i, c in enumerate(clauses)]
    scored = hits.groupBy(key).agg(*sums)
    fits, rank = F.lit(False), F.lit(0.0)
    for a in alternatives:
        every = F.lit(True)
        for c in a:
            there = F.col(f"c{clauses.index(c)}") > 0
            every = every & (~there if c.excluded else there)
        fits = fits | every
    for i, c in enumerate(clauses):
        rank = rank if c.excluded else rank + F.col(f"c{i}")
    return scored.where(fits).select(key, rank.alias("rank")).orderBy(F.desc("rank"), key)


def search(products: DataFrame, text: str, key: str = "id", fields: dict[str, float] = WEIGHTS) -> DataFrame:
    """key and rank of the products that fit the query, best first, ties by key: the postings of the query's terms are made for it."""
    return ranked(postings(products, key, fields, terms_of(text)), text, key)
