"""Declared products against published parts."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import scalars, text, vectors
from lacuna.staging import staged


def scored_pairs(products: DataFrame, tables: DataFrame, paper: str = "inspire_id") -> DataFrame:
    """Every product with every part of its own paper's record, and the signals that a match rests on.

    products: paper, product, product_type, span_words (array), embedding. tables: paper, ordinal, table_doi, name, description,
    resource_type, words (array), embedding. Words come prepared, once a row; the join is on the paper.
    """
    pairs = products.join(tables.withColumnsRenamed({"embedding": "table_embedding", "words": "table_words"}), paper)
    raw = pairs.withColumns({
        "raw_similarity": vectors.dot(F.col("embedding"), F.col("table_embedding")),
        "raw_overlap": text.overlap(F.col("span_words"), F.col("table_words")),
        "typed": text.fits_type(F.col("product_type"), F.concat_ws(" ", "name", "description", "resource_type")),
    })
    bonus = F.when(F.col("typed"), K.TYPE_BONUS).otherwise(0.0)
    return raw.withColumns({
        "similarity": scalars.python_round4(F.col("raw_similarity")),
        "overlap": scalars.python_round4(F.col("raw_overlap")),
        "bonus": bonus,
        "score": scalars.python_round4(scalars.combined_score(F.col("raw_similarity"), F.col("raw_overlap"), bonus)),
    })


def best_matches(pairs: DataFrame, by: list[str]) -> DataFrame:
    """For each product its best match, and the most similar part that fits its type; of equal ones the first."""
    match = F.struct("table_doi", "similarity", "overlap", "bonus", "score")
    earlier = -F.col("ordinal")
    return pairs.groupBy(*by).agg(
        F.max_by(match, F.struct("score", earlier)).alias("best"),
        F.max_by(F.when(F.col("typed"), match), F.when(F.col("typed"), F.struct("raw_similarity", earlier))).alias("typed"),
    )


#: Rows of a side that a task holds against as many of the other, and those of them that it works on at once.
BLOCK, STRIP = 8192, 256


def best_of(products: DataFrame, tables: DataFrame, by: list[str], paper: str = "inspire_id", block: int = BLOCK) -> DataFrame:
    """best_matches(scored_pairs(products, tables, paper), by), without a row for each pair. by: columns of products.

    Blocks of a paper's products meet blocks of its parts, one task each. A matrix product rules out what is too far below a row's best for the rounding of either to matter; the
    others are scored as pairs are, term by term. A block gives two rows at most for a product. Parts that are alike but for their number are held against products once.
    """
    flaw = lambda: F.coalesce(F.exists("embedding", lambda x: x.isNull()), F.lit(True)).alias("__flaw")
    named = F.concat_ws(" ", "name", "description", "resource_type")
    fits = F.array_compact(F.array(*[F.when(named.rlike(pattern), F.lit(name)) for name, pattern in K.TYPE_PATTERNS.items()]))
    if "fits" in tables.columns:
        fits = F.col("fits")
    keys = list(dict.fromkeys([paper, *by]))
    left = products.select(*keys, "product_type", "span_words", "embedding", flaw(), F.monotonically_increasing_id().alias("__row"))
    right = tables.select(paper, "ordinal", "table_doi", "words", "embedding", flaw(), fits.alias("fits"))
    counts = lambda rows, name: rows.groupBy(paper).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = staged(counts(products, "__ps").join(counts(tables, "__ts"), paper), "match-sizes")
    deal = lambda rows, key, own, others: (
        rows.join(sizes, paper).withColumn(f"__{own}", F.pmod(F.xxhash64(*key), F.col(f"__{own}s")).cast("int")).withColumn(f"__{others}", F.explode(F.sequence(F.lit(0), F.col(f"__{others}s") - 1))).drop("__ps", "__ts")
    )
    left, right = deal(left, by, "p", "t"), deal(right, ["ordinal", "table_doi"], "t", "p")
    # Both may come from one table: the parts' columns are told apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    dealt = [paper, "__p", "__t"]

    def scored(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        found = _best_in_block(one.reset_index(drop=True), other.sort_values("ordinal", kind="stable").reset_index(drop=True))
        return pd.concat([one[by].take(found.pop("__i")).reset_index(drop=True), found], axis=1)

    kind = lambda rows, c: f"`{c}` {rows.schema[c].dataType.simpleString()}"
    schema = ", ".join([*[kind(products, c) for c in by], kind(tables, "ordinal"), kind(tables, "table_doi"), "similarity double, overlap double, bonus double, score double, raw double, grade int, typed boolean"])
    pairs = left.groupBy(*dealt).cogroup(right.groupBy(*dealt)).applyInPandas(scored, schema)
    match, earlier = F.struct("table_doi", "similarity", "overlap", "bonus", "score"), -F.col("ordinal")
    return pairs.groupBy(*by).agg(
        F.max_by(F.when(~F.col("typed"), match), F.when(~F.col("typed"), F.struct("score", earlier))).alias("best"),
        F.max_by(F.when(F.col("typed"), match), F.when(F.col("typed"), F.struct("grade", "raw", earlier))).alias("typed"),
    )


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, filled up with zeros to one length, and the length of each; -1 where it is null or holds a null."""
    found = [np.zeros(0) if flaw else np.asarray(v, np.float64) for v, flaw in zip(rows["embedding"], rows["__flaw"], strict=True)]
    sizes = np.array([len(v) for v in found])
    out = np.zeros((len(found), max(1, sizes.max(initial=0))))
    for row, v in zip(out, found, strict=True):
        row[: len(v)] = v
    return out, np.where(rows["__flaw"].to_numpy(bool), -1, sizes)


def _best_in_block(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
    """one: products; other: parts by ordinal -> __i (place in one) with the block's best match of it, and its best that fits the type (typed)."""
    names = ["__i", "ordinal", "table_doi", "similarity", "overlap", "bonus", "score", "raw", "grade", "typed"]
    bag = lambda words: frozenset() if words is None else frozenset(words)
    marks = [(bytes(np.asarray(v, np.float64)) if v is not None else None, flaw, tuple(w) if w is not None else None, tuple(f)) for v, flaw, w, f in zip(other["embedding"], other["__flaw"], other["words"], other["fits"], strict=True)]
    other = other[~pd.Series(marks, dtype=object).duplicated().to_numpy()].reset_index(drop=True) if len(other) else other
    if not len(one) or not len(other):
        return pd.DataFrame(columns=names)
    (a, a_size), (b, b_size) = _matrix(one), _matrix(other)
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))
    a_words, b_words = [bag(w) for w in one["span_words"]], [bag(w) for w in other["words"]]
    # Null words against others have no overlap, not one of 0.
    a_many, b_many = (np.array([-1 if w is None else len(w) for w in c]) for c in (one["span_words"], other["words"]))
    shared = {w: i for i, w in enumerate(set().union(*a_words) & set().union(*b_words))}
    # Rows whose words are alike are counted once.
    (a_bag, a_bags), (b_bag, b_bags) = _alike(zip(a_words, a_many.tolist(), strict=True)), _alike(zip(b_words, b_many.tolist(), strict=True))

    def overlaps(rows: list[tuple[frozenset, int]]) -> np.ndarray:
        """The overlap of each of these bags with each of the parts; words are taken some at a time."""
        common = np.zeros((len(rows), len(b_bags)), np.float32)
        for begin in range(0, len(shared), 1024):
            flags = []
            for bags in (rows, b_bags):
                m = np.zeros((len(bags), min(1024, len(shared) - begin)), np.float32)
                for i, (words, _) in enumerate(bags):
                    m[i, [shared[w] - begin for w in words if begin <= shared.get(w, -1) < begin + 1024]] = 1
                flags.append(m)
            common += flags[0] @ flags[1].T
        own, others = np.array([n for _, n in rows])[:, None], np.array([n for _, n in b_bags])[None, :]
        fewer = np.minimum(own, others)
        out = np.divide(common, fewer, out=np.zeros(fewer.shape), where=fewer > 0)
        out[(fewer < 0) & (np.maximum(own, others) > 0)] = np.nan
        return out

    of_type = {t: np.array([t in f for f in other["fits"]]) for t in set(one["product_type"])}
    with np.errstate(all="ignore"):
        a_long, reach = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)).max()
    # Vectors of one length and of common numbers, and words without nulls, are ruled out by runs of parts.
    sizes = np.concatenate([a_size, b_size])
    plain = sizes.min() == sizes.max() >= 0 and min(a_many.min(), b_many.min()) >= 0 and bool(a_long.max() < 1e10 and reach < 1e10)
    runs = _runs(_alike(zip(b_bag.tolist(), map(tuple, other["fits"]), strict=True))[0]) if plain else None
    of_a, of_b = (a.astype(np.float32), b[runs[0]].astype(np.float32)) if plain else (a, b)
    none = lambda i, j: (a_size[i] != b_size[j]) | (a_size[i] < 0)
    out = []
    for begin in range(0, len(one), STRIP):
        rows = np.arange(begin, min(len(one), begin + STRIP))
        bags, bag = np.unique(a_bag[rows], return_inverse=True)
        table = overlaps([a_bags[i] for i in bags])
        typed = np.stack([of_type[t] for t in one["product_type"].iloc[rows]])
        if plain:
            slack = (1e-25 + (wide + 8) * 2.0**-22 * a_long[rows] * reach).astype(np.float32)
            first = runs[0][runs[1]]
            near = _near_runs(of_a[rows], of_b, runs, table[bag[:, None], b_bag[first]].T, typed[:, first].T, slack)
        else:
            near = _near(of_a[rows], of_b, table[bag[:, None], b_bag], typed, none(rows[:, None], np.arange(len(b))), a_long[rows] * reach)
        for which, i, j in near:
            out.append(_exact(a, b, rows[i], j, none(rows[i], j), table[bag[i], b_bag[j]], typed[i, j], which))
    found = pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in out[0]})
    rows = other.iloc[found.pop("__j")]
    found[["similarity", "overlap"]] = np.stack([_four(found["raw"]), _four(found["overlap"])], axis=1)
    return found.assign(ordinal=rows["ordinal"].to_numpy(), table_doi=rows["table_doi"].to_numpy())[names]


#: Parts of a run at most.
RUN = 64


def _runs(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts put together by kind (what but their vectors is alike) -> their order, and where in it runs of one kind begin and end."""
    order = np.argsort(kinds, kind="stable")
    of = kinds[order]
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    begins = np.concatenate([np.arange(x, y, RUN) for x, y in zip(edges, [*edges[1:], len(of)], strict=True)])
    return order, begins, np.append(begins[1:], len(of))


def _near_runs(a: np.ndarray, b: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], overlap: np.ndarray, typed: np.ndarray, slack: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """a: products; b: parts in the order of runs; overlap, typed: of runs and products -> the pairs that may be a product's best, and its best of the type (True).

    Within a run the nearest is the best, so all pairs are but multiplied, in single precision, and of a run the most is taken; slack is within what that may be wrong by.
    """
    order, begins, ends = runs
    raw = b @ a.T
    nearest = np.stack([raw[x:y].max(axis=0) for x, y in zip(begins, ends, strict=True)])
    beside = 0.5 * overlap.astype(np.float32) + typed * np.float32(K.TYPE_BONUS)
    for which in (False, True):
        value, room = (np.where(typed, nearest, -np.inf), slack) if which else (0.5 * nearest + beside, slack + np.float32(1.02e-4))
        least = value.max(axis=0) - room
        run, i = np.nonzero(value >= np.where(np.isfinite(least), least, np.inf))
        long = ends[run] - begins[run]
        run, i, j = np.repeat(run, long), np.repeat(i, long), np.arange(long.sum()) + np.repeat(begins[run] - np.cumsum(long) + long, long)
        own = raw[j, i]
        kept = (own if which else 0.5 * own + beside[run, i]) >= least[i]
        yield which, i[kept], order[j[kept]]


def _near(a: np.ndarray, b: np.ndarray, overlap: np.ndarray, typed: np.ndarray, null: np.ndarray, reach: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """As _near_runs(), for vectors and words of any kind: overlap, typed and null (whether there is no product of the two) are of products and parts."""
    top = np.finfo(np.float64).max
    with np.errstate(all="ignore"):
        raw = a @ b.T
        slack = (1e-10 + 1e-10 * np.nan_to_num(reach, nan=0, posinf=0))[:, None]
        score = 0.5 * raw + 0.5 * overlap + typed * K.TYPE_BONUS
    # Null and NaN scores are below all; a raw NaN is above all, a raw null below.
    score = np.where(null, -np.inf, np.nan_to_num(score, nan=-np.inf, posinf=top, neginf=-top))
    raw = np.where(null, -np.inf, np.nan_to_num(raw, nan=np.inf, posinf=top, neginf=-top))
    for which, held, value, room in ((False, None, score, slack + 1.0001e-4), (True, typed, raw, slack)):
        best = value.max(axis=1, keepdims=True) if held is None else np.where(held, value, -np.inf).max(axis=1, keepdims=True)
        with np.errstate(all="ignore"):
            near = value >= np.where(np.isfinite(best), best - room, best)
        if held is not None:
            near &= held
        # Of parts whose value is none or no number the first stands for all.
        first = near & ~np.isfinite(best)
        near &= ~first | (np.cumsum(first, axis=1) == 1)
        yield which, *np.nonzero(near)


def _alike(rows: Iterable) -> tuple[np.ndarray, list]:
    """For each row the number of its value, and the values."""
    numbers: dict = {}
    return np.array([numbers.setdefault(x, len(numbers)) for x in rows], np.int64), list(numbers)


def _four(values: Iterable) -> np.ndarray:
    return np.array([round(x, 4) for x in np.asarray(values).tolist()], np.float64)


#: Pairs whose vectors are multiplied term by term at once.
PAIRS = 8192


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, null: np.ndarray, overlap: np.ndarray, typed: np.ndarray, which: bool) -> dict[str, np.ndarray]:
    """The best of these pairs for each i, as scored_pairs() has them: products of components are added one after the other."""
    raw = np.zeros(len(i))
    with np.errstate(all="ignore"):
        for begin in range(0, len(i), PAIRS):
            at = slice(begin, begin + PAIRS)
            for term in np.ascontiguousarray((a[i[at]] * b[j[at]]).T):
                raw[at] += term
    raw = np.where(null, np.nan, raw)
    bonus = np.where(typed, K.TYPE_BONUS, 0.0)
    score = _four(0.5 * raw + 0.5 * overlap + bonus)
    grade = np.where(null, 0, np.where(np.isnan(raw), 2, 1)) if which else np.where(np.isnan(score), 0, 1)
    value = np.nan_to_num(raw if which else score, nan=0.0, posinf=np.inf, neginf=-np.inf)
    order = np.lexsort((j, -value, -grade, i))
    best = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
    found = {"__i": i, "__j": j, "overlap": overlap, "bonus": bonus, "score": score, "raw": raw, "grade": grade}
    return {**{c: v[best] for c, v in found.items()}, "typed": np.full(len(best), which)}


def gaps(products: DataFrame, matches: DataFrame, records: DataFrame, paper: str = "inspire_id") -> DataFrame:
    """products with status, match and severity. records: the papers that have a record."""
    joined = products.join(matches, [paper, "product"], "left").join(records.select(paper).distinct().withColumn("__record", F.lit(True)), paper, "left")
    verdict = scalars.gap_status(F.col("product_type").isin(*K.STRUCTURAL_TYPES), F.coalesce("__record", F.lit(False)), F.col("best"), F.col("typed"))
    judged = joined.withColumn("verdict", verdict).withColumns({"status": F.col("verdict.status"), "match": F.col("verdict.match")})
    return judged.withColumn("severity", scalars.severity(scalars.type_weight(F.col("product_type")), F.col("status"), F.col("confidence"))).drop("verdict", "best", "typed", "__record")


def readiness(papers: DataFrame, products: DataFrame, paper: str = "inspire_id") -> DataFrame:
    """papers with readiness_score, to one decimal; null for papers without products."""
    scores = products.groupBy(paper).agg(scalars.readiness(scalars.type_weight(F.col("product_type")), F.col("status")).alias("score"))
    scores = scores.select(paper, scalars.rounded(F.col("score"), 1).alias("readiness_score"))
    return papers.join(scores, paper, "left")


#: Groups of so many rows at most are walked in one task; larger ones are worked off in rounds of joins, by many.
WALKED = 2000


def _parted(rows: DataFrame, by: list[str], largest: int) -> tuple[DataFrame, DataFrame]:
    """rows of groups of that size at most, and the others (null is a group as well)."""
    large = rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > largest).select(*[F.col(c).alias(f"__{c}") for c in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    large = staged(large, "large-groups")
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def merge_duplicates(products: DataFrame, paper: str = "inspire_id", similarity: float = K.DUPLICATE_SIMILARITY, walked: int = WALKED) -> DataFrame:
    """products without those that a kept one of the same paper and type is as similar to, the most confident first, ties by ordinal; merged counts them.

    An item is held against kept ones alone, so what is merged depends on the order; a group is one paper's products of one type.
    """

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["confidence", "ordinal"], ascending=[False, True], kind="stable").reset_index(drop=True)
        matrix = np.stack(group["embedding"].map(np.asarray)).astype(np.float64)
        kept: list[int] = []
        merged = np.zeros(len(group), np.int64)
        for i in range(len(group)):
            close = np.flatnonzero(matrix[kept] @ matrix[i] >= similarity) if kept else []
            if len(close):
                merged[kept[close[0]]] += 1
            else:
                kept.append(i)
        return group.iloc[kept].assign(merged=merged[kept])

    schema = products.withColumn("merged", F.lit(0).cast("long")).schema
    small, large = _parted(products, [paper, "product_type"], walked)
    done = small.groupBy(paper, "product_type").applyInPandas(merge, schema)
    if large.isEmpty():
        return done
    return done.unionByName(_merged_in_rounds(large, paper, similarity).select(*[c.name for c in schema]))


def _merged_in_rounds(products: DataFrame, paper: str, similarity: float) -> DataFrame:
    """As the walk, for groups of any size: an item is kept as soon as all better ones that are similar to it are merged, and merged as soon as one of them is kept."""
    rows = products.withColumns({"__id": F.monotonically_increasing_id(), "__group": F.to_json(F.struct(paper, "product_type"))})
    rows = staged(rows, "merge-rows")
    order = F.struct(F.coalesce(-F.col("confidence").cast("double"), F.lit(float("inf"))).alias("c"), "ordinal", "__id")
    places = staged(rows.select("__id", order.alias("place")), "merge-places")
    of = lambda c: places.select(F.col("__id").alias(c), F.col("place").alias(f"place_{c}"))
    pairs = similar_pairs(rows, "__group", "__id", "embedding", similarity).select("a", "b").join(of("a"), "a").join(of("b"), "b")
    first = F.col("place_a") < F.col("place_b")
    either = lambda c: F.when(first, F.col(c.format("a"))).otherwise(F.col(c.format("b")))
    edges = staged(pairs.select(either("{}").alias("better"), either("place_{}").alias("place"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")), "merge-edges")
    left, kept, merged = edges.select("better", "worse"), [], []
    while not left.isEmpty():
        now = staged(left.select(F.col("better").alias("id")).distinct().join(left.select(F.col("worse").alias("id")), "id", "left_anti"), "merge-kept")
        gone = staged(left.join(now.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct(), "merge-gone")
        left = left.join(gone.withColumnRenamed("id", "worse"), "worse", "left_anti").join(gone.withColumnRenamed("id", "better"), "better", "left_anti")
        left = staged(left.select("better", "worse"), "merge-left")
        kept.append(now)
        merged.append(gone)
    if not merged:
        return rows.drop("__id", "__group").withColumn("merged", F.lit(0).cast("long"))
    every = lambda parts: functools.reduce(DataFrame.union, parts)
    # What all better ones were taken from later was kept too; an item counts for the best kept one that it is similar to.
    gone = staged(every(merged), "merge-all-gone")
    owners = edges.join(gone.withColumnRenamed("id", "worse"), "worse", "left_semi").join(gone.withColumnRenamed("id", "better"), "better", "left_anti")
    owned = owners.groupBy("worse").agg(F.min_by("better", "place").alias("__id")).groupBy("__id").agg(F.count("*").alias("merged"))
    stay = rows.join(gone.withColumnRenamed("id", "__id"), "__id", "left_anti").join(owned, "__id", "left")
    return stay.withColumn("merged", F.coalesce("merged", F.lit(0)).cast("long")).drop("__id", "__group")


def assign_one_to_one(pairs: DataFrame, by: str, left: str, right: str, weight: str, walked: int = WALKED) -> DataFrame:
    """The pairs that a greedy assignment takes: heaviest first, ties by left, then right, each left and right once. A group is one paper's pairs; they do not repeat.

    A pair that is the best of both its sides is taken whatever the others do. Groups that are large are worked off by rounds of that; what a round leaves of a group is walked
    in order as soon as it is small, so chains of pairs of which each waits for the next cost no round each.
    """

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([weight, left, right], ascending=[False, True, True], kind="stable")
        lefts, rights, taken = set(), set(), []
        for place, (a, b) in enumerate(zip(group[left], group[right], strict=True)):
            if a not in lefts and b not in rights:
                lefts.add(a)
                rights.add(b)
                taken.append(place)
        return group.iloc[taken]

    small, large = _parted(pairs, [by], walked)
    done = small.groupBy(by).applyInPandas(walk, pairs.schema)
    names = pairs.columns
    while not large.isEmpty():
        # A group without a paper is one as well.
        rows = staged(large.select(*names, F.to_json(F.struct(by)).alias("__by")), "assign-rows")
        least = F.min(F.struct((-F.col(weight).cast("double")).alias("w"), F.col(left).alias("l"), F.col(right).alias("r"))).alias("best")
        of_left = rows.groupBy("__by", left).agg(least).select("__by", F.col("best.l").alias("l"), F.col("best.r").alias("r"))
        of_right = rows.groupBy("__by", right).agg(least).select("__by", F.col("best.l").alias("l"), F.col("best.r").alias("r"))
        taken = staged(of_left.intersect(of_right), "assign-taken")
        done = done.unionByName(rows.join(taken.withColumnsRenamed({"l": left, "r": right}), ["__by", left, right], "left_semi").select(*names))
        rest = rows.join(taken.select("__by", F.col("l").alias(left)), ["__by", left], "left_anti").join(taken.select("__by", F.col("r").alias(right)), ["__by", right], "left_anti")
        small, large = _parted(staged(rest.select(*names), "assign-rest"), [by], walked)
        done = done.unionByName(small.groupBy(by).applyInPandas(walk, pairs.schema))
    return done


def nearest(products: DataFrame, one: DataFrame, k: int = 10) -> DataFrame:
    """The k products nearest to the one row of one (id, embedding), without itself; ties by id."""
    if not 1 <= k <= 50:
        raise ValueError(f"limit must be 1 to 50, not {k}")
    query = one.limit(1).select(F.col("id").alias("__id"), F.col("embedding").alias("__embedding"))
    pairs = products.join(F.broadcast(query), F.col("id") != F.col("__id"))
    return pairs.withColumn("distance", vectors.cosine_distance(F.col("embedding"), F.col("__embedding"))).drop("__id", "__embedding").orderBy("distance", "id").limit(k)


def similar_pairs(rows: DataFrame, by: str, key: str, vector: str, least: float, block: int = 512) -> DataFrame:
    """a, b (keys, a < b), cosine: pairs of rows of the same by whose vectors' product is least or more. Keys do not repeat.

    A group is cut into blocks of about so many rows, and a pair of blocks is one task's matrix product, so a large group is many tasks.
    """
    counts = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    placed = rows.select(by, F.col(key).alias("__key"), F.col(vector).alias("__vector")).join(counts, by).withColumn("__b", F.pmod(F.xxhash64("__key"), F.col("__blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda x: F.struct(F.least("__b", x).alias("low"), F.greatest("__b", x).alias("high")))
    dealt = placed.withColumn("__p", F.explode(others)).select(by, "__key", "__vector", "__b", F.col("__p.low").alias("__low"), F.col("__p.high").alias("__high"))
    kind = rows.schema[key].dataType.simpleString()

    def product(group: pd.DataFrame) -> pd.DataFrame:
        low = (group["__b"] == group["__low"]).to_numpy()
        high = (group["__b"] == group["__high"]).to_numpy()
        keys, matrix = group["__key"].to_numpy(), np.stack(group["__vector"].map(np.asarray)).astype(np.float64)
        cosine = matrix[low] @ matrix[high].T
        i, j = np.nonzero(cosine >= least)
        a, b = keys[low][i], keys[high][j]
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": cosine[i, j]})
        return out[(a < b) if group["__low"].iloc[0] == group["__high"].iloc[0] else (a != b)]

    return dealt.groupBy(by, "__low", "__high").applyInPandas(product, f"a {kind}, b {kind}, cosine double")
