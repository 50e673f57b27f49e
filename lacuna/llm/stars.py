"""Classes of sets that are linked, found by stars in place of pairs.

In a bucket (sets that a filter brought together) all members are first compared with one of them, and what is linked is united over all buckets. A bucket whose members are in
one class by then is done, so a group of n near copies costs a multiple of n, not its square. In the others, what is outside a bucket's largest class is compared with all
members of other classes, tile by tile: blocks of bounded size of the one against blocks of the other. A bucket's first member takes no part: it was held against all. Each pair of a bucket is compared or found to be in one class
already, so no link between classes is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import release, scratch, small_batches, staged
from lacuna.llm.components import components

#: Elements of the sets that are compared with one other set in a group, about, or of a block; or one set.
ROOM = 400_000
#: Sets of a block at most.
BLOCK = 256


def common_sizes(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many elements each set of rows has in common with each set of cols (places in sets)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(rows), len(cols)), np.float32)
    width = 4096
    top = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, top, width):
        at = slice(*np.searchsorted(column, [begin, begin + width]))
        dense = np.zeros((len(sets), min(width, top - begin)), np.float32)
        dense[owner[at], column[at] - begin] = 1
        common += dense[rows] @ dense[cols].T
    return common


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each of ids reaches over linked (symmetric)."""
    found = ids.copy()
    while True:
        least = np.where(linked, found[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(found, least)
        if (new == found).all():
            return found
        found = new


LINKS = "x long, v long, similarity double"


def _links(x, v, similarity) -> pa.Table:
    return pa.table({"x": pa.array(x, pa.int64()), "v": pa.array(v, pa.int64()), "similarity": pa.array(similarity, pa.float64())})


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs (x, v), sets (node, size, shingles: the bytes of sorted distinct 64-bit hashes) -> x, v, similarity of the pairs that reach the threshold.

    The sets that are compared with one x are dealt to groups of bounded size, with a copy of x each.
    """
    sizes = sets.select("node", "size")
    sized = pairs.join(sizes.select(F.col("node").alias("v"), "size"), "v").join(sizes.select(F.col("node").alias("x"), F.col("size").alias("own")), "x")
    sized = staged(sized.where(F.least("size", "own") >= threshold * F.greatest("size", "own") - 1e-6).select("x", "v", "size"), "stars-pairs")
    rooms = sized.groupBy("x").agg(F.ceil(F.greatest(F.sum("size") / ROOM, F.count("*") / BLOCK)).cast("int").alias("parts"))
    dealt = staged(sized.join(rooms, "x").select("x", "v", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part")), "stars-dealt")
    members = dealt.select("x", "part", F.col("v").alias("node")).join(sets.select("node", "shingles"), "node")
    centres = dealt.select("x", "part").distinct().join(sets.select(F.col("node").alias("x"), "shingles"), "x").select(F.col("x").alias("node"), "x", "part", "shingles")

    def compare(group: pa.Table) -> pa.Table:
        x = group.column("x")[0].as_py()
        nodes, own = group.column("node").to_pylist(), group.column("shingles").to_pylist()
        centre = next(np.frombuffer(s, np.uint64) for n, s in zip(nodes, own, strict=True) if n == x)
        out = []
        for node, other in ((n, np.frombuffer(s, np.uint64)) for n, s in zip(nodes, own, strict=True) if n != x):
            at = np.minimum(np.searchsorted(centre, other), len(centre) - 1)
            common = int((centre[at] == other).sum())
            union = len(centre) + len(other) - common
            if common >= threshold * union - 1e-9 * union:
                out.append((node, common / union))
        release()
        return _links([x] * len(out), [n for n, _ in out], [s for _, s in out])

    small_batches(pairs.sparkSession)
    return members.unionByName(centres).groupBy("x", "part").applyInArrow(compare, LINKS)


def tiled(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """placed: bucket, node, head (which all were held against before), of (its class), main (the largest class of what is no head), and in how many blocks what is outside main
    (across) and all (down) is cut. -> x, v, similarity: of each tile enough links to unite what is linked in it, and not in one class before."""
    placed = placed.where("node <> head")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # What is outside main asks and answers in one tile; its set is sent there once.
    left = placed.where("of <> main").select("bucket", "node", "of", block("across").alias("a"), every("down").alias("b"), block("down").alias("own"))
    left = left.select("bucket", "node", "of", "a", "b", F.lit(True).alias("asks"), (F.col("b") == F.col("own")).alias("answers"))
    right = placed.select("bucket", "node", "of", "main", every("across").alias("a"), block("down").alias("b"), block("across").alias("own")).where("of = main OR a <> own")
    rows = left.unionByName(right.select("bucket", "node", "of", "a", "b", F.lit(False).alias("asks"), F.lit(True).alias("answers"))).join(sets.select("node", "shingles"), "node")

    def compare(group: pa.Table) -> pa.Table:
        node, of, asks, answers = (group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "of", "asks", "answers"))
        if not asks.any() or not answers.any():
            return _links([], [], [])
        own = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in own], np.float64)
        rows, cols = np.flatnonzero(asks), np.flatnonzero(answers)
        near = np.minimum(sizes[rows][:, None], sizes[cols]) >= threshold * np.maximum(sizes[rows][:, None], sizes[cols]) - 1e-6
        near &= of[rows][:, None] != of[cols]
        rows, cols = rows[near.any(axis=1)], cols[near.any(axis=0)]
        if not len(rows):
            return _links([], [], [])
        chosen = np.concatenate([rows, cols])
        n = len(rows)
        common = common_sizes([own[i] for i in chosen], np.arange(n), np.arange(n, len(chosen)))
        union = sizes[rows][:, None] + sizes[cols] - common
        linked = (common >= threshold * union - 1e-9 * union) & (of[rows][:, None] != of[cols])
        similarity = common / union
        release()
        # Of a class's links in a tile the strongest of each member is enough, as the members of a class are united already.
        both = np.zeros((len(chosen), len(chosen)), bool)
        both[:n, n:] = linked
        both |= both.T
        ids = node[chosen].astype(np.int64)
        root = roots(both, ids)
        touched = np.flatnonzero(both.any(axis=1))
        weakest = similarity[linked].min() if len(touched) else 1.0
        return _links(root[touched], ids[touched], np.full(len(touched), weakest))

    small_batches(placed.sparkSession)
    return rows.groupBy("bucket", "a", "b").applyInArrow(compare, LINKS)


def _across(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs (x, v) that are in two classes."""
    of = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    return pairs.join(of("x"), "x", "left").join(of("v"), "v", "left").where(F.coalesce("of_x", "x") != F.coalesce("of_v", "v")).select("x", "v")


def united(met: DataFrame, sets: DataFrame, threshold: float, before: DataFrame | None = None) -> tuple[DataFrame, float | None]:
    """met: bucket, node, head (the least node of the bucket) -> (node, component) of the nodes that are linked to another, and the similarity of the weakest link found.

    before: classes that are known already. All pairs of nodes in a bucket that reach the threshold end in one class.
    """
    with scratch(met.sparkSession):
        pairs = met.where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("v")).distinct()
        pairs = staged(_across(pairs, before) if before is not None else pairs, "stars-met")
        links = staged(compared(pairs, sets, threshold), "stars-links")
        weakest = links.agg(F.min("similarity")).first()[0]
        classes = _joined(links, before) if weakest is not None or before is None else before

        # A bucket whose head is in one class with each of its members is done.
        apart = staged(_across(pairs.join(links, ["x", "v"], "left_anti"), classes), "stars-apart")
        buckets = met.join(apart.select(F.col("x").alias("head"), F.col("v").alias("node")), ["head", "node"], "left_semi").select("bucket").distinct()
        rows = met.join(staged(buckets, "stars-open"), "bucket", "left_semi").select("bucket", "node", "head")
        weight = F.greatest(F.lit(1), F.ceil(F.col("size") * BLOCK / ROOM).cast("long"))
        placed = rows.join(sets.select("node", weight.alias("weight")), "node").join(classes, "node", "left").select("bucket", "node", "head", "weight", F.coalesce("component", "node").alias("of"))
        placed = staged(placed, "stars-placed")
        # Heads were held against all of their buckets: what is left to compare is among the others.
        sums = placed.where("node <> head").groupBy("bucket", "of").agg(F.sum("weight").alias("w"))
        blocks = lambda w: F.ceil(w / BLOCK).cast("int")
        largest = sums.groupBy("bucket").agg(F.max_by(F.struct("of", "w"), F.struct("w", "of")).alias("main"), F.sum("w").alias("w"), F.count("*").alias("classes")).where("classes > 1")
        largest = staged(largest.select("bucket", F.col("main.of").alias("main"), blocks(F.col("w") - F.col("main.w")).alias("across"), blocks(F.col("w")).alias("down")), "stars-largest")
        placed = staged(placed.join(largest, "bucket"), "stars-several")
        more = staged(tiled(placed, sets, threshold), "stars-links")
        low = more.agg(F.min("similarity")).first()[0]
        if low is None:
            return classes, weakest
        return _joined(more, classes), low if weakest is None else min(low, weakest)


def _joined(links: DataFrame, classes: DataFrame | None) -> DataFrame:
    edges = links.select(F.col("x").alias("u"), "v")
    if classes is not None:
        edges = edges.unionByName(classes.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return staged(components(edges), "stars-classes", keep=True)
