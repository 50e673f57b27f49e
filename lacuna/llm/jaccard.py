"""N-gram Jaccard join over a MinHash LSH forest, with exact verification.

Texts with the same shingles form a class (a node), so copies cost no pairs. A tree of the forest is a prefix trie of signatures: a node's path
is one long, its tree in the top bits and then a few bits of a minhash for each level, so paths in order are the trie in order and a prefix
is a shift. Nodes are matched from the full depth; then the matched prefix is shortened, by what the links found so far are like, until the weakest
of them reaches the target recall. The floor, the depth that reaches it at the threshold itself, tells which paths can ever matter.

Nodes are dealt to cells of fixed size in order of the trie. A task verifies, for a pair of cells, the pairs of nodes that share a prefix of this
depth in some tree and none of the depth before, on whole shingle sets: each pair that the forest brings together is looked at once, others never.
It gives each node its number of links and one link of a spanning forest, never the pairs; verified links alone are united.
Where the classes alone are asked for (one_of_each), stars take the place of cells (stars.py): nodes that are in one class are not compared any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm import bloom
from lacuna.llm.common import fresh_name, map_in_arrow, row_id, scratch, staged
from lacuna.llm.components import components
from lacuna.llm.ordered import running
from lacuna.llm.stars import common_sizes, roots, united
from lacuna.llm.textvec import mix, normalised, shingles, text_slices, word_hashes
from lacuna.llm.wholesets import whole_sets


@dataclass(frozen=True)
class Forest:
    width: int = 5
    threshold: float = 0.8
    trees: int = 48
    #: Levels of each tree, and bits of a level; with 6 bits for the tree they fit a long.
    levels: int = 11
    bits: int = 5
    #: Chance that a pair as similar as the weakest link shares a prefix in some tree.
    recall: float = 0.9995
    #: Verification: nodes and shingles in a cell at most, about (one node may have more shingles).
    cell_nodes: int = 384
    cell_shingles: int = 400_000

    def depth_for(self, similarity: float) -> int:
        """The longest prefix that reaches the target recall for pairs of this similarity."""
        for depth in range(self.levels, 0, -1):
            if 1 - (1 - similarity**depth) ** self.trees >= self.recall:
                return depth
        raise ValueError("the forest has too few trees for the target recall")

    def prefix(self, path: Column, depth: int) -> Column:
        return F.shiftrightunsigned(path, self.bits * (self.levels - depth))


def signature(hashes: np.ndarray, bins: int, borrow: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sorted distinct hashes: the least of each bin; empty bins borrow from bins drawn for them."""
    home = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.concatenate([[True], home[1:] != home[:-1]])
    filled = np.zeros(bins, bool)
    out = np.zeros(bins, np.uint64)
    at = home[first].astype(np.int64)
    filled[at] = True
    out[at] = hashes[first]
    empty = np.flatnonzero(~filled)
    for draw in borrow:
        if not len(empty):
            break
        donor = draw[empty]
        good = filled[donor]
        out[empty[good]] = out[donor[good]]
        empty = empty[~good]
    if len(empty):
        out[empty] = out[at[np.searchsorted(at, empty) % len(at)]]
    return out


def _borrowing(bins: int) -> np.ndarray:
    return np.random.default_rng(20240101).integers(0, bins, (64, bins))


def paths(hashes: np.ndarray, forest: Forest, borrow: np.ndarray) -> np.ndarray:
    """A path for each tree, of sorted distinct shingle hashes: the tree's number, then the lowest bits of each level's minhash."""
    levels = signature(hashes, forest.trees * forest.levels, borrow).reshape(forest.trees, forest.levels) & np.uint64((1 << forest.bits) - 1)
    out = np.arange(forest.trees, dtype=np.uint64)
    for k in range(forest.levels):
        out = (out << np.uint64(forest.bits)) | levels[:, k]
    return out


def _sketches(rows: DataFrame, forest: Forest) -> DataFrame:
    """key, text, text_id -> key, text_id, size, content (16 bytes that stand for the shingle set), paths (array<long>, one for each tree)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borrow = _borrowing(forest.trees * forest.levels)
        for batch in text_slices(batches, 1):
            words, begins = word_hashes(normalised(batch.column(1)))
            sizes, contents, made = [], [], []
            for begin, end in zip(begins[:-1], begins[1:], strict=True):
                own = shingles(words[begin:end], forest.width)
                sizes.append(len(own))
                contents.append(np.array([own.sum(), mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).tobytes() if len(own) else None)
                made.append(paths(own, forest, borrow).view(np.int64) if len(own) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(made, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["key", "text_id", "size", "content", "paths"])

    kind = rows.schema["key"].dataType.simpleString()
    return map_in_arrow(rows.select("key", "text", "text_id"), sketch, f"key {kind}, text_id binary, size long, content binary, paths array<long>")


def grown(trie: DataFrame, forest: Forest, depth: int) -> DataFrame:
    """node, path -> the same, and head, the least node with the same prefix of this depth; nodes alone with theirs are left out."""
    placed = trie.withColumn("prefix", forest.prefix(F.col("path"), depth))
    heads = staged(placed.groupBy("prefix").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("prefix", "head"), "jaccard-heads")
    return placed.join(heads, "prefix").select("node", "path", "head")


def _cells(members: DataFrame, forest: Forest) -> DataFrame:
    """node, size, label and more -> with cell: runs of nodes in order of label, of bounded size, however the rows are dealt.

    Tasks sum up the room that their nodes take, in order; the sums of the range partitions before, a row for each, tell where a task begins. No task sorts all nodes.
    """
    names = members.columns
    at = names.index("size")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = TaskContext.get().partitionId(), 0.0
        for batch in batches:
            ends = used + np.cumsum(np.maximum(1 / forest.cell_nodes, batch.column(at).to_numpy() / forest.cell_shingles))
            begins = np.concatenate([[used], ends[:-1]])
            used = float(ends[-1]) if len(ends) else used
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(begins), pa.array(ends)], names=[*names, "part", "begin", "end"])

    ordered = members.repartitionByRange("label", "node").sortWithinPartitions("label", "node")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in members.schema), "part int, begin double, end double"])
    filled = staged(map_in_arrow(ordered, fill, schema), "jaccard-filled")
    parts = filled.groupBy("part").agg(F.max("end").alias("room"))
    starts = parts.select("part", (F.sum("room").over(Window.orderBy("part")) - F.col("room")).alias("before"))
    return filled.join(F.broadcast(starts), "part").select(*names, F.floor(F.col("before") + F.col("begin")).cast("long").alias("cell"))


def tasks(trie: DataFrame, forest: Forest, depth: int, before: int | None) -> DataFrame:
    """node, path, cell -> node, c1, c2: the pairs of cells in which a node shares a prefix of this depth with another node.

    Where every node of a prefix already shared one of the depth before, the prefix brings nothing new and is left out.
    """
    rows = trie.select("node", "cell", forest.prefix(F.col("path"), depth).alias("prefix"), forest.prefix(F.col("path"), before or forest.levels).alias("child"))
    counts = rows.groupBy("prefix", "cell").agg(F.count("*").alias("n"), F.min("child").alias("low"), F.max("child").alias("high"))
    whole = counts.groupBy("prefix").agg(F.sum("n").alias("all"), F.min("low").alias("low"), F.max("high").alias("high"))
    fresh = whole.where(F.col("all") > 1).where(F.lit(before is None) | (F.col("low") < F.col("high"))).select("prefix")
    counts = staged(counts.select("prefix", "cell", "n").join(fresh, "prefix"), "jaccard-buckets")
    within = rows.join(counts.where("n > 1").select("prefix", "cell"), ["prefix", "cell"]).select("node", F.col("cell").alias("c1"), F.col("cell").alias("c2"))
    # The prefixes of a large group lie in the same cells, time and again: a set of cells is met once, whatever the number of its prefixes.
    spans = counts.groupBy("prefix").agg(F.array_sort(F.collect_set("cell")).alias("cells")).where(F.size("cells") > 1)
    spans = staged(spans.select("prefix", F.xxhash64("cells").alias("span"), "cells"), "jaccard-spans")
    met = rows.join(spans.select("prefix", "span"), "prefix").select("node", "cell", "span").distinct()
    cells = met.join(spans.select("span", "cells").dropDuplicates(["span"]), "span").groupBy("node", "cell").agg(F.array_distinct(F.flatten(F.collect_set("cells"))).alias("cells"))
    across = cells.select("node", "cell", F.explode("cells").alias("other")).where("cell <> other")
    return within.union(across.select("node", F.least("cell", "other").alias("c1"), F.greatest("cell", "other").alias("c2"))).distinct()


def _meet(tries: np.ndarray, shift: int) -> np.ndarray:
    """Which nodes share a prefix in some tree (nodes x trees paths, less so many bits)."""
    shared = np.zeros((len(tries), len(tries)), bool)
    for tree in (tries >> np.uint64(shift)).T:
        shared |= tree[:, None] == tree[None, :]
    return shared


def verified(group: pd.DataFrame, forest: Forest, depth: int, before: int | None) -> pd.DataFrame:
    """node, links within the pair of cells, least node reached, similarity of its weakest link; nodes without links are left out."""
    group = group.sort_values("node", kind="stable")
    ids, second = group["node"].to_numpy(), (group["cell"] > group["c1"]).to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    tries = np.stack([np.frombuffer(x, np.uint64) for x in group["paths"]])
    sizes = np.array([len(x) for x in sets], np.float64)
    look = _meet(tries, forest.bits * (forest.levels - depth))
    if before is not None:
        look &= ~_meet(tries, forest.bits * (forest.levels - before))
    if group["c1"].iloc[0] != group["c2"].iloc[0]:
        look &= second[:, None] != second[None, :]
    np.fill_diagonal(look, False)
    look &= np.minimum(sizes[:, None], sizes) >= forest.threshold * np.maximum(sizes[:, None], sizes) - 1e-6
    similar = np.zeros(look.shape, np.float64)
    parts = roots(look, np.arange(len(ids)))
    order = np.argsort(parts, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
        if len(part) < 2:
            continue
        own = [sets[i] for i in part]
        apart = second[part]
        rows, cols = (np.flatnonzero(~apart), np.flatnonzero(apart)) if apart.any() and not apart.all() else (np.arange(len(part)),) * 2
        common = common_sizes(own, rows, cols)
        found = common / (sizes[part[rows]][:, None] + sizes[part[cols]] - common)
        similar[np.ix_(part[rows], part[cols])] = found
        similar[np.ix_(part[cols], part[rows])] = found.T
    linked = look & (similar >= forest.threshold - 1e-6)
    links = linked.sum(axis=1)
    out = pd.DataFrame({"node": ids, "links": links, "peer": roots(linked, ids), "weakest": np.where(linked, similar, 1.0).min(axis=1)})
    return out[links > 0]


def _verifier(forest: Forest, depth: int, before: int | None):
    return lambda group: verified(group, forest, depth, before)


def _links(trie: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """node, links, peer of all links: from full depth on, prefixes are shortened until the weakest link found reaches the recall."""
    floor, depth, before, found = forest.depth_for(forest.threshold), forest.levels, None, None
    while True:
        with scratch(trie.sparkSession):
            # As a table its size is known: where it is small, the sets are not shuffled for it.
            dealt = staged(tasks(trie, forest, depth, before), "jaccard-tasks")
            found_links = dealt.join(sets, "node").groupBy("c1", "c2").applyInPandas(_verifier(forest, depth, before), "node long, links long, peer long, weakest double")
            new = staged(found_links, "jaccard-found", keep=True)
        found = new if found is None else found.unionByName(new)
        weakest = found.agg(F.min("weakest")).first()[0]
        # No link tells nothing of how similar the others are.
        needed = max(floor, forest.depth_for(max(weakest, forest.threshold))) if weakest is not None else floor
        if needed >= depth:
            return found
        depth, before = needed, depth


def _answers(sketched: DataFrame, rows: DataFrame, forest: Forest) -> DataFrame:
    """content -> class_id, head, n_links, n_copies, for each content of sketched."""
    # A node for each content; the first of its rows stands for it.
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_id"))
    nodes = sketched.where("size > 0").groupBy("content").agg(first.alias("first"), F.min("size").alias("size"), F.count("*").alias("n"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "content", "first", F.col("first.text_id").alias("text_id"), "size", "n"), "jaccard-nodes")
    trie = sketched.select("text_id", "paths").join(nodes.select("text_id", "node"), "text_id").select("node", F.explode("paths").alias("path"))
    with scratch(rows.sparkSession):
        # Repeated rows gave their paths more than once.
        trie = staged(grown(staged(trie, "jaccard-trie"), forest, forest.depth_for(forest.threshold)).distinct(), "jaccard-shared", keep=True)

    # Cells follow the deepest prefix that a node shares, where near copies meet first.
    deep = grown(trie.select("node", "path"), forest, forest.levels).groupBy("node").agg(F.min("head").alias("deep"))
    labels = trie.groupBy("node").agg(F.min("head").alias("head")).join(deep, "node", "left").select("node", F.coalesce("deep", "head").alias("label"))
    with scratch(rows.sparkSession):
        members = staged(_cells(labels.join(nodes.select("node", "text_id", "size"), "node"), forest), "jaccard-members", keep=True)
    trie = staged(trie.join(members.select("node", "cell"), "node").select("node", "path", "cell"), "jaccard-cells")

    # Most texts are in no cell: a filter of the members keeps them from being shuffled.
    spread = rows.sparkSession.sparkContext.broadcast(bloom.build(members.select(F.xxhash64("text_id").alias("hash")), "hash"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borrow = _borrowing(forest.trees * forest.levels)
        for all_rows in batches:
            chosen = pa.array(bloom.may_hold(spread.value, all_rows.column(2).to_numpy().view(np.uint64)))
            for batch in text_slices(iter([all_rows.filter(chosen)]), 1):
                words, begins = word_hashes(normalised(batch.column(1)))
                own = [shingles(words[a:b], forest.width) for a, b in zip(begins[:-1], begins[1:], strict=True)]
                made = [pa.array([s.tobytes() for s in own], pa.binary()), pa.array([paths(s, forest, borrow).tobytes() if len(s) else b"" for s in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["text_id", "shingles", "paths"])

    sets = map_in_arrow(rows.select("text_id", "text", F.xxhash64("text_id").alias("hash")), whole, "text_id binary, shingles binary, paths binary")
    sets = staged(sets.join(members.select("text_id", "node", "cell"), "text_id").select("node", "cell", "shingles", "paths").dropDuplicates(["node"]), "jaccard-sets")
    found = staged(_links(trie, sets, forest).groupBy("node", "peer").agg(F.sum("links").alias("links")), "jaccard-links")

    united = components(found.select(F.col("node").alias("u"), F.col("peer").alias("v")))
    described = (
        nodes.select("content", "node", "first", "n")
        .join(united, "node", "left")
        .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    described = staged(described, "jaccard-described")
    least = staged(described.groupBy("component").agg(F.min("first").alias("least")), "jaccard-classes")
    answers = described.join(least, "component").select(
        "content", F.col("least.key").alias("class_id"), F.col("least.text_id").alias("head"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies")
    )
    return staged(answers, "jaccard-answers", keep=True)


def _united(sketched: DataFrame, rows: DataFrame, forest: Forest) -> DataFrame:
    """As _answers(), without the numbers of links: nodes that are in one class already are not compared.

    What shares a prefix of the floor's depth is all that can matter. Buckets of the full depth are worked off first, then those of the depth that the weakest link found asks for.
    """
    spark = rows.sparkSession
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_id"))
    nodes = sketched.where("size > 0").groupBy("content").agg(first.alias("first"), F.count("*").alias("n"), F.first("paths").alias("paths"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "content", "first", "n", "paths"), "jaccard-nodes")
    floor = forest.depth_for(forest.threshold)

    def met(trie: DataFrame, depth: int) -> DataFrame:
        placed = trie.select(forest.prefix(F.col("path"), depth).alias("bucket"), "node", "path")
        found = running(placed, ["bucket"], ["node", "path"], {"head": ("first", "node")}, "jaccard-buckets", alone=False)
        return found.where("NOT (head = node AND is_end)").select("bucket", "node", "head", "path")

    trie = staged(met(nodes.select("node", F.explode("paths").alias("path")), floor), "jaccard-shared")
    wanted = staged(trie.select("node").distinct().join(nodes.select("node", F.col("first.text_id").alias("text_id")), "node"), "jaccard-wanted")
    cut = lambda texts: (lambda words, begins: [shingles(words[a:b], forest.width) for a, b in zip(begins[:-1], begins[1:], strict=True)])(*word_hashes(normalised(texts)))
    sets = staged(whole_sets(rows, wanted, cut), "jaccard-sets")
    depth, classes, weakest = forest.levels, None, None
    while True:
        with scratch(spark):
            own = trie if depth == floor else staged(met(trie, depth), "jaccard-deep")
            new, low = united(own.select("bucket", "node", "head"), sets, forest.threshold, classes)
            classes = staged(new, "jaccard-united", keep=True)
        weakest = low if weakest is None else weakest if low is None else min(low, weakest)
        needed = max(floor, forest.depth_for(max(weakest, forest.threshold))) if weakest is not None else floor
        if needed >= depth:
            break
        depth = needed
    described = nodes.select("node", "content", "first", "n").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    described = staged(described, "jaccard-described")
    least = staged(described.groupBy("component").agg(F.min("first").alias("least")), "jaccard-classes")
    answers = described.join(least, "component").select("content", F.col("least.key").alias("class_id"), F.col("least.text_id").alias("head"), F.lit(None).cast("long").alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    return staged(answers, "jaccard-answers", keep=True)


def _classes(docs: DataFrame, key: str, text: str, forest: Forest, links: bool = True) -> DataFrame:
    """key, text_id, class_id, head (the text_id of the row that stands for the class), n_links (null if links are not asked for), n_copies: a row for each row of docs."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), content.alias("text"), row_id(F.col(key), content).alias("text_id"))
    # join() reads them when its result is read.
    sketched = staged(_sketches(rows, forest), "jaccard-sketches", keep=links)
    with scratch(docs.sparkSession):
        answers = (_answers if links else _united)(sketched, rows, forest)
    zero = F.lit(0).cast("long")
    return (
        sketched.where("size > 0").join(answers, "content").select("key", "text_id", "class_id", "head", "n_links", "n_copies")
        .unionByName(sketched.where("size = 0").select("key", "text_id", F.col("key").alias("class_id"), F.col("text_id").alias("head"), zero.alias("n_links"), zero.alias("n_copies")))
    )


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", forest: Forest = Forest()) -> DataFrame:
    """key, class_id (the least key of the documents linked to it, over any number of links), n_links (other texts that
    are as similar as the threshold asks), n_copies (other documents with the same shingles): a row for each row of docs.

    Words are runs of letters, marks and digits in lower case; a text of fewer words than a shingle is one shingle. A text without words, empty
    or null, is linked to nothing and its own class. Each of repeated rows is a copy of the others. A null key is the least only of nulls.
    An empty table gives no rows; other columns of docs play no part, whatever their names.
    """
    return _classes(docs, key, text, forest).select(F.col("key").alias(key), "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", forest: Forest = Forest()) -> DataFrame:
    """docs without all but one row of each class of join(): of the rows with the class's key, one.

    Rows are told apart by key and text, so rows that share a key, null and empty keys among them, each stand for themselves; of rows with the
    same key and text one stays. Texts without words all stay.
    Texts that stay are not shuffled: a filter tells which rows may be among those that go, and only these are joined with them.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mark = fresh_name(docs, "row_id")
    with scratch(docs.sparkSession):
        rows = _classes(docs, key, text, forest, links=False).groupBy("text_id").agg(F.bool_or(F.col("text_id") == F.col("head")).alias("stays"), F.count("*").alias("n"), F.max("n_copies").alias("copies"))
        rows = staged(rows, "jaccard-kept")
        gone = staged(rows.where("NOT stays OR (n > 1 AND copies > 0)").select(F.col("text_id").alias(mark)), "jaccard-gone", keep=True)
        more = staged(rows.where("stays AND n > 1 AND copies > 0").select(F.col("text_id").alias(mark)), "jaccard-repeated", keep=True)
    named = docs.withColumn(mark, row_id(F.col(key), content))
    repeated = named.join(more, mark, "left_semi").dropDuplicates([mark])
    spread = docs.sparkSession.sparkContext.broadcast(bloom.build(gone.select(F.xxhash64(mark).alias("hash")), "hash"))

    def may_go(hashes: pa.Array) -> pa.Array:
        return pa.array(bloom.may_hold(spread.value, hashes.to_numpy().view(np.uint64)), pa.bool_())

    asked = F.arrow_udf(may_go, "boolean", F.ArrowUDFType.SCALAR)(F.xxhash64(mark))
    stays = named.where(~asked).unionByName(named.where(asked).join(gone, mark, "left_anti"))
    return stays.drop(mark).unionByName(repeated.drop(mark))
