"""The trie of conversations' beginnings, and sums over its subtrees by heavy paths.

A node is a distinct sequence of first turns, known by 128 bits that turns add to by their place (a hash each). Each node's largest child goes on with its path; all
other children begin paths of their own, with at most half of the parent's members each, so no node has more than log2 of all conversations such
edges above it. Sums over subtrees are suffix sums along paths: the paths with the most edges above them come first, and their first nodes' sums are added to
the nodes that they hang on, in as many rounds as there are levels.

No step holds a path, a conversation or a node's members as one: positions, hashes, paths and suffix sums are running values of rows in order (ordered.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import map_in_arrow, scratch, staged
from lacuna.llm.ordered import running

#: Conversations whose numbers are alike but for the last so many begin with turns of the first of them.
FAMILY = 20
#: So many ids at most go into a row of what is hashed.
PACKED = 4096


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family: 0 to 3."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(conversations: DataFrame, name: str = "trie") -> DataFrame:
    """conv, d, x1, x2 (the turn's 128 bits at this place), words: the turns of the rebuilt conversations from d = 1 on, and d = 0 for each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(content, 256)).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lit(1).cast("long").alias("one")
    )
    placed = running(staged(turns, f"{name}-turns"), ["conv"], ["turn", "digest"], {"p": ("sum", "one")}, f"{name}-placed").drop("one", "turn")

    convs = placed.where("p = 1").select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), shared_turns(F.col("conv")).alias("h"))
    heads = staged(placed.where((F.col("conv") % FAMILY == 0) & (F.col("p") <= 3)).select(F.col("conv").alias("base"), "p", "digest", "words"), f"{name}-heads")
    given = convs.where("h > 0").join(heads, "base").where("p <= h").select("conv", F.col("p").alias("d"), "digest", "words")
    # Where the first of the family has fewer turns than are asked for, a conversation's own turns come earlier.
    had = heads.groupBy("base").agg(F.max("p").alias("had"))
    short = convs.where("h > 0").join(had, "base", "left").select("conv", (F.col("h") - F.least("h", F.coalesce("had", F.lit(0)))).alias("missing")).where("missing > 0")
    own = placed.where(F.col("p") > shared_turns(F.col("conv"))).join(staged(short, f"{name}-short"), "conv", "left").select("conv", (F.col("p") - F.coalesce("missing", F.lit(0))).alias("d"), "digest", "words")
    root = placed.where("p = 1").select("conv", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    bits = [F.when(F.col("d") > 0, F.xxhash64(F.lit(seed), "d", "digest")).otherwise(F.lit(0)).cast("long").alias(x) for seed, x in enumerate(("x1", "x2"), 1)]
    return staged(given.unionByName(own).unionByName(root).select("conv", "d", *bits, "words"), f"{name}-rebuilt")


def _ends_hashed(ends: DataFrame) -> DataFrame:
    """s1, s2, conv -> s1, s2, ends_sha256: the hash of the ids in order. Tasks write out ranges of them, a row for some thousands; the hash of one node is
    a chain by its nature, so one task reads these rows in order, a batch at a time."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, conv = (c.to_numpy() for c in batch.columns)
            places = np.arange(len(conv))
            new = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])[: len(conv)]
            cuts = np.flatnonzero(new | ((places - np.maximum.accumulate(np.where(new, places, 0))) % PACKED == 0))
            joined = [",".join(map(str, part.tolist())) for part in np.split(conv, cuts[1:])] if len(conv) else []
            yield pa.RecordBatch.from_arrays([pa.array(s1[cuts]), pa.array(s2[cuts]), pa.array(conv[cuts]), pa.array(joined, pa.string())], names=["s1", "s2", "least", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for s1, s2, ids in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "ids")), strict=True):
                if (s1, s2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (s1, s2), hashlib.sha256(ids.encode())
            yield rows(out)
        if key:
            yield rows([(*key, state.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["s1", "s2", "ends_sha256"])

    ordered = ends.repartitionByRange("s1", "s2", "conv").sortWithinPartitions("s1", "s2", "conv")
    packed = map_in_arrow(ordered.select("s1", "s2", "conv"), written, "s1 long, s2 long, least long, ids string")
    return map_in_arrow(packed.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "least"), hashed, "s1 long, s2 long, ends_sha256 string")


def _paths(walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with n_children, parent_conv_id, the first node (t1, t2) of their path and its level (light edges above it).

    The nodes above a node are those of any of its members; a conversation that is the smallest member of a node stands for it."""
    size = F.struct("n_convs", F.bitwise_not("conv_id"))
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count("*").alias("n_children"), F.max_by(F.struct("s1", "s2"), size).alias("heavy"))
    known = staged(nodes.join(children, ["s1", "s2"], "left"), "trie-children")
    parents = known.where("heavy IS NOT NULL").select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy.s1").alias("h1"), F.col("heavy.s2").alias("h2"))
    light = F.coalesce((F.col("s1") != F.col("h1")) | (F.col("s2") != F.col("h2")), F.lit(True))
    linked = known.join(parents, ["p1", "p2"], "left").select("s1", "s2", "p1", "p2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "words", light.alias("light"))
    linked = staged(linked, "trie-linked")

    chains = walked.where("d > 0").join(linked.select(F.col("conv_id").alias("conv")).distinct(), "conv", "left_semi").select("conv", "s1", "s2").join(linked, ["s1", "s2"])
    top = [F.when(F.col("light"), F.col(s)).alias(t) for s, t in (("s1", "begin1"), ("s2", "begin2"))]
    chains = staged(chains.select("*", *top, F.col("light").cast("long").alias("step")), "trie-chains")
    placed = running(chains, ["conv"], ["depth"], {"t1": ("last", "begin1"), "t2": ("last", "begin2"), "level": ("sum", "step")}, "trie-paths").where("conv = conv_id")
    root = linked.where("depth = 0").withColumns({"t1": F.lit(0).cast("long"), "t2": F.lit(0).cast("long"), "level": F.lit(0).cast("long")})
    columns = ["s1", "s2", "p1", "p2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "words", "level"]
    return placed.select(*columns, *[F.coalesce(t, F.lit(0)).alias(t) for t in ("t1", "t2")]).unionByName(root.select(*columns, "t1", "t2"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id (the node's smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node of the trie
    of the rebuilt conversations.

    A conversation c is rebuilt from the first h turns of conversation c - c % 20 (h: the checksum of c, modulo 4; all it has, if fewer) and its own turns after its first h.
    Turns go by turn, null first; turns alike in it go by the digest of role and text. A null role or text is empty; rows without a conv_id play no part; each of
    repeated rows is a turn. A conversation left without turns is a member of the root. An empty table gives no rows. Other columns play no part.
    """
    with scratch(conversations.sparkSession):
        turns = rebuilt(conversations)
        walked = running(turns, ["conv"], ["d"], {"s1": ("xor", "x1"), "s2": ("xor", "x2")}, "trie-walked")
        parent = [F.when(F.col("d") > 0, F.col(s).bitwiseXOR(F.col(x))).alias(p) for s, x, p in (("s1", "x1", "p1"), ("s2", "x2", "p2"))]
        rows = walked.select("conv", "d", "s1", "s2", "words", "is_end", *parent)
        nodes = rows.groupBy("s1", "s2").agg(*[F.min(c).alias(a) for c, a in (("p1", "p1"), ("p2", "p2"), ("d", "depth"), ("conv", "conv_id"), ("words", "words"))], F.count("*").alias("n_convs"))
        paths = staged(_paths(walked, staged(nodes, "trie-nodes")), "trie-nodes-placed")
        done, attached = None, None
        for level in range(paths.agg(F.max("level")).first()[0] or 0, -1, -1):
            own = paths.where(F.col("level") == level).select("*", F.col("n_children").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (-F.col("depth")).alias("up"))
            if attached is not None:
                added = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
                own = staged(own.join(attached, ["s1", "s2"], "left").withColumns(added).drop("more_leaves", "more_saved"), "trie-level")
            summed = running(own, ["t1", "t2"], ["up"], {"n_leaves": ("sum", "leaves"), "saved_tokens": ("sum", "saved")}, "trie-summed")
            tops = summed.where("s1 = t1 AND s2 = t2 AND depth > 0").groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2"))
            attached = staged(tops.agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")), "trie-attached") if level else None
            done = summed if done is None else done.unionByName(summed)
        ends = _ends_hashed(walked.where("is_end").select("s1", "s2", "conv"))
        result = done.join(ends, ["s1", "s2"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
        return staged(result, "trie", keep=True)
