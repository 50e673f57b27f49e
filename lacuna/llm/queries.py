"""The registered queries of the operators, and their SQL where SQL can express one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, decontaminate, filter_audit, jaccard, langid, neardup, pii, prefix_trie, quality, secrets, token_counts, topk, warc
from lacuna.llm.common import shared_folder, staged, table
from lacuna.llm.spans import count, hex_digest, joined

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = secrets.BY_WINDOW
    kinds = secrets.kinds(options)
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), options=options)
    base = F.col("secrets")
    return found.select(
        "doc_id",
        *[count(base, rank).alias(f"n_{name}") for rank, name in enumerate(secrets.BASE)],
        hex_digest(joined(base, kinds)).alias("base_sha256"),
        joined(F.array_sort(F.concat(base, "entropy_secrets")), kinds).alias("spans"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.col("pii")
    by_rank = F.transform(F.array_sort(F.transform(F.concat(base, "context_pii"), lambda s: F.struct(s["rank"], s["start"], s["end"]))), lambda s: F.struct(s["start"], s["rank"], s["end"]))
    return found.select(
        "doc_id",
        *[count(base, rank).alias(f"n_{name}") for rank, name in enumerate(pii.BASE)],
        hex_digest(joined(base, pii.KINDS)).alias("base_sha256"),
        joined(by_rank, pii.KINDS).alias("spans"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    manifest = staged(warc.write(pages, folder), "warc-manifest")
    files = max(1, manifest.count())
    records = warc.read(manifest.repartition(min(files, 4 * spark.sparkContext.defaultParallelism)), folder)
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, RANKS)
    return decoded.select("doc_id", *bpe.digests(decoded))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    documents = documents.withColumn("held_out", held_out)
    model = langid.train(documents.where(~F.col("held_out") & F.col("doc_id").isNotNull()), "text", "lang", F.xxhash64("doc_id"))
    return langid.predict(documents, model, keep=("doc_id", "held_out"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    best = topk.search(vectors.where("key % 50 = 0"), vectors, k=5)
    return best.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


#: A document is kept from this probability of good quality on.
QUALITY_KEPT = 0.5


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents, model, keep=["doc_id"]).withColumn("keep", F.col("quality_score") >= QUALITY_KEPT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 5
"""

OP11_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
                 + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
                 + 16 * CAST(coalesce(w.doc_id > least, false) AS INT) AS mask
          FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
    o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
    s AS (SELECT filter_order, step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit,
                 CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS INT) AS earlier
          FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
    r AS (SELECT part, filter_order, CAST(step AS INT) AS step, letter,
                 CAST(coalesce(sum(n) FILTER (mask & (bit | earlier) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
                 CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
                 CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost
          FROM c, s GROUP BY part, filter_order, step, letter)
    SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""

OP12_SQL = r"""
    WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn,
                      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS p FROM t),
    c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: list_prepend(CAST(ascii(x) AS BIGINT), list_transform(range(8), lambda i: -1))))),
                 lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS own, p, digest, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
          UNION ALL SELECT c.conv_id, 1, p, digest, words FROM c JOIN o ON o.conv_id = c.conv_id AND p > h),
    m AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS node, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)
          UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    e AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
    n AS (SELECT node, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (m.depth = e.depth), '') AS ends
          FROM m JOIN e USING (conv_id) GROUP BY node, m.depth),
    k AS (SELECT left(node, 64 * (depth - 1)) AS node, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
    s AS (SELECT left(n.node, 64 * d) AS node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved
          FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) n LEFT JOIN k ON k.node = n.node GROUP BY 1)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n u ON n.depth > 0 AND u.node = left(n.node, 64 * (n.depth - 1))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_secrets, op2_pii, op3_token_counts, op4_warc, op5_byte_bpe, op6_decontaminate, op7_language, op8_jaccard_join, op9_topk, op10_quality, op11_filter_audit, op12_prefix_trie, op13_near_duplicates)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op9_topk": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_prefix_trie": OP12_SQL}
