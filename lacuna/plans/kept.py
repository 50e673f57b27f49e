"""What stores, streams, sinks and totals keep, over the shared tables: each written by the library, read back, and held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.operators import bucketed, cells, matching, runs, serve, stages
from lacuna.operators.bucketed import Bucketed
from lacuna.operators.store import Tables
from lacuna.plans.registry import query, table
from lacuna.plans.served import _WITH, _dotted, tables
from lacuna.sources import staged_json
from lacuna.staging import shared_folder


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
    WITH changes AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey + 10000000, 'N', 5e0 FROM orders WHERE o_orderkey % 11 = 0)
    SELECT coalesce(o.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(o.o_totalprice, c.o_totalprice) AS o_totalprice FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders) o FULL OUTER JOIN changes c ON c.o_orderkey = o.o_orderkey
""")
def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders put into a bucketed table, then changed there twice by the same change."""
    kept = Bucketed(_place(spark, "orders"), ["o_orderkey"])
    stored = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = stored.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    added = stored.where("o_orderkey % 11 = 0").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(5.0).alias("o_totalprice"))
    bucketed.merge(kept, stored)
    for _ in range(2):
        bucketed.merge(kept, changed.unionByName(added), update=["o_orderstatus"])
    return bucketed.read(spark, kept, stored.schema)


@query("SELECT user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event, by a stream over the events whose state keeps who came."""
    from lacuna.streaming import increments

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "ts", "event_id")
    first = increments.first_seen(stream, ["user_id"], "ts")
    place = _place(spark, "first-seen")
    increments.run_once(first, lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}"), f"{place}/checkpoint")
    return spark.read.schema(first.schema).parquet(f"{place}/rows").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query("SELECT source, doc_id, n_chars, lang FROM documents WHERE lang IN ('de', 'en')")
def staged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put down as JSON lines by language and key, twice; of the second run two languages are read back."""
    path, rows = _place(spark, "stage"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    for version in ("0", "1"):
        said = runs.summary(rows.select(F.lit("ok").alias("status"), F.lit(1.0).alias("reduction_ratio")), version=version)
        runs.write_stage(rows, said, path, "doc_id", F.col("lang"))
    return staged_json.read(spark, path, "doc_id long, lang string, source string, n_chars long", ["de", "en"])


@query("""
    WITH r AS (SELECT CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars / 64 END AS ratio FROM documents), s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
    SELECT '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}' AS statuses FROM s
""")
def stage_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("status"), F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") / 64).alias("reduction_ratio"))
    return runs.summary(rows).select(F.to_json("statuses").alias("statuses"))


@query("""
    WITH r AS (SELECT doc_id % 4 = 0 AND quality IS NOT NULL AS before, CASE WHEN quality IS NULL THEN 'schema_error' ELSE 'ok' END AS status, n_chars % 5 AS products, n_chars % 3 AS dropped, n_chars AS tokens FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT status, count(*) AS n FROM r GROUP BY 1)
    SELECT count(*) AS papers_attempted, (SELECT '{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}' FROM s) AS statuses, CAST(sum(products) AS BIGINT) AS products, CAST(sum(dropped) FILTER (NOT before) AS BIGINT) AS dropped_spans,
        CAST(sum(tokens) FILTER (NOT before) AS BIGINT) AS input_tokens, CAST(sum(tokens % 100) FILTER (NOT before) AS BIGINT) AS output_tokens, 'quota' AS stopped_early FROM r
""")
def extraction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth labelled document counts as done in an earlier run."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    count = lambda c, n: F.col(c) % n
    rows = rows.select(
        "doc_id", F.when(F.col("quality").isNull(), "schema_error").otherwise("ok").alias("status"), F.array_repeat(F.lit("p"), count("n_chars", 5).cast("int")).alias("products"), count("n_chars", 3).alias("dropped_spans"),
        F.col("n_chars").alias("input_tokens"), count("n_chars", 100).alias("output_tokens"), ((F.col("doc_id") % 4 == 0) & F.col("quality").isNotNull()).alias("before"),
    )
    said = stages.extraction_summary(rows.where("NOT before"), rows.where("before"), version="1", stopped="quota")
    return said.withColumn("statuses", F.to_json("statuses")).drop("extraction_version")


@query(f"""{_WITH}, f AS (SELECT p.id, p.product_type, p.inspire_id, contains(lower(p.description), 'urgent') AS d, contains(lower(p.evidence_span), 'urgent') AS e, contains(lower(c.title), 'building') AS t FROM product p JOIN paper c ON c.inspire_id = p.inspire_id WHERE p.is_current)
    SELECT f.id, f.product_type, f.inspire_id, round(0.5e0 * (CAST(d AS INT) + 0.2e0 * CAST(e AS INT) + 0.4e0 * CAST(t AS INT)), 6) AS rank, g.status AS gap_status FROM f LEFT JOIN gap g ON g.declared_product_id = f.id WHERE d OR e OR t
""")
def served_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serve.search(tables(spark, sf_dir), "urgent OR buildings")
    return found.select("id", "product_type", "paper.inspire_id", F.round("rank", 6).alias("rank"), "gap_status")


def _vector_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The model's papers and gaps, with vectors as products."""
    model, rows = tables(spark, sf_dir), table(spark, sf_dir, "embeddings")
    product = rows.select(F.col("vec_id").alias("id"), (1 + F.col("label")).cast("long").alias("inspire_id"), F.lit("other").alias("product_type"), F.lit("vector").alias("description"), (F.col("vec_id") % 10 > 0).alias("is_current"), "embedding")
    return Tables(model.paper, product, model.part, model.gap, model.review)


@query(f"""{_WITH}, v AS (SELECT vec_id AS id, 1 + label AS inspire_id, embedding FROM embeddings WHERE vec_id % 10 > 0), q AS (SELECT embedding FROM v WHERE id = 3),
    n AS (SELECT v.id, v.inspire_id, round(1 - {_dotted('v.embedding', 'q.embedding')}, 6) AS distance FROM v, q WHERE v.id <> 3 ORDER BY 1 - {_dotted('v.embedding', 'q.embedding')}, v.id LIMIT 5)
    SELECT n.id, n.distance, g.status AS gap_status, c.inspire_id FROM n LEFT JOIN gap g ON g.declared_product_id = n.id LEFT JOIN paper c ON c.inspire_id = n.inspire_id
""")
def served_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serve.similar(_vector_tables(spark, sf_dir), 3, 5)
    return found.select("id", F.round("distance", 6).alias("distance"), "gap_status", "paper.inspire_id")


#: Words that the SQL below makes of a number: one of them fits the type, others are shared by chance.
_KINDS = ["upper_limit", "cutflow", "cross_section", "other"]
_NAMES = ["limit", "flow", "section", "mass"]


@query(f"""
    WITH p AS (SELECT label, vec_id AS product, ['upper_limit', 'cutflow', 'cross_section', 'other'][vec_id // 2 % 4 + 1] AS kind, list_distinct(['w' || vec_id % 7, 'w' || vec_id % 5, 'w' || vec_id % 3]) AS words, embedding FROM embeddings WHERE vec_id % 2 = 0),
    t AS (SELECT label, vec_id AS part, 'cut' || ['limit', 'flow', 'section', 'mass'][vec_id // 2 % 4 + 1] AS name, CASE WHEN vec_id % 11 = 1 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(['w' || vec_id % 6, 'w' || vec_id % 4]) END AS words, embedding FROM embeddings WHERE vec_id % 2 = 1),
    r AS (SELECT product, part, kind, {_dotted('p.embedding', 't.embedding')} AS similarity, CASE WHEN len(t.words) = 0 THEN 0 ELSE len(list_intersect(p.words, t.words)) / least(len(p.words), len(t.words)) END AS overlap,
        CASE kind WHEN 'upper_limit' THEN regexp_matches(name, '{K.TYPE_PATTERNS['upper_limit']}') WHEN 'cutflow' THEN regexp_matches(name, '{K.TYPE_PATTERNS['cutflow']}') WHEN 'cross_section' THEN regexp_matches(name, '{K.TYPE_PATTERNS['cross_section']}') ELSE false END AS typed FROM p JOIN t USING (label)),
    s AS (SELECT *, CASE WHEN typed THEN 0.1 ELSE 0 END AS bonus, round_even(0.5 * similarity + 0.5 * overlap + CASE WHEN typed THEN 0.1 ELSE 0 END, 4) AS score FROM r)
    SELECT product, arg_max(part, (score, -part)) AS part, max(score) AS score, round_even(arg_max(overlap, (score, -part)), 4) AS overlap, arg_max(bonus, (score, -part))::DOUBLE AS bonus, arg_max(part, (similarity, -part)) FILTER (typed) AS typed_part FROM s GROUP BY 1
""")
def scored_words_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with words and types against parts: overlap, bonus and the best part of the type, beside similarity."""
    rows = table(spark, sf_dir, "embeddings")
    word = lambda n: F.concat(F.lit("w"), (F.col("vec_id") % n).cast("string"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("vec_id") / 2) % 4 + 1).cast("int"))
    products = rows.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("product"), pick(_KINDS).alias("product_type"), F.array_distinct(F.array(word(7), word(5), word(3))).alias("span_words"), "embedding")
    words = F.when(F.col("vec_id") % 11 == 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(word(6), word(4))))
    parts = rows.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("ordinal"), F.col("vec_id").cast("string").alias("table_doi"), F.concat(F.lit("cut"), pick(_NAMES)).alias("name"), F.lit("").alias("description"), F.lit("").alias("resource_type"), words.alias("words"), "embedding")
    best = matching.best_of(products, parts, ["product"], "label")
    return best.select("product", F.col("best.table_doi").cast("long").alias("part"), "best.score", "best.overlap", "best.bonus", F.col("typed.table_doi").cast("long").alias("typed_part"))


@query(f"""
    WITH v AS (SELECT vec_id, embedding, sqrt({_dotted('embedding', 'embedding')}) AS norm FROM embeddings), q AS (SELECT * FROM v ORDER BY vec_id LIMIT 1),
    d AS (SELECT v.vec_id, 1 - {_dotted('v.embedding', 'q.embedding')} / (v.norm * q.norm) AS distance FROM v, q WHERE v.vec_id <> q.vec_id)
    SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 10
""")
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest to the first vector, by an index of cells."""
    rows, place = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _place(spark, "vectors")
    cells.build(rows, place, "vec_id")
    first = rows.orderBy("vec_id").first()
    found = cells.nearest(spark, place, rows.schema, list(first["embedding"]), 10, "vec_id", without=first["vec_id"])
    return found.rows.select("vec_id", F.round("distance", 6).alias("distance"))
