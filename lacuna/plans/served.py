"""The library's operators over the shared tables: the store's tables are made of them by the expressions below, which Spark and the SQL share.

customer stands for papers, orders for products and gaps, part for published parts, events for reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import scalars
from lacuna.operators import evaluation, matching, passages, relations, runs, serve
from lacuna.operators.store import Tables
from lacuna.plans.registry import query, table
from lacuna.sources import readers

MODEL = {
    "paper": ("customer", {
        "inspire_id": "c_custkey", "arxiv_id": "CASE WHEN c_custkey % 5 > 0 THEN concat('x/', c_name) END", "title": "concat(c_mktsegment, ' ', c_name)", "collaboration": "c_mktsegment",
        "earliest_date": "CASE WHEN c_custkey % 11 > 0 THEN make_date(CAST(1990 + c_custkey % 30 AS INT), CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) END",
        "hepdata_record_id": "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey + 1000 AS INT) END", "hepdata_record_doi": "CASE WHEN c_custkey % 3 = 0 THEN concat('h/', c_name) ELSE '' END", "hepdata_version": "1",
        "readiness_score": "CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END", "extraction_version": "'1'", "processing_status": "CASE c_custkey % 3 WHEN 0 THEN 'reconciled' WHEN 1 THEN 'extracted' ELSE 'no_latex' END",
    }),
    "product": ("orders", {
        "id": "o_orderkey", "inspire_id": "o_custkey", "product_type": "CASE o_orderkey % 4 WHEN 0 THEN 'likelihood' WHEN 1 THEN 'cutflow' WHEN 2 THEN 'upper_limit' ELSE 'other' END",
        "description": "concat(o_orderpriority, ' ', o_orderstatus)", "evidence_span": "o_orderpriority", "evidence_section": "o_orderstatus", "evidence_kind": "'caption'", "confidence": "o_totalprice / 500000",
        "is_current": "o_orderkey % 10 > 0", "extraction_version": "'1'", "merged_duplicates": "CAST(o_orderkey % 2 AS INT)",
    }),
    "part": ("part", {
        "id": "p_partkey", "table_doi": "concat('h/Customer#00000000', CAST(p_partkey % 10 AS STRING), '/', CASE WHEN p_partkey % 3 = 0 THEN 'r' ELSE 't' END, CAST(p_partkey AS STRING))",
        "hepdata_record_id": "CAST(p_partkey % 10 + 1000 AS INT)", "name": "p_name", "description": "p_brand", "kind": "CASE WHEN p_partkey % 3 = 0 THEN 'resource' ELSE 'table' END", "resource_type": "p_type", "embedding": "NULL",
    }),
    "gap": ("orders", {
        "id": "o_orderkey + 7", "declared_product_id": "o_orderkey", "status": "CASE WHEN o_orderkey % 7 < 3 THEN 'missing' WHEN o_orderkey % 7 = 3 THEN 'uncertain' WHEN o_orderkey % 7 = 4 THEN 'no_record' ELSE 'published' END",
        "severity": "CAST(CASE WHEN o_orderkey % 7 > 4 THEN 0 ELSE 1 + o_custkey % 3 END AS INT)", "matched_table_id": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 END",
        "match_score": "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 600000 END", "embedding_similarity": "o_totalprice / 700000", "caption_overlap": "o_totalprice / 800000",
    }),
    "review": ("events", {
        "id": "event_id", "declared_product_id": "event_id % 1000", "verdict": "CASE WHEN event_type = 'click' THEN 'accepted' ELSE 'rejected' END", "reviewer": "event_type", "created_at": "ts",
    }),
}
_WITH = "WITH " + ", ".join(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM main.{source})" for name, (source, columns) in MODEL.items())
_LATEST = "SELECT declared_product_id, arg_max(verdict, (created_at, id)) AS verdict, arg_max(reviewer, (created_at, id)) AS reviewer FROM review GROUP BY 1"
_GAPS = f"gap g JOIN product p ON p.id = g.declared_product_id AND p.is_current LEFT JOIN ({_LATEST}) r ON r.declared_product_id = p.id LEFT JOIN part t ON t.id = g.matched_table_id"


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(**{name: table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]) for name, (source, columns) in MODEL.items()})


@query(f"""{_WITH}
    SELECT g.id, g.status, g.severity, p.id AS product_id, p.product_type, p.confidence, r.verdict, r.reviewer, c.inspire_id, CAST(year(c.earliest_date) AS INTEGER) AS paper_year, t.table_doi, g.match_score AS score,
        CASE WHEN c.arxiv_id IS NOT NULL THEN 'https://arxiv.org/abs/' || c.arxiv_id END AS arxiv_url
    FROM {_GAPS} JOIN paper c ON c.inspire_id = p.inspire_id
    WHERE g.status IN ('missing', 'uncertain') AND p.product_type IN ('likelihood', 'cutflow') AND g.severity >= 2 AND c.earliest_date BETWEEN DATE '2006-01-01' AND DATE '2006-12-31'
""")
def served_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serve.gaps(tables(spark, sf_dir), status="missing, uncertain", product_type="likelihood,cutflow", year=2006, min_severity=2)
    return found.select(
        "id", "status", "severity", F.col("product.id").alias("product_id"), "product.product_type", "product.confidence", "product.latest_review.verdict", "product.latest_review.reviewer",
        "paper.inspire_id", F.col("paper.year").alias("paper_year"), "matched_table.table_doi", "match.score", "paper.arxiv_url",
    )


@query(f"""{_WITH}
    SELECT g.id, g.severity, c.inspire_id FROM gap g JOIN product p ON p.id = g.declared_product_id AND p.is_current JOIN paper c ON c.inspire_id = p.inspire_id
    WHERE g.status IN ('missing', 'uncertain', 'no_record') ORDER BY g.severity DESC, p.confidence DESC, g.id LIMIT 25
""")
def served_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the triage queue: open gaps, since no status is asked for."""
    return relations.page(serve.gaps(tables(spark, sf_dir), status=" , "), [F.desc("severity"), F.desc("product.confidence"), F.asc("id")]).select("id", "severity", "paper.inspire_id")


@query(f"""{_WITH}, chosen AS (SELECT *, count(*) OVER () AS total FROM paper WHERE processing_status IN ('reconciled', 'extracted') AND hepdata_record_id IS NOT NULL)
    SELECT inspire_id, readiness_score, 'https://www.hepdata.net/record/' || hepdata_record_id AS hepdata_url, CAST(total AS BIGINT) AS total, total > 50 AS has_next FROM chosen ORDER BY readiness_score ASC NULLS LAST, inspire_id LIMIT 25 OFFSET 25
""")
def served_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serve.papers(tables(spark, sf_dir), processing_status="reconciled,extracted", has_hepdata="true", ordering="readiness")
    return relations.counted_page(rows.select("inspire_id", "readiness_score", "hepdata_url"), [F.asc_nulls_last("readiness_score"), F.asc("inspire_id")], number=2)


@query(f"{_WITH} SELECT g.id, g.status, g.severity, p.confidence, r.verdict FROM {_GAPS} WHERE p.inspire_id = 3 AND g.status IN ('missing', 'published')")
def served_paper_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.paper_gaps(tables(spark, sf_dir), 3, "missing,published")[1].select("id", "status", "severity", "product.confidence", "product.latest_review.verdict")


@query(f"{_WITH} SELECT id, table_doi, name FROM part WHERE starts_with(table_doi, (SELECT hepdata_record_doi || '/' FROM paper WHERE inspire_id = 6))")
def served_record_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.paper_gaps(tables(spark, sf_dir), 6)[2].select("id", "table_doi", "name")


@query(f"""{_WITH}, cur AS (SELECT * FROM product WHERE is_current), g AS (SELECT gap.* FROM gap SEMI JOIN cur ON cur.id = declared_product_id), o AS (SELECT * FROM g WHERE status IN ('missing', 'uncertain', 'no_record'))
    SELECT section, name, CAST(value AS DOUBLE) AS value FROM (
        SELECT 'papers' AS section, 'total' AS name, count(*) AS value FROM paper UNION ALL SELECT 'papers', 'with_record', count(hepdata_record_id) FROM paper UNION ALL SELECT 'papers', 'mean_readiness_score', round(avg(readiness_score), 6) FROM paper
        UNION ALL SELECT 'papers by processing_status', processing_status, count(*) FROM paper GROUP BY 2 UNION ALL SELECT 'products', 'total', count(*) FROM cur UNION ALL SELECT 'products by type', product_type, count(*) FROM cur GROUP BY 2
        UNION ALL SELECT 'gaps', 'open', count(*) FROM o UNION ALL SELECT 'gaps by status', status, count(*) FROM g GROUP BY 2 UNION ALL SELECT 'gaps by severity', CAST(severity AS VARCHAR), count(*) FROM o GROUP BY 2)
""")
def served_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.stats(tables(spark, sf_dir)).select("section", "name", F.round("value", 6).alias("value"))


@query(f"{_WITH} SELECT id, verdict, reviewer, created_at FROM review WHERE declared_product_id = 7")
def served_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.reviews(tables(spark, sf_dir), 7).select("id", "verdict", "reviewer", "created_at")


@query(f"{_WITH} SELECT g.status, count(*) AS n FROM {_GAPS} WHERE p.inspire_id = 9 GROUP BY 1")
def served_reuse_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.reuse_profile(tables(spark, sf_dir), 9)


_WEIGHT = "CASE product_type WHEN 'likelihood' THEN 3 WHEN 'cutflow' THEN 3 WHEN 'upper_limit' THEN 2 ELSE 1 END"


@query(f"""{_WITH}, s AS (SELECT p.inspire_id, CAST({_WEIGHT} AS DOUBLE) AS w, CASE status WHEN 'published' THEN 1e0 WHEN 'uncertain' THEN 5e-1 ELSE 0e0 END AS credit FROM product p JOIN gap ON declared_product_id = p.id)
    SELECT paper.inspire_id, round_even(100 * sum(w * credit) / sum(w), 1) AS readiness FROM paper LEFT JOIN s USING (inspire_id) GROUP BY 1
""")
def readiness_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that lie between two decimals, such as 6.25, go to the even one."""
    model = tables(spark, sf_dir)
    judged = model.product.select("inspire_id", "product_type", "id").join(model.gap.select(F.col("declared_product_id").alias("id"), "status"), "id")
    return matching.readiness(model.paper.select("inspire_id"), judged).select("inspire_id", F.col("readiness_score").alias("readiness"))


@query("SELECT o_orderkey, CAST(CAST(round_even((o_orderkey % 1001) / 1000 * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS share FROM orders")
def percent_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.percent_text((F.col("o_orderkey") % 1001) / 1000).alias("share"))


@query("SELECT round_even((sum(l_quantity) * 0.5 + sum(l_linenumber) * 2) / 1e6, 4) AS cost FROM lineitem")
def request_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("input_tokens"), F.col("l_linenumber").alias("output_tokens"))
    return evaluation.cost(rows, 0.5, 2)


@query("""SELECT event_id, sha256(event_type || chr(0) || 'm1' || chr(0) || '{"k":"' || CAST(props::JSON->>'$.k' AS VARCHAR) || '","type":"' || event_type || '"}') AS key FROM events""")
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", scalars.cache_key(F.col("event_type"), F.lit("m1"), request).alias("key"))


@query("""
    SELECT o_orderkey, 'skipped' AS status, 'filter status ' || coalesce(CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 'no_latex' ELSE 'ok' END, 'unknown') AS detail FROM orders WHERE o_orderstatus <> 'O'
    UNION ALL SELECT o_orderkey, 'ok', NULL FROM orders WHERE o_orderstatus = 'O'
""")
def stage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "no_latex").when(F.col("o_orderstatus") == "O", "ok")
    good, others = runs.guarded(table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")), "filter")
    return others.unionByName(good.withColumn("detail", F.lit(None).cast("string"))).select("o_orderkey", "status", "detail")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderkey % 3 = 0)")
def stage_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    done = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "ok").otherwise("failed").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "2").otherwise("1").alias("version"))
    return runs.pending(orders.select("o_orderkey"), done, "o_orderkey", "2")


@query("""
    WITH r AS (SELECT CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars / 64 END AS ratio FROM documents)
    SELECT '1' AS version, count(*) AS papers, round_even(median(ratio), 2) AS reduction_ratio_median, round_even(min(ratio), 2) AS reduction_ratio_min FROM r
""")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("status"), F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") / 64).alias("reduction_ratio"))
    return runs.summary(rows).drop("statuses")


@query("""
    SELECT 'fetch' AS side, p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) UNION ALL
    SELECT DISTINCT 'unknown', l_partkey FROM lineitem WHERE l_quantity > 40 AND l_partkey NOT IN (SELECT p_partkey FROM part)
""")
def parts_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct()
    fetch, unknown = readers.check_parts(listed, table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return fetch.select(F.lit("fetch").alias("side"), "p_partkey").union(unknown.select(F.lit("unknown"), "p_partkey"))


@query(rf"""
    WITH p AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(replace(replace(text, chr(10), chr(10) || chr(10)), 'License', 'HEPData'), '\n[ \t]*\n')), '^[\s\x85\pZ]+|[\s\x85\pZ]+$', '', 'g') AS t FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, 'Body' AS section_name, 'paragraph' AS kind, count(*) AS passages, CAST(sum(length(t)) AS BIGINT) AS chars FROM p
    WHERE t <> '' AND (regexp_matches(t, '{K.AVAILABILITY}') OR regexp_matches(t, '{K.PRODUCT_WORDS}')) GROUP BY 1
""")
def letter_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as letters, their lines as paragraphs: bodies without headers, which are read like results. License lines stand for what names a repository."""
    line = F.lit("\n")
    body = F.replace(F.replace(F.coalesce("text", F.lit("")), line, F.lit("\n\n")), F.lit("License"), F.lit("HEPData"))
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("arxiv_id"), F.concat(F.lit(r"\begin{document}"), body, F.lit(r"\end{document}")).alias("document"))
    found = passages.candidates(passages.sections(passages.bodies(papers)))
    return found.groupBy("arxiv_id", "section_name", "kind").agg(F.count("*").alias("passages"), F.sum(F.length("text")).alias("chars"))


def _dotted(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query(f"""
    WITH s AS (SELECT a.vec_id AS product, b.vec_id AS part, round_even({_dotted('a.embedding', 'b.embedding')}, 4) AS similarity, round_even(0.5 * {_dotted('a.embedding', 'b.embedding')}, 4) AS score
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
    SELECT product, arg_max(part, (score, -part)) AS part, max(score) AS score FROM s GROUP BY 1
""")
def scored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumns({"label": F.col("label"), "none": F.array().cast("array<string>")})
    products = rows.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("product"), F.lit("other").alias("product_type"), F.col("none").alias("span_words"), "embedding")
    parts = rows.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("ordinal"), F.col("vec_id").cast("string").alias("table_doi"), F.lit("").alias("name"), F.lit("").alias("description"), F.lit("").alias("resource_type"), F.col("none").alias("words"), "embedding")
    best = matching.best_of(products, parts, ["product"], "label")
    return best.select("product", F.col("best.table_doi").cast("long").alias("part"), "best.score")


@query(f"""
    WITH RECURSIVE items AS (SELECT vec_id % 50 AS g, label, vec_id, embedding, row_number() OVER (PARTITION BY vec_id % 50, label ORDER BY (vec_id % 10) / 10 DESC, vec_id) AS i FROM embeddings),
    near AS (SELECT a.g, a.label, a.i, list(b.i ORDER BY b.i) AS before FROM items a JOIN items b ON a.g = b.g AND a.label = b.label AND b.i < a.i AND {_dotted('a.embedding', 'b.embedding')} >= 0.3 GROUP BY 1, 2, 3),
    walk AS (SELECT g, label, CAST(1 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS kept, [CAST(1 AS BIGINT)] AS owner FROM items WHERE i = 1 UNION ALL
        SELECT w.g, w.label, w.i + 1, CASE WHEN h IS NULL THEN list_append(w.kept, w.i + 1) ELSE w.kept END, list_append(w.owner, coalesce(h, w.i + 1)) FROM (
            SELECT w.*, list_filter(w.kept, lambda k: list_contains(n.before, k))[1] AS h FROM walk w JOIN items x ON x.g = w.g AND x.label = w.label AND x.i = w.i + 1 LEFT JOIN near n ON n.g = w.g AND n.label = w.label AND n.i = w.i + 1) w),
    ends AS (SELECT g, label, unnest(owner) AS o FROM walk QUALIFY row_number() OVER (PARTITION BY g, label ORDER BY i DESC) = 1)
    SELECT x.g AS inspire_id, CAST(x.label AS VARCHAR) AS product_type, x.vec_id AS ordinal, count(*) - 1 AS merged FROM ends e JOIN items x ON x.g = e.g AND x.label = e.label AND x.i = e.o GROUP BY 1, 2, 3
""")
def merged_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("inspire_id"), F.col("label").cast("string").alias("product_type"), F.col("vec_id").alias("ordinal"), ((F.col("vec_id") % 10) / 10).alias("confidence"), "embedding")
    return matching.merge_duplicates(rows, similarity=0.3).select("inspire_id", "product_type", "ordinal", "merged")


@query("""
    WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM conversations),
    w AS (SELECT conv_id, i, turn, 0 AS chunk, tokens AS used FROM t WHERE i = 1 UNION ALL
        SELECT t.conv_id, t.i, t.turn, w.chunk + CAST(w.used > 0 AND w.used + t.tokens > 120 AS INTEGER), CASE WHEN w.used > 0 AND w.used + t.tokens > 120 THEN t.tokens ELSE w.used + t.tokens END FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1)
    SELECT conv_id, turn, chunk FROM w
""")
def packed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order put into chunks of a budget of tokens; a turn is never cut."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", scalars.approx_tokens(F.col("text")).alias("tokens")))).alias("t"))
    numbered = turns.withColumn("chunk", passages.chunk_numbers(F.transform("t", lambda x: x["tokens"]), 120))
    return numbered.select("conv_id", F.explode(F.arrays_zip("t", "chunk")).alias("x")).select("conv_id", "x.t.turn", "x.chunk")


@query("""
    WITH r AS (SELECT *, coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(props::JSON->>'$.k' AS DOUBLE) END, value) AS tokens FROM events)
    SELECT event_id, count(*) OVER w AS load_requests, round(sum(tokens) OVER w, 4) AS load_tokens FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)
""")
def settled_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").withColumn("actual", F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").cast("double")))
    return runs.sliding_load(requests, "user_id", "ts", 3600, "value", "actual").select("event_id", "load_requests", F.round("load_tokens", 4).alias("load_tokens"))
