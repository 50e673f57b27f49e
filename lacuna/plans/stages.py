"""Work of the batch stages over the shared tables: joins of stages, deduplication, stale rows, upserts, scores, text, vectors, metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import scalars, text, vectors
from lacuna.functions.stems import stemmed
from lacuna.operators import evaluation, matching, passages, relations, search, text_index
from lacuna.plans.registry import query, table
from lacuna.plans.stem_sql import stem_tables
from lacuna.staging import shared_folder


@query("""
    SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'reconciled' WHEN quality = 1 THEN 'reconcile_error' WHEN toxic = 1 THEN 'extraction_error' WHEN quality = 0 THEN 'extracted'
        WHEN lang = 'en' THEN 'no_latex' ELSE 'harvested' END AS status, count(*) AS papers FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
""")
def stage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    filtered = F.when((F.col("lang") == "en") & F.col("quality").isNull(), "no_latex").otherwise("ok")
    extracted = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "schema_error").when(F.col("quality") == 0, "ok")
    reconciled = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ok").when(F.col("quality") == 1, "lookup_error")
    return rows.groupBy(scalars.processing_status(filtered, extracted, reconciled).alias("status")).agg(F.count("*").alias("papers"))


@query("""
    SELECT 'superseded' AS fate, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_custkey IN (SELECT user_id FROM events)
    UNION ALL SELECT 'deleted', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_custkey NOT IN (SELECT user_id FROM events)
""")
def superseded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    reviews = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    kept, gone = relations.split_stale(table(spark, sf_dir, "customer").select("c_custkey"), current, reviews, "c_custkey")
    count = lambda rows, fate: rows.agg(F.count("*").alias("n")).select(F.lit(fate).alias("fate"), "n")
    return count(kept, "superseded").union(count(gone, "deleted"))


@query("""
    WITH d AS (SELECT doc_id, lang, n_chars, lower(regexp_replace(text, '[\\s]+', '', 'g')) AS k FROM documents)
    SELECT arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, min(doc_id) AS first_seen FROM d GROUP BY k
""")
def dedupe_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.sha2(F.lower(scalars.squash(F.col("text"))).cast("binary"), 256)
    rows = table(spark, sf_dir, "documents").select(same.alias("same"), "doc_id", "n_chars")
    return relations.first_of_best(rows, ["same"], "n_chars", "doc_id").select("doc_id", "first_seen")


@query("SELECT l_partkey, max(l_orderkey * 10 + l_linenumber) AS ordinal, count(*) AS seen FROM lineitem GROUP BY 1")
def distinct_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), "l_quantity")
    return relations.last_wins(rows, ["l_partkey"], "ordinal").select("l_partkey", "ordinal", "seen")


@query("""
    SELECT 'missing' AS side, count(*) AS n FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40)
    UNION ALL SELECT 'unknown', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT p_partkey FROM part WHERE p_size < 40)
""")
def set_compare_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_partkey").distinct()
    part = table(spark, sf_dir, "part")
    missing = part.select("p_partkey").distinct().join(listed, F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    unknown = listed.join(part.where("p_size < 40"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    return missing.agg(F.count("*").alias("n")).select(F.lit("missing").alias("side"), "n").union(unknown.agg(F.count("*").alias("n")).select(F.lit("unknown").alias("side"), "n"))


@query("""
    SELECT l_orderkey, count(*) AS pending FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1
""")
def incremental_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "lineitem").join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("pending"))


@query("""
    SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS d FROM orders
""")
def partial_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.element_at(F.array(F.lit("yyyy"), F.lit("yyyy-MM"), F.lit("yyyy-MM-dd")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    written = F.coalesce(*[F.when(shape == p, F.date_format("o_orderdate", p)) for p in ("yyyy", "yyyy-MM", "yyyy-MM-dd")])
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.partial_date(written).alias("d"))


@query("SELECT o_orderkey, sha256(o_orderstatus || chr(0) || o_orderpriority || chr(0) || CAST(o_custkey AS VARCHAR)) AS fingerprint FROM orders")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.fingerprint(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")).alias("fingerprint"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(CASE WHEN l_returnflag = 'A' THEN 0 ELSE greatest(1, l_linenumber - CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END - CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END) END AS INTEGER) AS severity FROM lineitem
""")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "published").when(F.col("l_returnflag") == "N", "uncertain").otherwise("missing")
    confidence = F.when(F.col("l_discount") < 0.05, 0.4).otherwise(0.9)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", scalars.severity(F.col("l_linenumber"), status, confidence).cast("int").alias("severity"))


@query("""
    WITH m AS (SELECT o_orderkey, o_orderstatus AS s, (o_orderkey % 97) / 97 AS sim, (o_custkey % 89) / 89 AS ov, round(0.5 * (o_orderkey % 97) / 97 + 0.5 * (o_custkey % 89) / 89, 4) AS score FROM orders)
    SELECT CASE WHEN s = 'P' THEN 'no_record' WHEN ov >= 0.6 OR sim >= 0.7 OR score >= 0.6 THEN 'published' WHEN s = 'F' AND sim >= 0.5 THEN 'published' WHEN s = 'F' THEN 'uncertain' WHEN score >= 0.42 THEN 'uncertain' ELSE 'missing' END AS status, count(*) AS n
    FROM m GROUP BY 1
""")
def gap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity, overlap = (F.col("o_orderkey") % 97) / 97, (F.col("o_custkey") % 89) / 89
    match = F.struct(similarity.alias("similarity"), overlap.alias("overlap"), F.round(scalars.combined_score(similarity, overlap, F.lit(0.0)), 4).alias("score"))
    verdict = scalars.gap_status(F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "P", match, match)
    return table(spark, sf_dir, "orders").groupBy(verdict["status"].alias("status")).agg(F.count("*").alias("n"))


@query("""
    WITH r AS (SELECT lang, CASE WHEN n_chars % 7 = 0 THEN 'inf'::DOUBLE ELSE CAST(ceil(length(text) / 4) AS DOUBLE) / (n_chars % 7) END AS ratio FROM documents)
    SELECT lang, count(*) AS papers, round(median(ratio), 2) AS median_ratio, round(min(ratio), 2) AS min_ratio FROM r GROUP BY 1
""")
def reduction_ratio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = scalars.reduction_ratio(scalars.approx_tokens(F.col("text")).cast("double"), F.col("n_chars") % 7)
    rows = table(spark, sf_dir, "documents").select("lang", ratio.alias("ratio"))
    return rows.groupBy("lang").agg(F.count("*").alias("papers"), F.round(F.percentile("ratio", 0.5), 2).alias("median_ratio"), F.round(F.min("ratio"), 2).alias("min_ratio"))


@query("""
    SELECT event_type, list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95 FROM events GROUP BY 1
""")
def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.nearest_percentile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95, "p95")


@query("""
    SELECT source, CAST(sum(n_chars) AS BIGINT) AS input_chars, count(*) FILTER (WHERE quality IS NULL) AS dropped, round(sum(n_chars) * 0.5 / 1000000, 4) AS cost FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.sum("n_chars").alias("input_chars"), F.count_if(F.col("quality").isNull()).alias("dropped"), F.round(F.sum("n_chars") * 0.5 / 1000000, 4).alias("cost"))


@query("""
    WITH d AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '[\\s]+', '', 'g') AS t FROM documents), b AS MATERIALIZED (SELECT item_id, regexp_replace(text, '[\\s]+', '', 'g') AS q FROM benchmark)
    SELECT DISTINCT doc_id, item_id FROM d JOIN b ON contains(t, q)
""")
def evidence_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes in texts, white space aside: a join by the hashes of quotes' beginnings and texts' windows, in one scan of the texts."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", scalars.squash(F.col("text")).alias("quote"))
    texts = table(spark, sf_dir, "documents").select("doc_id", scalars.squash(F.col("text")).alias("squashed"))
    return passages.holding(texts, quotes, "squashed", "quote").select("doc_id", "item_id").distinct()


def _windows(name: str, rows: str, key: str, place: str) -> str:
    """CTEs: the hashes of all runs of 40 characters of a text without white space, cut out of blocks so that no long text is walked for each."""
    return rf"""
    {name}_t AS (SELECT {key}, regexp_replace(text, '[\s]+', '', 'g') AS t FROM {rows} WHERE text <> ''),
    {name}_b AS (SELECT {key}, b, substr(t, b * 1000 + 1, 1039) AS s FROM (SELECT {key}, t, unnest(range(0, (length(t) - 40) // 1000 + 1)) AS b FROM {name}_t WHERE length(t) >= 40)),
    {name} AS (SELECT {key}, b * 1000 + k AS {place}, hash(substr(s, k, 40)) AS h FROM (SELECT {key}, b, s, unnest(range(1, least(1000, length(s) - 39) + 1)) AS k FROM {name}_b))"""


@query(f"""
    WITH {_windows('w', 'documents', 'doc_id', 'i')}, {_windows('v', 'benchmark', 'item_id', 'j')},
    m AS (SELECT doc_id, item_id, i, i - j AS diagonal FROM w JOIN v USING (h)),
    r AS (SELECT doc_id, item_id, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS run, diagonal FROM m)
    SELECT doc_id, item_id, max(n) + 39 AS overlap FROM (SELECT doc_id, item_id, count(*) AS n FROM r GROUP BY doc_id, item_id, diagonal, run) GROUP BY 1, 2
""")
def quote_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest passage that a document shares with an item, as of a prediction and a gold item; all are one paper's here."""
    predicted = table(spark, sf_dir, "documents").select(F.lit(1).alias("inspire_id"), F.col("doc_id").alias("prediction"), F.col("text").alias("evidence_span"))
    gold = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("inspire_id"), F.col("item_id").alias("gold_id"), F.array("text").alias("quotes"))
    return evaluation.overlaps(predicted, gold).where(F.col("overlap") >= evaluation.MIN_OVERLAP).select(F.col("prediction").alias("doc_id"), F.col("gold_id").alias("item_id"), "overlap")


@query("""
    WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND x NOT IN (STOPS))) AS words FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN least(len(a.words), len(b.words)) > 0 THEN len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) ELSE 0 END, 6) AS overlap FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""".replace("STOPS", ", ".join(f"'{w}'" for w in K.STOP_WORDS)))
def caption_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_words(F.col("text")).alias("words"))
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("other"))
    return rows.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.overlap(F.col("words"), F.col("other")), 6).alias("overlap"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS chars FROM pages")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.strip_tags(F.col("html"))).cast("long").alias("chars"))


@query("SELECT doc_id, count(*) AS passages FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, 'license|copyright|licensed', 'i') GROUP BY 1")
def availability_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.col("line").rlike("(?i)license|copyright|licensed")).groupBy("doc_id").agg(F.count("*").alias("passages"))


@query("SELECT doc_id, length(trim(text)) AS chars, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.trim("text")).cast("long").alias("chars"), scalars.approx_tokens(F.col("text")).alias("tokens"))


@query()
def split_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(passages.split_text(F.col("text"), 200)).alias("piece", "text"))
    return pieces.select("doc_id", "piece", F.length("text").alias("chars"))


@query()
def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("arxiv_id"), F.col("turn").alias("ordinal"), F.lit(0).alias("start"), F.col("role").alias("section_name"), F.lit("paragraph").alias("kind"), "text")
    return passages.chunks(turns, budget=200).select(F.col("arxiv_id").alias("conv_id"), "chunk", "passage_id", F.length("text").alias("chars"))


def _dotted(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_dotted('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_dotted('a.embedding', 'b.embedding')} >= 0.35")
def dedupe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.similar_pairs(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.35)
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT v.vec_id, round(1 - {_dotted('v.embedding', 'q.embedding')}, 6) AS distance FROM embeddings v, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE v.vec_id <> q.vec_id ORDER BY 1 - {_dotted('v.embedding', 'q.embedding')}, v.vec_id LIMIT 10")
def knn_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    near = matching.nearest(rows, rows.orderBy("id"), k=10)
    return near.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(f"SELECT a.vec_id, arg_max(b.vec_id, ({_dotted('a.embedding', 'b.embedding')}, -b.vec_id)) AS best FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1")
def best_match_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, none = table(spark, sf_dir, "embeddings"), F.array().cast("array<string>")
    products = rows.where("vec_id % 2 = 0").select("label", "vec_id", F.lit("any").alias("product_type"), none.alias("span_words"), "embedding")
    parts = rows.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("ordinal"), F.col("vec_id").alias("table_doi"), *[F.lit("").alias(c) for c in ("name", "description", "resource_type")], none.alias("words"), F.array(F.lit("any")).alias("fits"), "embedding")
    # All parts fit, so what counts is the product of vectors as it is, not a rounded score.
    return matching.best_of(products, parts, ["vec_id"], "label").select("vec_id", F.col("typed.table_doi").alias("best"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.norm(vectors.unit(v)), 9).alias("unit_norm"))


@query()
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("inspire_id"), F.col("label").cast("string").alias("product_type"), F.col("vec_id").alias("ordinal"), ((F.col("vec_id") % 10) / 10).alias("confidence"), "embedding")
    return matching.merge_duplicates(rows, similarity=0.3).select("inspire_id", "product_type", "ordinal", "merged")


@query("""
    SELECT source, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn, count(*) FILTER (WHERE NOT p AND NOT a) AS tn, count(*) FILTER (WHERE a IS NULL) AS uncertain
    FROM (SELECT source, n_chars > 1000 AS p, quality = 1 AS a FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1
""")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluation.confusion(rows, F.col("n_chars") > 1000, F.col("quality") == 1, ["source"])


@query("""
    WITH c AS (SELECT lang, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn FROM (SELECT lang, n_chars > 100000 OR (n_chars > 1000 AND lang <> 'de') AS p, quality = 1 AS a FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1),
    s AS (SELECT lang, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c)
    SELECT lang, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM s
""")
def prf_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    said = (F.col("n_chars") > 100000) | ((F.col("n_chars") > 1000) & (F.col("lang") != "de"))
    scored = evaluation.with_scores(evaluation.confusion(rows, said, F.col("quality") == 1, ["lang"]))
    return scored.select("lang", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
    WITH m AS (SELECT 'quality' AS name, avg(quality) AS value FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels)
    SELECT t.name, t.least, m.value FROM (VALUES ('quality', 0.5::DOUBLE), ('toxic', 0.5::DOUBLE), ('recall', 0.1::DOUBLE)) t(name, least) LEFT JOIN m ON m.name = t.name WHERE m.value IS NULL OR m.value < t.least
""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    metrics = labels.unpivot([], ["quality", "toxic"], "name", "value")
    return evaluation.gate(metrics, {"min_quality": 0.5, "min_toxic": 0.5, "min_recall": 0.1}).select("name", "least", "value")


@query("""
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS number, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS following, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS so_far FROM conversations
""")
def conversation_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("number"), F.lead("turn").over(w).alias("following"), F.sum(F.length("text")).over(w).alias("so_far"))


@query("""
    SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
""")
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-86_400_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("requests"), F.round(F.sum("value").over(w), 4).alias("tokens"))


@query("""
    WITH changes AS (SELECT o_orderkey, CAST('X' AS VARCHAR) AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey + 10000000, 'N', 5e0 FROM orders WHERE o_orderkey % 11 = 0)
    SELECT coalesce(o.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(o.o_totalprice, c.o_totalprice) AS o_totalprice FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders) o FULL OUTER JOIN changes c ON c.o_orderkey = o.o_orderkey
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = stored.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    added = stored.where("o_orderkey % 11 = 0").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(5.0).alias("o_totalprice"))
    return relations.upsert(stored, changed.union(added), ["o_orderkey"], update=["o_orderstatus"])


@query("""
    SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) + row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey) END AS BIGINT) AS id FROM customer
""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "customer").select("c_custkey")
    known = papers.where("c_custkey % 2 = 0").withColumn("id", F.col("c_custkey"))
    return relations.with_stable_ids(papers, known, ["c_custkey"], "id")


@query("SELECT user_id, string_agg(event_type, '; ' ORDER BY event_type) AS kinds, bool_or(value > 99) AS any_high, bool_and(value >= 0) AS all_positive FROM (SELECT DISTINCT user_id, event_type, max(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1")
def joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return rows.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_type")), "; ").alias("kinds"), F.bool_or(F.col("value") > 99).alias("any_high"), F.bool_and(F.col("value") >= 0).alias("all_positive"))


@query("SELECT user_id, round(sum(CAST(props::JSON->>'$.k' AS DOUBLE)), 4) AS total, count(props::JSON->>'$.k') AS n FROM events GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(k), 4).alias("total"), F.count(k).alias("n"))


_STEMMED = f"""
    WITH words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents)),
    {stem_tables('words')},
    hits AS (SELECT doc_id, stem, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) JOIN stems USING (w) WHERE w NOT IN ('', {', '.join(f"'{x}'" for x in search.STOP)}) GROUP BY 1, 2)
"""


@query(f"{_STEMMED} SELECT doc_id, round(sum(1 - pow(0.5, n)), 6) AS rank FROM hits WHERE stem IN ('thon', 'thre') GROUP BY 1 HAVING count(*) = 2")
def search_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(table(spark, sf_dir, "documents"), "thon thre", "doc_id", {"text": 1.0})
    return found.select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT w, stem FROM ({_STEMMED} SELECT w, stem FROM stems WHERE w <> '')")
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).where("w <> ''").distinct()
    return words.select("w", stemmed(F.col("w")).alias("stem"))


_INDEXES: dict[tuple[str, str], text_index.Index] = {}


def _document_index(spark: SparkSession, sf_dir: str) -> text_index.Index:
    """The documents' index in the shared folder, made once for a session in two runs: first as if every third document had another text or were missing, then as they are."""
    where = (spark.sparkContext.applicationId, sf_dir)
    if where not in _INDEXES:
        index = text_index.Index(f"{shared_folder(spark)}/documents-index-{uuid.uuid4().hex}", "doc_id", fields={"text": 1.0})
        rows = table(spark, sf_dir, "documents").select("doc_id", "text")
        old = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" thon and what is gone"))).otherwise(F.col("text"))
        text_index.update(rows.where("doc_id % 3 <> 2").select("doc_id", old.alias("text")), index)
        text_index.update(rows, index)
        _INDEXES[where] = index
    return _INDEXES[where]


@query(f"""
    {_STEMMED}, d AS (SELECT doc_id, max(CASE WHEN stem = 'thon' THEN n ELSE 0 END) AS a, max(CASE WHEN stem = 'thre' THEN n ELSE 0 END) AS b, max(CASE WHEN stem = 'reth' THEN n ELSE 0 END) AS c FROM hits GROUP BY 1)
    SELECT doc_id, round(2 - pow(0.5, a) - pow(0.5, c), 6) AS rank FROM d WHERE (a > 0 AND b = 0) OR c > 0
""")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_index.search(spark, _document_index(spark, sf_dir), "thon -thre OR reth")
    return found.select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"{_STEMMED} SELECT stem AS term, count(*) AS n FROM hits GROUP BY 1")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.frequencies(spark, _document_index(spark, sf_dir))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream gives out a day once it is over; what it gave is read from its sink."""
    from lacuna.streaming import increments

    events = table(spark, sf_dir, "events")
    return increments.settled_daily_counts(spark, sf_dir, "events.parquet", events.schema)
