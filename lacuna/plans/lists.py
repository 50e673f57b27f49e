"""Lists, pages, statistics and profiles: the read side. customer stands for papers, orders for products, lineitem for gaps, events for reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import scalars
from lacuna.operators import relations
from lacuna.plans.registry import query, table


@query("""
    SELECT l_orderkey, l_linenumber, l_returnflag AS status, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R' AND l_linenumber = 5 AND o_orderstatus IN ('O', 'P') ORDER BY l_quantity DESC, l_orderkey, l_extendedprice LIMIT 40
""")
def triage_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 5")
    products = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return gaps.join(products, F.col("l_orderkey") == F.col("o_orderkey")).orderBy(F.desc("l_quantity"), "l_orderkey", "l_extendedprice").limit(40).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("status"), "l_quantity")


@query("""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS paper_year, count(*) AS gaps FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND l_returnflag <> 'N' GROUP BY 1
""")
def triage_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1999-01-01'")
    gaps = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    return papers.join(gaps, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.year("o_orderdate").alias("paper_year")).agg(F.count("*").alias("gaps"))


@query("""
    SELECT c_custkey, c_name, latest FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey
    ORDER BY latest DESC NULLS FIRST, c_custkey LIMIT 60
""")
def paper_list_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))
    papers = table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return papers.orderBy(F.desc_nulls_first("latest"), "c_custkey").limit(60).select("c_custkey", "c_name", "latest")


@query("""
    SELECT c_custkey, latest FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS latest FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 GROUP BY 1) ON c_custkey = o_custkey
    WHERE latest IS NOT NULL ORDER BY latest ASC NULLS LAST, c_custkey LIMIT 60
""")
def paper_list_has_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").groupBy("o_custkey").agg(F.max("o_totalprice").alias("latest"))
    papers = table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").where(F.col("latest").isNotNull())
    return papers.orderBy(F.asc_nulls_last("latest"), "c_custkey").limit(60).select("c_custkey", "latest")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], number=3)


@query("""
    SELECT (SELECT count(*) FROM customer) AS papers, count(*) AS products, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS uncertain,
        round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS mean_readiness FROM orders
""")
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "customer").agg(F.count("*").alias("papers"))
    status = F.col("o_orderstatus")
    totals = table(spark, sf_dir, "orders").agg(
        F.count("*").alias("products"), F.count_if(status == "O").alias("open"), F.count_if(status == "P").alias("uncertain"), F.round(F.avg(F.when(status == "F", F.col("o_totalprice"))), 4).alias("mean_readiness")
    )
    return papers.join(F.broadcast(totals))  # a row each


@query("SELECT l_returnflag AS status, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def stats_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("status")).agg(F.count("*").alias("n")).orderBy("status")


@query("SELECT p_type AS product_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("product_type")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("""
    SELECT c_custkey AS paper, round(100 * sum(w * credit) / sum(w), 1) AS readiness_score FROM customer LEFT JOIN
    (SELECT o_custkey, CAST(l_linenumber AS DOUBLE) AS w, CASE l_returnflag WHEN 'A' THEN 1e0 WHEN 'N' THEN 5e-1 ELSE 0e0 END AS credit FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F') ON c_custkey = o_custkey
    GROUP BY 1
""")
def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "published").when(F.col("l_returnflag") == "N", "uncertain").otherwise("missing")
    gaps = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    scores = gaps.groupBy("o_custkey").agg(F.round(scalars.readiness(F.col("l_linenumber"), status), 1).alias("readiness_score"))
    return table(spark, sf_dir, "customer").join(scores, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("paper"), "readiness_score")


@query("""
    SELECT c_custkey, event_id, event_type, ts FROM customer LEFT JOIN (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, max(ts) AS ts FROM events GROUP BY 1) ON c_custkey = user_id
""")
def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = relations.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])
    return table(spark, sf_dir, "customer").join(reviews, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "event_id", "event_type", "ts")


@query("SELECT event_id, event_type, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC")
def reviews_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "event_type", "ts")


@query("""
    SELECT o_orderkey, c_name AS paper, 'https://example.org/record/' || CAST(o_orderkey AS VARCHAR) AS url, CAST(year(o_orderdate) AS INTEGER) AS paper_year,
        CASE WHEN n.n_name = 'FRANCE' THEN NULL ELSE 'https://example.org/nation/' || n.n_name END AS nation_url
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey WHERE o_totalprice > 400000
""")
def paper_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 400000").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("n_name") != "FRANCE", F.col("n_name"))
    return rows.select(
        "o_orderkey", F.col("c_name").alias("paper"), F.concat(F.lit("https://example.org/record/"), F.col("o_orderkey").cast("string")).alias("url"), F.year("o_orderdate").alias("paper_year"),
        F.when(name.isNotNull(), F.concat(F.lit("https://example.org/nation/"), name)).alias("nation_url"),
    )


@query("""
    SELECT o_orderkey, CASE WHEN m.l_quantity IS NULL THEN NULL ELSE m.l_quantity / 50 END AS score, CASE WHEN m.l_quantity IS NULL THEN NULL ELSE m.l_partkey END AS matched_part
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS l_quantity, max(l_partkey) AS l_partkey FROM lineitem WHERE l_quantity > 45 GROUP BY 1) m ON l_orderkey = o_orderkey
""")
def match_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg((F.max("l_quantity") / 50).alias("score"), F.max("l_partkey").alias("part"))
    rows = table(spark, sf_dir, "orders").join(matches, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    nested = rows.select("o_orderkey", F.when(F.col("score").isNotNull(), F.struct("score", F.col("part").alias("matched_part"))).alias("match"))
    return nested.select("o_orderkey", "match.score", "match.matched_part")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name LIKE (SELECT substr(p_name, 1, 3) FROM part ORDER BY p_partkey LIMIT 1) || '%'")
def prefix_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = part.orderBy("p_partkey").limit(1).select(F.substring("p_name", 1, 3).alias("prefix"))
    return part.join(F.broadcast(first), F.startswith("p_name", "prefix")).select("p_partkey", "p_name", "p_brand")


@query("""
    SELECT s_suppkey, r_partkey, CASE WHEN s_suppkey IS NULL THEN 'right' WHEN r_partkey IS NULL THEN 'left' ELSE 'matched' END AS side FROM supplier FULL OUTER JOIN
    (SELECT DISTINCT l_suppkey AS right_s, l_partkey AS r_partkey, CASE WHEN l_returnflag IN ('A', 'N') THEN l_suppkey END AS link FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.08 AND l_suppkey % 3 = 0) ON s_suppkey = link
""")
def paper_compare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "lineitem").where("l_quantity >= 49 AND l_discount >= 0.08 AND l_suppkey % 3 = 0")
    gaps = gaps.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("r_partkey"), F.col("l_returnflag").isin("A", "N").alias("linked")).distinct()
    compared = relations.compare(table(spark, sf_dir, "supplier").select("s_suppkey"), gaps, "s_suppkey", F.col("linked"))
    return compared.select("s_suppkey", "r_partkey", "side")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'on' WHEN 'P' THEN 'review' ELSE 'missing' END AS kind FROM orders")
def reader_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "P", "uncertain").otherwise("no_record")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.reader_kind(status).alias("kind"))


@query("""
    SELECT conv_id, turn, substr(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), 1, 400) AS evidence FROM conversations
""")
def evidence_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.excerpt(F.col("text")).alias("evidence"))


@query("""
    SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 't' ELSE 'r' END AS kind, CAST(row_number() OVER (ORDER BY n_nationkey % 2, n_nationkey) AS INTEGER) AS place FROM nation
""")
def part_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    kind = F.when(F.col("n_nationkey") % 2 == 0, "t").otherwise("r")
    parts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), kind.alias("kind"), F.concat(F.lit("10.1/x/"), kind, F.col("n_nationkey").cast("string")).alias("doi"))
    return parts.withColumn("place", F.row_number().over(Window.orderBy(*scalars.part_order(F.col("doi"))))).drop("doi")  # one record's parts


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY 1, 2")
def gap_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("total"))
