"""The triage queue and paper lists: lineitem stands for gaps, orders for products, customer for papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.plans.registry import query, table


@query("""
    SELECT l_orderkey, l_linenumber, l_returnflag AS status, o_totalprice AS confidence, c_name AS paper
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_returnflag IN ('A', 'R') AND l_linenumber >= 3
      AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
    ORDER BY l_linenumber DESC, o_totalprice DESC, l_orderkey, l_extendedprice LIMIT 25
""")
def triage_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_linenumber") >= 3))
    products = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01'")
    papers = table(spark, sf_dir, "customer")
    return (
        gaps.join(products, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(papers, F.col("o_custkey") == F.col("c_custkey"))
        .orderBy(F.desc("l_linenumber"), F.desc("o_totalprice"), "l_orderkey", "l_extendedprice")
        .limit(25)
        .select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("status"), F.col("o_totalprice").alias("confidence"), F.col("c_name").alias("paper"))
    )
