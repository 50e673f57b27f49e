"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Documents of low quality go, one document of each group of near copies stays, documents that hold benchmark items go, personal data is
replaced by the names of its kinds, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, decontaminate, jaccard, pii, quality
from lacuna.llm.common import fresh_name, staged, table
from lacuna.llm.queries import QUALITY_KEPT, RANKS


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh_name(docs, "quality_score")
    return quality.score(docs, model, out=score).where(F.col(score) >= QUALITY_KEPT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    base, extra = fresh_name(docs, "pii"), fresh_name(docs, "context_pii")
    found = pii.find(docs, base=base, extra=extra).withColumn("text", pii.redact(F.col("text"), F.array_sort(F.concat(base, extra))))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    return ids.select("doc_id", "ids", *bpe.digests(ids))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", redacted),
    ("encoding", encoded),
]

#: No SQL can express the stages; tests/llm hold each operator, and what the stages keep, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
