"""A stored inverted index: postings by bucket of the term, in segments of which each run adds one for what changed.

A segment holds postings, one row for each product it knows (with its terms), how often terms came and went, and the keys whose older postings do not count any
more. A manifest lists the segments that count; it is written last, so readers see a whole run or none of it. A query reads the
buckets of its terms, and no others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import search as text_search
from lacuna.staging import staged


@dataclass(frozen=True)
class Index:
    folder: str
    key: str = "id"
    key_type: str = "long"
    fields: dict[str, float] = field(default_factory=lambda: dict(text_search.WEIGHTS))
    #: Buckets of terms, for good: an index keeps those that it began with.
    buckets: int = 64

    @property
    def schemas(self) -> dict[str, str]:
        key = f"{self.key} {self.key_type}"
        return {
            "postings": f"term string, {key}, field string, weight double, positions array<int>, segment long, bucket int",
            "products": f"{key}, print string, terms array<string>, there boolean, segment long",
            "frequencies": "term string, change long, segment long, bucket int",
            "dead": f"{key}, segment long",
            "manifest": "number long, segments array<long>",
        }

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def _read(spark: SparkSession, index: Index, name: str) -> DataFrame:
    schema = index.schemas[name]
    try:
        return spark.read.schema(schema).parquet(f"{index.folder}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def segments(spark: SparkSession, index: Index) -> list[int]:
    """The segments that count, oldest first."""
    last = _read(spark, index, "manifest").orderBy(F.desc("number")).first()
    return sorted(last["segments"]) if last else []


def _of(rows: DataFrame, counted: list[int]) -> DataFrame:
    return rows.where(F.col("segment").isin(*counted) if counted else F.lit(False))


def _known(spark: SparkSession, index: Index, counted: list[int]) -> DataFrame:
    """key, print and segment of the latest row of each product that is there; terms are read by _terms() where they are wanted."""
    rows = _of(_read(spark, index, "products"), counted)
    last = rows.groupBy(index.key).agg(F.max(F.struct("segment", "print", "there")).alias("last")).select(index.key, "last.*")
    return last.where("there").drop("there")


def _terms(spark: SparkSession, index: Index, counted: list[int], known: DataFrame) -> DataFrame:
    """known with the terms of each product."""
    rows = _of(_read(spark, index, "products"), counted).select(index.key, "segment", "terms")
    return rows.join(known, [index.key, "segment"])


def _write(rows: DataFrame, index: Index, name: str, segment: int) -> None:
    """A folder of the segment's own, so that a run that broke off is written over. By bucket, large buckets in several files."""
    place = f"{index.folder}/{name}/segment={segment}"
    if "bucket" in rows.columns:
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
    else:
        rows.write.mode("overwrite").parquet(place)


def update(products: DataFrame, index: Index, whole: bool = True) -> dict[str, int]:
    """Bring the index to products (the key and the fields): those that are new or changed are indexed, others are not written again. whole: products are all that
    there are, and what the index knows beside them goes. A null key plays no part; of a key that comes twice the greatest text counts. One run at a time. Gives counts.
    """
    spark, key = products.sparkSession, index.key
    counted = segments(spark, index)
    segment = (max(counted) + 1) if counted else 1
    texts = F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in index.fields])
    given = products.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(texts).alias("texts"))
    given = given.withColumn("print", F.sha2(F.to_json("texts"), 256))
    known = staged(_known(spark, index, counted), "index-known")
    changed = given.join(known.select(key, F.col("print").alias("old")), key, "left").where("old IS NULL OR old <> print").select(key, "print", "texts.*", F.col("old").isNotNull().alias("again"))
    changed = staged(changed, "index-changed")
    gone = known.join(given.select(key), key, "left_anti") if whole else known.limit(0)
    gone = staged(gone.select(key), "index-gone")

    # A row for each text, so that a product's terms need no second pass over single postings.
    made = staged(text_search.documents(changed, key, index.fields), "index-postings")
    listed = made.select(key, F.array_sort("postings.term").alias("terms"))
    # Keys do not repeat here, so with one field there is nothing to put together.
    own = listed if len(index.fields) == 1 else listed.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    terms = changed.select(key, "print").join(own, key, "left")
    single = made.select(key, "field", "weight", F.explode("postings").alias("p")).select("p.term", key, "field", "weight", "p.positions")
    there = terms.select(key, "print", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.lit(True).alias("there"))
    away = gone.select(key, F.lit("").alias("print"), F.array().cast("array<string>").alias("terms"), F.lit(False).alias("there"))
    dead = changed.where("again").select(key).unionByName(gone)
    lost = _terms(spark, index, counted, known.join(dead, key, "left_semi")).select(F.explode("terms").alias("term"), F.lit(-1).alias("n"))
    # Written first, and read back, so that terms are put together once.
    _write(there.unionByName(away), index, "products", segment)
    came = _of(_read(spark, index, "products"), [segment]).where("there").select(F.explode("terms").alias("term"), F.lit(1).alias("n"))
    change = lost.unionByName(came).groupBy("term").agg(F.sum("n").alias("change")).where("change <> 0")

    _write(single.withColumn("bucket", index.bucket(F.col("term"))), index, "postings", segment)
    _write(change.withColumn("bucket", index.bucket(F.col("term"))), index, "frequencies", segment)
    _write(dead, index, "dead", segment)
    _point(spark, index, [*counted, segment])
    return {"changed": changed.count(), "gone": gone.count(), "segment": segment}


def _point(spark: SparkSession, index: Index, counted: list[int]) -> None:
    last = _read(spark, index, "manifest").agg(F.max("number")).first()[0] or 0
    spark.createDataFrame([(last + 1, counted)], index.schemas["manifest"]).coalesce(1).write.mode("append").parquet(f"{index.folder}/manifest")


def compact(spark: SparkSession, index: Index) -> int:
    """All that counts as one segment; the older ones stay for those who read them now. Gives the segment's number."""
    counted = segments(spark, index)
    if len(counted) < 2:
        return counted[0] if counted else 0
    segment = max(counted) + 1
    products = _terms(spark, index, counted, _known(spark, index, counted)).select(index.key, "print", "terms", F.lit(True).alias("there"))
    _write(_live(spark, index, counted, None).drop("segment"), index, "postings", segment)
    _write(products, index, "products", segment)
    _write(_of(_read(spark, index, "frequencies"), counted).groupBy("bucket", "term").agg(F.sum("change").alias("change")).where("change <> 0"), index, "frequencies", segment)
    _write(products.limit(0).select(index.key), index, "dead", segment)
    _point(spark, index, [segment])
    return segment


def _buckets(spark: SparkSession, index: Index, terms: list[str]) -> list[int]:
    """Of the terms of a query, as literals, so that other buckets are not even listed."""
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select(index.bucket(F.col("term")))
    return sorted({r[0] for r in rows.collect()})


def _chosen(rows: DataFrame, index: Index, terms: list[str] | None) -> DataFrame:
    if terms is None:
        return rows
    return rows.where(F.col("bucket").isin(*_buckets(rows.sparkSession, index, terms)) & F.col("term").isin(*terms)) if terms else rows.where("false")


def _live(spark: SparkSession, index: Index, counted: list[int], terms: list[str] | None) -> DataFrame:
    rows = _chosen(_of(_read(spark, index, "postings"), counted), index, terms)
    later = _of(_read(spark, index, "dead"), counted).select(F.col(index.key).alias("__key"), F.col("segment").alias("__later"))
    return rows.join(later, (F.col(index.key) == F.col("__key")) & (F.col("segment") < F.col("__later")), "left_anti")


def postings(spark: SparkSession, index: Index, terms: list[str] | None = None) -> DataFrame:
    """term, key, field, weight, positions of what the index holds now; terms: of these alone, from their buckets."""
    return _live(spark, index, segments(spark, index), terms).select("term", index.key, "field", "weight", "positions")


def frequencies(spark: SparkSession, index: Index, terms: list[str] | None = None) -> DataFrame:
    """term, n: how many products hold it in any field."""
    rows = _chosen(_of(_read(spark, index, "frequencies"), segments(spark, index)), index, terms)
    return rows.groupBy("term").agg(F.sum("change").alias("n")).where("n > 0")


def search(spark: SparkSession, index: Index, text: str) -> DataFrame:
    """As search.search(), from the index."""
    return text_search.ranked(postings(spark, index, text_search.terms_of(text)), text, index.key)
