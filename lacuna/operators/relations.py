"""Relational operators that several stages and queries share. Every one takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.staging import staged


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each group that is greatest by order; a sort-free aggregation, combined in the map tasks."""
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*by, "best.*")


def first_of_best(rows: DataFrame, by: list[str], score: str, ordinal: str) -> DataFrame:
    """The row of the highest score in each group, of equal scores the first, at the group's first place (column first_seen)."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(score, -F.col(ordinal))).alias("best"), F.min(ordinal).alias("first_seen")).select(*by, "best.*", "first_seen")


def last_wins(rows: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """The last row of each group, and how many there were (column seen)."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), ordinal).alias("last"), F.count("*").alias("seen")).select(*by, "last.*", "seen")


def split_stale(stored: DataFrame, current: DataFrame, reviews: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows that are not current any more: (reviewed ones, to be superseded; the others, to be deleted)."""
    stale = stored.join(current.select(key), key, "left_anti")
    return stale.join(reviews.select(key), key, "left_semi"), stale.join(reviews.select(key), key, "left_anti")


def upsert(stored: DataFrame, changes: DataFrame, key: list[str], update: list[str] | None = None, when: Column | None = None) -> DataFrame:
    """stored with the rows of changes put in by key: new keys are added, of known keys the columns update are replaced (all if None).

    when: a condition on the change's columns; where it does not hold, the stored values of update stay.
    """
    update = [c for c in stored.columns if c not in key] if update is None else update
    new = changes.select(*key, *[F.col(c).alias(f"__new_{c}") for c in changes.columns if c not in key], F.lit(True).alias("__there"), (F.lit(True) if when is None else when).alias("__take"))
    both = stored.withColumn("__known", F.lit(True)).join(new, key, "full_outer")
    take = F.coalesce("__there", F.lit(False)) & (F.col("__known").isNull() | F.coalesce("__take", F.lit(False)))
    columns = []
    for c in stored.columns:
        fresh = F.col(f"__new_{c}") if f"__new_{c}" in new.columns else F.lit(None).cast(stored.schema[c].dataType)
        if c in key:
            columns.append(F.col(c))
        elif c in update:
            columns.append(F.when(take, fresh).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.when(F.col("__known").isNull(), fresh).otherwise(F.col(c)).alias(c))
    return both.select(*columns)


def with_stable_ids(rows: DataFrame, known: DataFrame, key: list[str], surrogate: str) -> DataFrame:
    """rows with the surrogate that known has for their key; new keys get the next numbers, in order of key.

    Numbers are dealt by range partition and place in it, so that no task sorts all new keys. The keys are written with their partition first, so
    that they are not cut anew, and numbered twice, when an executor is lost.
    """
    joined = rows.join(known.select(*key, surrogate), key, "left")
    top = known.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("top")).first()["top"]
    new = joined.where(F.col(surrogate).isNull()).select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key)
    new = staged(new.withColumn("__part", F.spark_partition_id()), "new-keys")
    # A row for each partition.
    sizes = new.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*key))
    numbered = new.withColumn("__place", place).join(F.broadcast(starts), "__part").select(*key, (F.lit(top) + F.col("__before") + F.col("__place")).cast("long").alias("__new"))
    return joined.join(numbered, key, "left").withColumn(surrogate, F.coalesce(surrogate, "__new")).drop("__new")


def compare(left: DataFrame, right: DataFrame, on: str, link: Column) -> DataFrame:
    """Full outer join of parts (left) with the rows of right that link holds for; the others of right stand alone. side: matched, left or right."""
    linked = right.withColumn("__link", F.when(link, F.col(on))).withColumnRenamed(on, f"right_{on}")
    joined = left.withColumn("__left", F.lit(True)).join(linked.withColumn("__right", F.lit(True)), F.col(on) == F.col("__link"), "full_outer")
    side = F.when(F.col("__left").isNull(), "right").when(F.col("__right").isNull(), "left").otherwise("matched")
    return joined.withColumn("side", side).drop("__left", "__right", "__link")


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 25, largest: int = 100) -> DataFrame:
    """One page of rows in order; sizes over the largest are cut to it."""
    size = min(size, largest)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def counted_page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 25, largest: int = 100) -> DataFrame:
    """page() with how many rows there are in all (total) and whether a page follows (has_next). A page below 1, or beyond the last but the first, is an error."""
    size = min(size, largest)
    total = rows.count()
    if number < 1 or (number > 1 and (number - 1) * size >= total):
        raise LookupError(f"no page {number}")
    return page(rows, order, number, size, largest).select("*", F.lit(total).cast("long").alias("total"), F.lit(number * size < total).alias("has_next"))


def nearest_percentile(rows: DataFrame, by: list[str], value: str, q: float, out: str, accuracy: int = 10_000) -> DataFrame:
    """For each group the value at the index that q * (n - 1) rounds to, half to even, in order of value. Exact, without a sort of whole groups.

    A sketch of each group bounds the value from both sides; what lies below is counted, and only what lies between, some 4 / accuracy
    of the group, is ranked. Bounds this close are sure only where 1 / accuracy of a group is 1.5 rows or more, as places are rounded;
    groups of 2 * accuracy rows at most are ranked whole. Nulls do not count.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, value)
    slack = 2 / accuracy
    bounds = F.percentile_approx(value, F.array(F.lit(max(0.0, q - slack)), F.lit(min(1.0, q + slack))), accuracy)
    sketched = rows.groupBy(*by).agg(F.count("*").alias("__n"), bounds.alias("__b"))
    known = rows.join(sketched.select(*by, "__n", F.col("__b")[0].alias("__low"), F.col("__b")[1].alias("__high")), by)
    small = F.col("__n") <= 2 * accuracy
    below = known.groupBy(*by).agg(F.count_if(~small & (F.col(value) < F.col("__low"))).alias("__below"))
    between = known.where(small | F.col(value).between(F.col("__low"), F.col("__high"))).withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    wanted = F.bround(F.lit(q) * (F.col("__n") - 1), 0).cast("long") + 1
    return between.join(below, by).where(F.col("__place") + F.col("__below") == wanted).select(*by, F.col(value).alias(out))
