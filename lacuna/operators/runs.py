"""What a batch stage does around its work: which rows go on, which are done already, what it writes and says of itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lacuna.functions import scalars
from lacuna.sources import staged_json


def guarded(rows: DataFrame, stage: str, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(rows of status ok, which go on; the others with status skipped and a detail that names the stage before and its status). A null status is none of ok."""
    good = F.coalesce(F.col(status) == "ok", F.lit(False))
    detail = F.concat(F.lit(f"{stage} status "), F.coalesce(F.col(status), F.lit("unknown")))
    others = rows.where(~good).withColumn("detail", detail).withColumn(status, F.lit("skipped"))
    return rows.where(good), others


def pending(rows: DataFrame, done: DataFrame, key: str, version: str, force: bool = False, version_column: str = "version", status: str = "status") -> DataFrame:
    """rows that are still to be done: all if forced, else those without a result of status ok in this version."""
    if force:
        return rows
    settled = done.where((F.col(status) == "ok") & (F.col(version_column) == version)).select(key)
    return rows.join(settled, key, "left_anti")


def disjoint(slices: DataFrame, key: str, of: str, belongs: Column | None = None) -> DataFrame:
    """slices, or an error when it is read: a key in two slices (column of), twice in one, or in one that belongs does not hold for."""
    again = slices.groupBy(key).agg(F.count("*").alias("__n"), F.count_distinct(of).alias("__of"))
    said = lambda what: F.raise_error(F.concat(F.lit(what), F.col(key).cast("string"))).cast("boolean")
    where = F.when(F.col("__of") > 1, said("in more than one slice: ")).when(F.col("__n") > 1, said("twice in a slice: ")).otherwise(F.lit(True))
    checked = slices.join(again, key).where(where)
    if belongs is not None:
        checked = checked.where(F.when(belongs, True).otherwise(said("in the wrong slice: ")))
    return checked.select(*slices.columns)


def summary(rows: DataFrame, ratio: str = "reduction_ratio", status: str = "status", version: str = "1") -> DataFrame:
    """One row: version, papers, statuses (map of counts), and the median and least ratio to two places; null where no row has one."""
    counts = rows.groupBy(status).agg(F.count("*").alias("n"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("papers"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("statuses"))
    spread = rows.agg(F.percentile(ratio, 0.5).alias("median"), F.min(ratio).alias("least"))
    one = whole.withColumn("__one", F.lit(1)).join(spread.withColumn("__one", F.lit(1)), "__one")
    return one.select(F.lit(version).alias("version"), "papers", "statuses", scalars.rounded(F.col("median"), 2).alias("reduction_ratio_median"), scalars.rounded(F.col("least"), 2).alias("reduction_ratio_min"))


def write_stage(rows: DataFrame, said: DataFrame, folder: str, key: str = "inspire_id", part: Column | None = None) -> None:
    """A stage's output, in the place of the one before: its rows as JSON lines by slice (part, one if None) and key, and its summary of one row. Readers see both or neither
    (staged_json.read); rows may come from the folder itself."""
    staged_json.write(rows, folder, key, F.lit("all") if part is None else part, said.first().asDict(recursive=True))


def observed(rows: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """rows, and metrics that are taken while rows are computed for something else: no pass of their own."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def stage_metrics(ratio: str = "reduction_ratio", before: str = "body_tokens", after: str = "candidate_tokens", status: str = "status") -> dict[str, Column]:
    """Papers, papers that are ok, tokens before and after, and how far they come down."""
    return {"papers": F.count(F.lit(1)), "ok": F.count_if(F.col(status) == "ok"), "tokens_before": F.sum(before), "tokens_after": F.sum(after), "ratio_mean": F.avg(ratio), "ratio_least": F.min(ratio), "ratio_most": F.max(ratio)}


def sliding_load(requests: DataFrame, by: str, at: str, seconds: int, estimated: str, actual: str) -> DataFrame:
    """requests with load_requests and load_tokens: how many requests, and of how many tokens, each and those of the seconds before it make. A request counts with its
    estimate until its actual tokens are known."""
    last = Window.partitionBy(by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumns({"load_requests": F.count("*").over(last), "load_tokens": F.sum(F.coalesce(actual, estimated)).over(last)})
