"""Precision and recall of extracted products against a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.scalars import percent_text, rounded, squash
from lacuna.operators import anchors
from lacuna.operators.matching import assign_one_to_one
from lacuna.staging import staged

MIN_OVERLAP = 40
GAPS = ["missing", "no_record"]


def overlaps(predicted: DataFrame, gold: DataFrame, paper: str = "inspire_id") -> DataFrame:
    """paper, prediction, gold_id, overlap for pairs of one paper whose quotes share enough: MIN_OVERLAP characters, or the whole shorter quote.

    predicted: paper, prediction, evidence_span. gold: paper, gold_id, quotes (array). White space does not count. Pairs that can share so much meet
    by hashes: of winnowed windows where both are long, of their beginning where a short quote stands in the other. The longest common substring is measured for these alone.
    """
    spans = staged(predicted.select(paper, "prediction", squash(F.col("evidence_span")).alias("span")).where("span IS NOT NULL AND span <> ''").withColumn("__p", F.monotonically_increasing_id()), "spans")
    quotes = gold.select(paper, "gold_id", F.explode("quotes").alias("quote")).withColumn("quote", squash(F.col("quote"))).where("quote <> ''")
    quotes = staged(quotes.withColumn("__g", F.monotonically_increasing_id()), "gold-quotes")
    long = lambda rows, c: rows.where(F.length(c) >= MIN_OVERLAP)
    shared = anchors.sharing(long(spans, "span"), long(quotes, "quote"), "span", "quote", MIN_OVERLAP, [paper], ("__p", "__g"))
    short = quotes.where(F.length("quote") < MIN_OVERLAP).select(paper, "__g", "quote")
    within = anchors.containing(spans.select(paper, "__p", "span"), short, "span", "quote", [paper]).select("__p", "__g")
    # A longer span that stands in a quote shares so much with it, and has met it above.
    brief = spans.where(F.length("span") < MIN_OVERLAP).select(paper, "__p", "span")
    around = anchors.containing(quotes.select(paper, "__g", "quote"), brief, "quote", "span", [paper]).select("__p", "__g")
    pairs = staged(shared.unionByName(within).unionByName(around).distinct(), "overlap-pairs")
    near = pairs.join(spans, "__p").join(quotes.drop(paper), "__g").withColumn("overlap", anchors.longest_common("span", "quote"))
    enough = (F.col("overlap") >= F.least(F.lit(MIN_OVERLAP), F.length("quote"))) | (F.col("overlap") == F.length("span"))
    return near.where(enough).groupBy(paper, "prediction", "gold_id").agg(F.max("overlap").alias("overlap"))


def matched(predicted: DataFrame, gold: DataFrame, paper: str = "inspire_id") -> DataFrame:
    """One gold item for each prediction at most, the largest overlaps first."""
    return assign_one_to_one(overlaps(predicted, gold, paper), paper, "prediction", "gold_id", "overlap")


def outcomes(predicted: DataFrame, gold: DataFrame, pairs: DataFrame, paper: str = "inspire_id") -> DataFrame:
    """A row for each match, unmatched prediction and unmatched item: outcome tp, fp or fn, and the type it counts for (the gold one, for fp the predicted one)."""
    p = predicted.select(paper, "prediction", F.col("product_type").alias("predicted_type"), "status")
    g = gold.select(paper, "gold_id", F.col("product_type").alias("gold_type"), "accept_types", "on_hepdata")
    joined = p.join(pairs.select(paper, "prediction", "gold_id"), [paper, "prediction"], "left").join(g, [paper, "gold_id"], "full_outer")
    outcome = F.when(F.col("prediction").isNull(), "fn").when(F.col("gold_type").isNull(), "fp").otherwise("tp")
    right = F.array_contains(F.array_append(F.coalesce("accept_types", F.array().cast("array<string>")), F.col("gold_type")), F.col("predicted_type"))
    return joined.withColumn("outcome", outcome).withColumns({"type": F.when(F.col("outcome") == "fp", F.col("predicted_type")).otherwise(F.col("gold_type")), "type_right": (F.col("outcome") == "tp") & right})


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.try_divide(2 * precision * recall, precision + recall)


def confusion(rows: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, and how many are left out since one of the two is not known."""
    known = predicted.isNotNull() & actual.isNotNull()
    counts = {"tp": predicted & actual, "fp": predicted & ~actual, "fn": ~predicted & actual, "tn": ~predicted & ~actual}
    return rows.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.count_if(~known).alias("uncertain"))


def with_scores(counts: DataFrame) -> DataFrame:
    """tp, fp, fn -> precision, recall, f1; null where a denominator is 0."""
    scored = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def by_type(outcome_rows: DataFrame) -> DataFrame:
    return outcome_rows.groupBy("type").pivot("outcome", ["tp", "fp", "fn"]).agg(F.count(F.lit(1))).na.fill(0)


def gap_confusion(outcome_rows: DataFrame) -> DataFrame:
    """Of matched pairs: is the predicted status a gap, and is the item really not on the repository. Uncertain ones are left out."""
    rows = outcome_rows.where("outcome = 'tp'")
    said = F.when(F.col("status") != "uncertain", F.col("status").isin(*GAPS))
    return confusion(rows, said, ~F.col("on_hepdata"))


def type_accuracy(outcome_rows: DataFrame) -> DataFrame:
    """One row: the share of matched predictions whose type is right; null without matches."""
    return outcome_rows.agg(ratio(F.count_if("type_right"), F.count_if(F.col("outcome") == "tp")).alias("type_accuracy"))


def cost(requests: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Prices for a million tokens."""
    total = F.sum("input_tokens") * input_price + F.sum("output_tokens") * output_price
    return requests.agg((F.coalesce(total, F.lit(0.0)) / 1e6).alias("cost")).select(rounded(F.col("cost"), 4).alias("cost"))


def gate(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """metrics (name, value) -> the thresholds that are missed, by value or for want of one."""
    limits = metrics.sparkSession.createDataFrame([(k.removeprefix("min_"), float(v)) for k, v in thresholds.items()], "name string, least double")
    return limits.join(metrics, "name", "left").where(F.col("value").isNull() | (F.col("value") < F.col("least")))


def _table(rows: DataFrame, heads: list[str]) -> list[str]:
    lines = [[("n/a" if v is None else str(v)) for v in r] for r in rows.collect()]
    return [f"| {' | '.join(cells)} |" for cells in [heads, ["---"] * len(heads), *lines]]


def report(metrics: DataFrame, types: DataFrame | None = None, gaps: DataFrame | None = None, costs: DataFrame | None = None, thresholds: dict[str, float] | None = None) -> str:
    """Markdown of a few rows: metrics (name, value) with what is asked of them, by_type() with scores, gap_confusion() with scores, and cost()."""
    asked = metrics.sparkSession.createDataFrame([(k.removeprefix("min_"), float(v)) for k, v in (thresholds or {}).items()], "name string, least double")
    first = metrics.join(asked, "name", "left").orderBy("name")
    parts = [_table(first.select("name", percent_text(F.col("value")), F.when(F.col("least").isNotNull(), percent_text(F.col("least"))).otherwise("")), ["Metric", "Value", "At least"])]
    scores = [percent_text(F.col(c)) for c in ("precision", "recall", "f1")]
    if types is not None:
        parts.append(_table(with_scores(types).orderBy("type").select("type", *scores, "tp", "fp", "fn"), ["Type", "Precision", "Recall", "F1", "TP", "FP", "FN"]))
    if gaps is not None:
        parts.append(_table(with_scores(gaps).select(*scores, "tp", "fp", "fn", "tn", "uncertain"), ["Gap precision", "Recall", "F1", "TP", "FP", "FN", "TN", "Uncertain"]))
    if costs is not None:
        parts.append(_table(costs.select(F.format_string("%.4f", "cost")), ["Cost"]))
    return "\n\n".join("\n".join(p) for p in parts)
