"""Quotes of a LaTeX source in the text items of its typeset pages.

Both sides come down to lower-case ASCII letters and digits. A quote that is not there as a whole is placed by its first and
last characters, as typeset references and symbols change what lies between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import nfkc

# Results depend on them.
ANCHOR = 40
MIN_QUOTE = 15
#: How much longer than the quote what lies between its first and last characters may be: by a factor and by characters.
STRETCH, SLACK = 1.3, 40
#: Commands whose arguments are not typeset where they stand.
UNSEEN = r"\\(?:cite[a-z]*|ref|eqref|autoref|cref|Cref|label|url|footnote)\*?\{[^{}]*\}"


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(text)), "[^a-z0-9]", "")


def quote_letters(latex: Column) -> Column:
    plain = F.regexp_replace(latex, UNSEEN, "")
    return letters(F.regexp_replace(plain, r"\\[A-Za-z]+\*?", ""))


def place(quote: Column, page: Column) -> Column:
    """struct(start, end) of quote in page, from 0, end exclusive; null if it is not there. Both are letters alone."""
    n = F.length(quote)
    at = lambda part, since: F.position(part, page, since)
    span = lambda start, end: F.struct(start.cast("int").alias("start"), F.least(end, F.length(page)).cast("int").alias("end"))
    first, last = F.substring(quote, 1, ANCHOR), F.right(quote, F.lit(ANCHOR))
    whole, head, tail = at(quote, F.lit(1)), at(first, F.lit(1)), at(last, F.lit(1))
    after = at(last, head + ANCHOR)
    return (
        F.when((n < MIN_QUOTE) | n.isNull(), F.lit(None))
        .when(whole > 0, span(whole - 1, whole - 1 + n))
        .when(n <= ANCHOR, F.lit(None))
        .when((head > 0) & (after > 0) & (after + ANCHOR - head <= n * STRETCH + SLACK), span(head - 1, after - 1 + ANCHOR))
        .when(head > 0, span(head - 1, head - 1 + n))
        .when(tail > 0, span(F.greatest(F.lit(0), tail - 1 + ANCHOR - n), tail - 1 + ANCHOR))
    )


def items_in_place(items: DataFrame) -> DataFrame:
    """items (document, page, item, text) with letters, start and end among its page's letters."""
    order = Window.partitionBy("document", "page").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.select("document", "page", "item", letters(F.col("text")).alias("letters"))
    end = F.sum(F.length("letters")).over(order)
    return rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("letters"))


def located(items: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items, quotes (document, quote, latex) -> (the first page and place of each quote that is found, the quote of each item that one covers).

    An item that several quotes share goes to the one that covers most of its characters, of equal ones the least.
    """
    placed = items_in_place(items)
    pages = placed.groupBy("document", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "letters"))), lambda x: x["letters"]), "").alias("text"))
    pairs = quotes.select("document", "quote", quote_letters(F.col("latex")).alias("wanted")).join(pages, "document")
    found = pairs.withColumn("at", place(F.col("wanted"), F.col("text"))).where("at IS NOT NULL")
    first = found.groupBy("document", "quote").agg(F.min_by(F.struct("page", "at"), "page").alias("f")).select("document", "quote", "f.page", F.col("f.at.start").alias("from"), F.col("f.at.end").alias("to"))
    covered = placed.join(first, ["document", "page"]).withColumn("chars", F.least("end", "to") - F.greatest("start", "from")).where("chars > 0")
    most = covered.groupBy("document", "page", "item").agg(F.max("chars").alias("chars"))
    owners = covered.join(most, ["document", "page", "item", "chars"]).groupBy("document", "page", "item").agg(F.min("quote").alias("quote"))
    return first, owners
