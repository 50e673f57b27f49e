"""Spans of regular expressions in whole texts, with built-in functions alone.

Spark's functions give the matches of a pattern and the gaps between them, but not where they are. Match i ends
after the first i + 1 gaps and matches, so their lengths, summed up, give the places in code points.
Sums are taken by runs of RUN matches, so that a text with many matches does not cost their square.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.llm.common import let

RUN = 128

SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def running(values: Column, fold, zero: int = 0) -> Column:
    """Running values of a non-empty array of ints, by an associative fold of which zero is neutral. values is read again and again: a column or the variable of a lambda."""
    total = lambda part: F.aggregate(part, F.lit(zero), fold)
    runs = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))
    sums = F.transform(runs, lambda r: total(F.slice(values, r * RUN + 1, F.lit(RUN))))

    def places(sums: Column) -> Column:
        before = F.transform(sums, lambda _, r: total(F.slice(sums, F.lit(1), r)))

        def place(before: Column) -> Column:
            run = lambda i: F.floor(i / RUN).cast("int")
            return F.transform(values, lambda _, i: fold(before[run(i)], total(F.slice(values, run(i) * RUN + 1, i % RUN + 1))))

        return let(before, place)

    return let(sums, places)


def _ends(lengths: Column) -> Column:
    return running(lengths, lambda a, x: a + x)


#: Code points of a block that texts are cut into, so that a piece of a long text is found without a walk from its start.
BLOCK = 1024


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """What stands from start to end (exclusive, in code points) in the text that blocks() cut; empty if end is not after start."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    part = lambda block, begin, n: F.coalesce(F.substring(F.get(cut, block), begin, n), F.lit(""))
    within = part(first, start % BLOCK + 1, end - start)
    across = F.concat(part(first, start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), part(last, F.lit(1), end % BLOCK))
    return F.when(end <= start, "").when(first == last, within).otherwise(across)


def spans(text: Column, pattern: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches of pattern (of one character or more) in text, as SPAN.

    before and after: as many characters as context says at most, of the gaps to the neighbouring matches.
    Null text: an empty array.
    """

    def located(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

        def made(ends: Column) -> Column:
            return F.transform(
                found,
                lambda m, i: F.struct(
                    (ends[i] - F.length(m)).alias("start"),
                    ends[i].alias("end"),
                    m.alias("value"),
                    (F.right(gaps[i], F.lit(context)) if context else F.lit("")).alias("before"),
                    (F.substring(gaps[i + 1], 1, context) if context else F.lit("")).alias("after"),
                ),
            )

        return F.when(F.size(found) > 0, let(let(lengths, _ends), made)).otherwise(F.array().cast(SPAN))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(both, located)).otherwise(F.array().cast(SPAN))


def kept(found: Column, rank: int, keep=None) -> Column:
    """The spans that keep holds for, as structs (start, rank of the kind, end)."""
    found = F.filter(found, lambda s: keep(s["value"])) if keep else found
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def joined(found: Column, kinds: list[str]) -> Column:
    """kind:start:end of structs (start, rank, end), comma-joined in their order."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, rank: int) -> Column:
    return F.size(F.filter(found, lambda s: s["rank"] == rank)).cast("long")


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
