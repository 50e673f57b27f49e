"""Parts of a text with their places, so that what is taken from it can be told by where it stands and not by what it says."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = "array<struct<start:int,text:string>>"

#: The commands whose arguments are looked for.
COMMANDS = r"\\(part|section|subsection|subsubsection)\*?\s*(?=[\[{])|\\(caption)(?:of\{[^}]*\})?\s*(?=[\[{])"
_FOUND = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("start", "open", "end")]])
ARGUMENTS = T.StructType([T.StructField("error", T.StringType()), T.StructField("found", T.ArrayType(_FOUND))])


def gaps(text: Column, pattern: str) -> Column:
    """What lies between the matches of pattern, with where it starts, as GAP."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(GAP).alias("out"))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit(""))).alias("mark"))

    def step(state: Column, pair: Column) -> Column:
        own = F.struct(state["at"].alias("start"), pair["gap"].alias("text"))
        return F.struct((state["at"] + F.length(pair["gap"]) + F.length(pair["mark"])).alias("at"), F.array_append(state["out"], own).alias("out"))

    return F.aggregate(pairs, zero, step, lambda state: state["out"])


def trimmed(parts: Column) -> Column:
    """GAP without the white space at both ends of each text; empty ones go."""
    bare = F.transform(parts, lambda p: F.struct((p["start"] + F.length(p["text"]) - F.length(F.regexp_replace(p["text"], r"(?U)^\s+", ""))).alias("start"), F.regexp_replace(p["text"], r"(?U)^\s+|\s+$", "").alias("text")))
    return F.filter(bare, lambda p: p["text"] != "")


class Unbalanced(ValueError):
    pass


class Braces:
    """Where the groups of a text end. Escaped characters do not count; a group ends where the depth falls below its own."""

    def __init__(self, text: str):
        self.places, self.depths = {}, {}
        marks = [(m.start(), m.group()) for m in re.finditer(r"\\.|[{}\[\]]", text, re.DOTALL) if m.group()[0] != "\\"]
        for opening, closing in ("{}", "[]"):
            own = [(at, 1 if mark == opening else -1) for at, mark in marks if mark in (opening, closing)]
            self.places[opening] = np.array([at for at, _ in own], np.int64)
            self.depths[opening] = np.cumsum([step for _, step in own], dtype=np.int64)

    def end(self, opening: str, at: int) -> int:
        k = int(np.searchsorted(self.places[opening], at))
        depths = self.depths[opening][k:]
        closed = np.flatnonzero(depths < depths[0]) if len(depths) and self.places[opening][k] == at else []
        if not len(closed):
            raise Unbalanced(f"unbalanced {opening} at offset {at}")
        return int(self.places[opening][k + closed[0]]) + 1


def _arguments(text: str) -> tuple[str | None, list[tuple]]:
    braces, found = None, []
    spaces = re.compile(r"\s*")
    try:
        for m in re.finditer(COMMANDS, text):
            # Most texts have no command, and need no groups.
            braces, at = braces or Braces(text), m.end()
            if text[at] == "[":
                at = spaces.match(text, braces.end("[", at)).end()
                if text[at : at + 1] != "{":
                    raise Unbalanced(f"no argument at offset {at}")
            found.append((m[1] or m[2], m.start(), at + 1, braces.end("{", at)))
    except Unbalanced as error:
        return str(error), []
    return None, found


@F.pandas_udf(ARGUMENTS)
def arguments(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Headers and captions of a LaTeX text, with where each command, its argument and its end are; groups may be nested to any depth, which no
    regular expression of Spark's can follow. An unbalanced group, or none, is the text's error."""
    for series in texts:
        made = [(None, []) if t is None else _arguments(t) for t in series]
        found = [[dict(zip(("name", "start", "open", "end"), f, strict=True)) for f in own] for _, own in made]
        yield pd.DataFrame({"error": [e for e, _ in made], "found": found})
