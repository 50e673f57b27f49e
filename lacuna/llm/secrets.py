"""Secret scans: fixed patterns, and windows of high Shannon entropy within candidate strings."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import let
from lacuna.llm.spans import kept, spans

# Possessive quantifiers and look-behinds keep every pattern linear in the text; they match what the plain forms do.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
BASE = ["assign", "access", "hex"]


@dataclass(frozen=True)
class CharClass:
    """Candidates are maximal runs of alphabet; a window of them is suspect from so many bits a character on."""

    name: str
    alphabet: str
    run: str
    bits: float
    #: What a candidate must match besides.
    must: str = ""


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Entropy:
    window: int = 20
    classes: tuple[CharClass, ...] = (
        CharClass("entropy_hex", DIGITS + "abcdef", r"(?<![0-9A-Za-z])[0-9a-fA-F]{20,}+(?![0-9A-Za-z])", 3.0),
        CharClass("entropy_base64", UPPER + LOWER + DIGITS + "+/_-", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", 3.8, r"^(?=[^0-9]*+[0-9])(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])"),
        CharClass("entropy_lower", LOWER + DIGITS, r"(?<![A-Za-z0-9])[a-z0-9]{20,}+(?![A-Za-z0-9])", 3.6, r"^(?=[^0-9]*+[0-9])(?=[^g-z]*+[g-z])"),
        CharClass("entropy_upper", UPPER + DIGITS, r"(?<![A-Za-z0-9])[A-Z0-9]{20,}+(?![A-Za-z0-9])", 3.6, r"^(?=[^0-9]*+[0-9])(?=[^G-Z]*+[G-Z])"),
    )
    #: Candidates that match one of these are let be: examples, counters and fillers in manuals.
    allowed: tuple[str, ...] = ("(?i)example", "(?i)0123456789|abcdefgh", r"(.)\1{7}")
    #: So are these whole values.
    allowed_values: tuple[str, ...] = field(default=())
    #: Fillers (a pattern and its length in characters) that are cut out of candidates: windows that touch one are let be, what stands before and after it is a candidate of its own.
    cut_out: tuple[tuple[str, int], ...] = ()


#: The allow list by windows: a filler in a long key or path hides no secret beside it.
BY_WINDOW = Entropy(allowed=(), cut_out=(("(?i)example", 7), ("(?i)0123456789", 10), ("(?i)abcdefgh", 8), (r"(.)\1{7}", 8)))


def hot_stretch(value: Column, alphabet: str, window: int, bits: float) -> Column:
    """struct(first, last): the ends of the first and the last window of value with at least so many bits; null if none. value has characters of alphabet alone.

    One pass: a window's counts come from those of the window before it by the character that enters and the one
    that leaves, and with them the sum of c * log2(c), which fixes the entropy. The counts are fields of a few bits in longs, so a step changes
    one field for each of the two characters, whatever the alphabet.
    """
    width = window.bit_length()
    fields = 63 // width
    words = -(-len(alphabet) // fields)
    terms = F.array(*[F.lit(c * log2(c) if c > 1 else 0.0) for c in range(window + 1)])
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    one = F.lit(1).cast("long")

    def scan(places: Column) -> Column:
        def step(state: Column, into: Column) -> Column:
            full = state["at"] >= window
            moved = F.struct(into.alias("into"), F.when(full, places[state["at"] - window]).otherwise(into).alias("out"))

            def changed(p: Column) -> Column:
                into, out = p["into"], p["out"]
                shift = lambda place: place % fields * width
                counted = lambda place: F.call_function("shiftrightunsigned", state["counts"][F.floor(place / fields).cast("int")], shift(place)).bitwiseAND((1 << width) - 1).cast("int")
                both = F.struct(counted(into).alias("grown"), counted(out).alias("shrunk"))

                def told(n: Column) -> Column:
                    grows = terms[n["grown"] + 1] - terms[n["grown"]]
                    gain = F.when(full & (into == out), 0.0).when(full, grows + terms[n["shrunk"] - 1] - terms[n["shrunk"]]).otherwise(grows)
                    add = lambda place, k: F.when(F.floor(place / fields) == k, F.call_function("shiftleft", one, shift(place))).otherwise(F.lit(0).cast("long"))
                    counts = F.transform(state["counts"], lambda c, k: c + add(into, k) - F.when(full, add(out, k)).otherwise(F.lit(0).cast("long")))
                    return F.struct(counts.alias("counts"), (state["sum"] + gain).alias("sum"))

                return let(let(both, told), judged)

            def judged(new: Column) -> Column:
                at = state["at"] + 1
                hot = (at >= window) & (F.lit(log2(window)) - new["sum"] / window >= bits)
                first, last = F.when(state["first"].isNull() & hot, at).otherwise(state["first"]), F.when(hot, at).otherwise(state["last"])
                return F.struct(new["counts"].alias("counts"), new["sum"].alias("sum"), at.alias("at"), first.alias("first"), last.alias("last"))

            return let(moved, changed)

        return F.aggregate(places, zero, step, lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last"))))

    place = lambda char: F.position(char, F.lit(alphabet)) - 1
    return let(F.transform(F.filter(F.split(value, ""), lambda char: char != ""), place), scan)


def _suspect(value: Column, kind: CharClass, options: Entropy) -> Column:
    right = value.rlike(kind.must) if kind.must else F.lit(True)
    for pattern in options.allowed:
        right = right & ~value.rlike(pattern)
    return right & ~value.isin(*options.allowed_values) if options.allowed_values else right


def _cut(text: Column, run: str, options: Entropy) -> Column:
    """text with NUL in place of each character of a filler, so that all places stay, where there is a candidate at all."""
    cut = text
    for pattern, length in options.cut_out:
        cut = F.regexp_replace(cut, pattern, "\0" * length)
    return F.when(text.rlike(run), cut).otherwise(text) if options.cut_out else text


def entropy_spans(text: Column, kind: CharClass, rank: int, options: Entropy) -> Column:
    """Structs (start, rank, end) of the stretches from the first suspect window to the end of the last, one for each candidate."""
    alphabet = kind.alphabet

    def stretch(s: Column) -> Column:
        value = F.lower(s["value"]) if alphabet == alphabet.lower() else s["value"]
        hot = hot_stretch(value, alphabet, options.window, kind.bits)
        return let(hot, lambda h: F.when(h.isNotNull(), F.struct((s["start"] + h["first"] - options.window).alias("start"), F.lit(rank).alias("rank"), (s["start"] + h["last"]).alias("end"))))

    candidates = F.filter(spans(_cut(text, kind.run, options), kind.run), lambda s: _suspect(s["value"], kind, options))
    return F.filter(F.transform(candidates, stretch), lambda s: s.isNotNull())


def kinds(options: Entropy) -> list[str]:
    return BASE + [c.name for c in options.classes]


def scan(docs: DataFrame, text: str = "text", options: Entropy = Entropy(), base: str = "secrets", extra: str = "entropy_secrets") -> DataFrame:
    """Adds two columns of array<struct<start, rank, end>> in code points, end exclusive, in order of start, then rank in kinds().

    base: assignments whose value has 6 characters or more, access keys and hex digits; extra: suspect windows.
    A null or empty text has no spans; repeated rows each give a row.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    fixed = F.concat(kept(spans(value, ASSIGN), 0, long_enough), kept(spans(value, ACCESS), 1), kept(spans(value, HEX), 2))
    windows = [entropy_spans(value, kind, rank, options) for rank, kind in enumerate(options.classes, len(BASE))]
    return docs.withColumns({base: F.array_sort(fixed), extra: F.array_sort(F.concat(*windows))})
