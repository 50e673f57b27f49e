"""Personal data: fixed patterns, and identifiers found by the contexts that known ones stand in.

All that the fixed patterns find are seeds. A text is a row of units: base spans, groups of numbers, and words. Each unit stands in lexical
patterns: the unit before it, the two before it, the unit after it; and up to GROUP units stand in the frame of the unit before and the unit after them.
What stands in a pattern is an instance of it. The bipartite graph of patterns and instances is scored in rounds of joins and aggregations: seeds
have score 1; a pattern's confidence is the sum of the scores of the known units in it over the number of its distinct instances; an instance's
score is the noisy-or of the trusted patterns that it stands in. Units that are found are known from then on, so they make further patterns. Groups of several units are
found and count as instances, but tell nothing for other patterns. What stands in patterns that are trusted at the end are new identifiers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import let, scratch, staged
from lacuna.llm.spans import blocks, kept, piece, running, spans

# Possessive quantifiers and look-behinds keep every pattern linear in the text and free of recursion; they match what the plain forms do.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]
CONTEXT = "context"
KINDS = [*BASE, CONTEXT]

#: Within masked texts base spans are moved, character by character, to this range, which no word holds; places stay as they are.
HIDDEN = 0xE000
_ASCII = "".join(map(chr, range(32, 127)))
_HIDDEN = "".join(chr(HIDDEN + ord(c)) for c in _ASCII)
SEED = f"[{_HIDDEN[0]}-{_HIDDEN[-1]}]++"
_LETTER = r"[\p{L}\p{M}\p{N}_]"
#: Numbers that stand together, a sign apart; a word with what joins its parts.
NUMBERS = rf"[+(]?+[0-9]{_LETTER}*+(?:\)?+[\x20./-]\(?+[0-9]{_LETTER}*+)*+"
WORD = rf"[+#@]?+{_LETTER}++(?:[@+./'-]++{_LETTER}++)*+"
UNIT = f"{SEED}|{NUMBERS}(?![@+./'-]*+{_LETTER})|{WORD}"
#: Units of a group in a frame.
GROUP = 6
#: Longs of bits that bound a pattern's instances from below, and the parts of the texts, of one in so many, whose bounds are taken first.
BOUND_WORDS = 4
PARTS = (64, 8)
#: Patterns, of 8 bytes each, that are sent to all tasks at most; more are joined by a shuffle.
KEYS_BROADCAST = 500_000


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    #: What a pattern needs to find new identifiers: its score, and how many distinct known units stand in it.
    confidence: float = 0.8
    support: int = 3
    #: Instances of score 0 that each pattern is taken to have besides its own.
    doubt: float = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(reversed_digits: Column) -> Column:
        doubled = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return F.aggregate(F.transform(reversed_digits, lambda d, i: doubled(d.cast("int"), i)), F.lit(0), lambda a, x: a + x)

    return let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), let(F.split(F.reverse(d), ""), total) % 10 == 0).otherwise(False))


def _small_parts(value: Column) -> Column:
    # Leading zeros do not count, so that a long part cannot overflow.
    return F.forall(F.split(value, r"\."), lambda part: let(F.ltrim(part, F.lit("0")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))))


def base_spans(text: Column) -> Column:
    """Structs (start, rank, end) of the fixed patterns, in order of rank, then start."""
    fits = lambda m: F.length(_digits(m)).between(9, 15)
    return F.concat(kept(spans(text, EMAIL), 0), kept(spans(text, IP), 1, _small_parts), kept(spans(text, CARD), 2, _luhn), kept(spans(text, PHONE), 3, fits))


def _replaced(text: Column, found: Column, by) -> Column:
    """text with the union of each run of overlapping spans of found (by start) replaced: by(span, its text) at the first, by(None, text) at what later ones add.

    The pieces between are cut out of blocks, each for itself, so that the cost grows with the text and the spans, not with their product.
    """

    def parts(x: Column) -> Column:
        cut, done = x["blocks"], x["ends"]

        def one(s: Column, i: Column) -> Column:
            at = F.when(i > 0, done[F.greatest(i - 1, F.lit(0))]).otherwise(0)
            own = piece(cut, F.greatest(s["start"], at), s["end"])
            return F.concat(piece(cut, at, s["start"]), F.when(s["start"] >= at, by(s, own)).otherwise(by(None, own)))

        return F.concat(F.array_join(F.transform(found, one), ""), piece(cut, done[F.size(done) - 1], F.length(text)))

    ends = let(F.transform(found, lambda s: s["end"]), lambda ends: running(ends, lambda a, x: F.greatest(a, x)))
    return F.when(F.size(found) > 0, let(F.struct(blocks(text).alias("blocks"), ends.alias("ends")), parts)).otherwise(text)


def masked(text: Column, base: Column) -> Column:
    """text with the characters of all base spans moved to the hidden range, at their places."""
    free = F.when(text.rlike(SEED), F.translate(text, _HIDDEN, chr(HIDDEN + 0xFF) * len(_HIDDEN))).otherwise(text)
    return _replaced(free, F.array_sort(base), lambda _, own: F.translate(own, _ASCII, _HIDDEN))


def _units(masked: str) -> tuple[Column, Column]:
    """The units of a masked text, in lower case, and their plain forms: seeds alike, and numbers alike."""
    small = F.lower(masked)
    plain = F.regexp_replace(F.regexp_replace(small, SEED, _HIDDEN[0]), "[0-9]+", "0")
    return F.regexp_extract_all(small, F.lit(UNIT), F.lit(0)), F.regexp_extract_all(plain, F.lit(UNIT), F.lit(0))


def _slots(texts: DataFrame) -> DataFrame:
    """row, masked -> a row for each unit: row, place, the unit (u0), and the plain forms of the two before it and the one after it (b2, b1, a1)."""
    u, p = _units("masked")
    arrays = texts.select("row", u.alias("u"), p.alias("p")).where(F.size("u") > 0)
    none, n = F.array(F.lit(None).cast("string")), F.size("u")
    before = lambda k: F.slice(F.concat(*[none] * k, F.col("p")), F.lit(1), n)
    zipped = {"u0": F.col("u"), "b2": before(2), "b1": before(1), "a1": F.slice("p", F.lit(2), F.greatest(n - 1, F.lit(0)))}
    arrays = arrays.select("row", *[c.alias(name) for name, c in zipped.items()])
    rows = arrays.select("row", F.posexplode(F.arrays_zip(*zipped)).alias("place", "s"))
    return rows.select("row", "place", *[F.col("s")[name].alias(name) for name in zipped])


def _is_seed(unit: Column) -> Column:
    return F.coalesce(unit.between(_HIDDEN[0], chr(HIDDEN + 127)), F.lit(False))


def _alone() -> list[Column]:
    """The hashes of the patterns that a unit alone stands in; null where it has no such neighbour."""
    b2, b1, a1 = F.col("b2"), F.col("b1"), F.col("a1")
    return [F.when(b1.isNotNull() & b2.isNotNull(), F.xxhash64(F.lit("2"), b2, b1)), F.when(b1.isNotNull(), F.xxhash64(F.lit("1"), b1)), F.when(a1.isNotNull(), F.xxhash64(F.lit("a"), a1))]


#: Columns of a pattern: its hash, and of a frame the unit before and the unit after.
PATTERN = ["pattern", "b1", "after"]


def _frame(before: Column, after: Column) -> Column:
    return F.xxhash64(F.lit("f"), before, after)


def _begin(before: Column) -> Column:
    return F.xxhash64(F.lit("b"), before)


def _told(known: DataFrame) -> DataFrame:
    """Slots of known units with their score -> PATTERN, told (the sum of the scores of the distinct units that stand in it) and support (their number)."""
    none = F.lit(None).cast("string")
    alone = known.select("u0", "score", F.explode(F.array_compact(F.array(*_alone()))).alias("pattern")).select("pattern", none.alias("b1"), none.alias("after"), "u0", "score")
    framed = known.where(F.col("b1").isNotNull() & F.col("a1").isNotNull()).select(_frame(F.col("b1"), F.col("a1")).alias("pattern"), "b1", F.col("a1").alias("after"), "u0", "score")
    return alone.union(framed).distinct().groupBy(*PATTERN).agg(F.sum("score").alias("told"), F.count("*").alias("support"))


def _groups(u: Column, p: Column, at: Column) -> Column:
    """The groups that begin at a place and the frames that they stand in: structs (place, size, instance, seed, pattern), null where there is none."""
    made = []
    for k in range(1, GROUP + 1):
        # The frame closes at the first such unit after it; a group of several units that holds a seed is none.
        closes = F.get(p, at + k).isNotNull()
        for j in range(1, k):
            closes = closes & (F.get(p, at + j) != F.get(p, at + k))
        if k > 1:
            closes = closes & ~F.exists(F.slice(u, at + 1, F.lit(k)), _is_seed)
        name = F.array_join(F.slice(u, at + 1, F.lit(k)), " ")
        made.append(F.when(closes, F.struct(at.alias("place"), F.lit(k).alias("size"), F.xxhash64(name).alias("instance"), _is_seed(F.get(u, at)).alias("seed"), _frame(F.get(p, at - 1), F.get(p, at + k)).alias("pattern"))))
    return F.array(*made)


def _hits(slots: DataFrame, alone: DataFrame, begun: DataFrame) -> DataFrame:
    """pattern, begins, row, place, instance, seed: the units in the patterns of alone, and those after which a frame of begun begins."""
    many = [alone.count(), begun.count()]
    probes = [*((c, alone, False) for c in _alone() if many[0]), *((F.when(F.col("b1").isNotNull(), _begin(F.col("b1"))), begun, True) for _ in range(min(1, many[1])))]
    own = [F.col("row"), F.col("place"), F.xxhash64("u0").alias("instance"), _is_seed(F.col("u0")).alias("seed")]
    if max(many) > KEYS_BROADCAST:
        keys = alone.withColumn("begins", F.lit(False)).union(begun.withColumn("begins", F.lit(True)))
        return slots.select(*own, F.explode(F.array_compact(F.array(*[c for c, _, _ in probes]))).alias("pattern")).join(keys, "pattern")
    # Few enough to be sent to all tasks: a unit is looked up in place, and only those that are in a pattern become rows.
    rows = slots.select(*own, *[c.alias(f"h{i}") for i, (c, _, _) in enumerate(probes)])
    for i, (_, keys, _) in enumerate(probes):
        rows = rows.join(F.broadcast(keys.select(F.col("pattern").alias(f"h{i}"), F.lit(True).alias(f"in{i}"))), f"h{i}", "left")
    there = [F.when(F.col(f"in{i}"), F.struct(F.col(f"h{i}").alias("pattern"), F.lit(begins).alias("begins"))) for i, (_, _, begins) in enumerate(probes)]
    if not there:
        return slots.select(F.lit(0).cast("long").alias("pattern"), F.lit(False).alias("begins"), *own).where(F.lit(False))
    return rows.where(F.coalesce(*[F.col(f"in{i}") for i in range(len(probes))])).select("row", "place", "instance", "seed", F.inline(F.array_compact(F.array(*there))))


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, row, place, size (in units), instance (its hash), seed: what stands in the patterns. One pass over all units gives those that stand in a pattern
    alone and the places where frames begin; only at these are groups put together."""
    columns = ["pattern", "row", "place", "size", "instance", "seed"]
    frames = patterns.where("after IS NOT NULL")
    hits = _hits(_slots(texts), patterns.where("after IS NULL").select("pattern"), frames.select(_begin(F.col("b1")).alias("pattern")).distinct())
    hits = staged(hits, "pii-hits")
    places = staged(hits.where("begins").groupBy("row").agg(F.collect_list("place").alias("places")), "pii-begun")
    both = F.struct(*[c.alias(name) for c, name in zip(_units("masked"), "up", strict=True)])
    found = let(both, lambda x: F.flatten(F.transform("places", lambda at: F.array_compact(_groups(x["u"], x["p"], at)))))
    framed = texts.select("row", "masked").join(places, "row").select("row", F.inline(found)).join(frames.select("pattern"), "pattern")
    return hits.where("NOT begins").withColumn("size", F.lit(1)).select(columns).union(framed.select(columns))


def bounds(found: DataFrame) -> DataFrame:
    """occurrences() -> pattern, least: no more distinct instances than the pattern has. The hashes of the instances set bits of a few longs, so
    tasks combine them whatever the number of occurrences."""
    place = F.pmod("instance", F.lit(64 * BOUND_WORDS)).cast("int")
    bit = F.expr("shiftleft(1L, CAST(pmod(instance, 64) AS INT))")
    words = [F.bit_or(F.when(F.floor(place / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(BOUND_WORDS)]
    total = F.lit(0)
    for i in range(BOUND_WORDS):
        total = total + F.bit_count(f"w{i}")
    return found.groupBy("pattern").agg(*words).select("pattern", total.alias("least"))


def bootstrap(texts: DataFrame, options: Bootstrap) -> DataFrame:
    """row, masked, base -> row, place, size of what stands in a trusted pattern and is no seed, after the rounds.

    Each round: the patterns that enough known units stand in; of those, the ones that can be trusted by a bound on their instances; of those
    the exact number of instances, and the ones that are trusted; the scores of what stands in them. Units that are found are known in the next round.
    Only patterns that the bounds of parts of the texts let through are looked for in all texts, so that a pattern as common as a word costs little.
    """
    nothing = texts.sparkSession.createDataFrame([], "row long, place int, size int")
    slots = _slots(texts)
    seeds = staged(_told(_slots(texts.where(F.size("base") > 0)).where(_is_seed(F.col("u0"))).withColumn("score", F.lit(1.0))), "pii-seeds")
    parts = [(share, texts.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0)) for share in PARTS]
    limits, places, told, trusted, before = [], [], seeds, None, None
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    for left in reversed(range(options.rounds)):
        possible = staged(told.where(F.col("support") >= options.support), "pii-patterns")
        if possible.isEmpty():
            return nothing
        for share, part in parts:
            # What a part of the texts says of a pattern's instances is a bound for all texts.
            known = [t for s, t in limits if s == share]
            new = possible.join(union(known).select("pattern"), "pattern", "left_anti") if known else possible
            limits.append((share, staged(bounds(occurrences(part, new)), "pii-bounds")))
            least = union([t for s, t in limits if s == share])
            possible = staged(possible.join(least, "pattern", "left").withColumn("least", F.coalesce("least", F.lit(0))).where(_sure(F.col("told"), F.col("least"), options)), "pii-possible")
            wide = possible.where(F.col("least") >= 48 * BOUND_WORDS)
            if not wide.isEmpty():
                # The bits of these are nearly full; a sketch with room for its error tells which have far too many instances.
                many = occurrences(part, wide.select(*PATTERN)).groupBy("pattern").agg((F.approx_count_distinct("instance", 0.02) * 0.8).alias("sketched"))
                possible = staged(possible.join(staged(many, "pii-sketched"), "pattern", "left").where(F.col("sketched").isNull() | _sure(F.col("told"), F.col("sketched"), options)).drop("sketched"), "pii-possible")
            possible = possible.drop("least")
        possible = staged(possible, "pii-possible")
        if possible.isEmpty():
            return nothing
        fresh = possible.join(union(places).select("pattern").distinct(), "pattern", "left_anti") if places else possible
        if not fresh.isEmpty():
            places.append(staged(occurrences(texts, fresh.select(*PATTERN)), "pii-places"))
        edges = staged(union(places).join(possible.select("pattern"), "pattern", "left_semi").groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed"), F.max("size").alias("size")), "pii-edges")
        sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        trusted = staged(possible.join(sizes, "pattern").where(_sure(F.col("told"), F.col("n"), options)).select("pattern", (F.col("told") / (F.col("n") + options.doubt)).alias("confidence")), "pii-trusted")
        doubts = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        gained = staged(edges.where("NOT seed AND size = 1").join(trusted, "pattern").groupBy("instance").agg((-F.expm1(doubts)).alias("score")), "pii-gained")
        state = trusted.agg(F.count("*"), F.sum("confidence")).first()
        if not left or gained.isEmpty() or state == before:
            break
        before = state
        known = slots.where(~_is_seed(F.col("u0"))).withColumn("instance", F.xxhash64("u0")).join(gained, "instance").drop("instance")
        both = seeds.unionByName(_told(known))
        told = staged(both.groupBy(*PATTERN).agg(F.sum("told").alias("told"), F.sum("support").alias("support")), "pii-told")
    return union(places).where("NOT seed").join(trusted.select("pattern"), "pattern", "left_semi").select("row", "place", "size")


def _sure(told: Column, n: Column, options: Bootstrap) -> Column:
    return told / (n + options.doubt) >= options.confidence


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, options: Bootstrap = Bootstrap(), base: str = "pii", extra: str = "context_pii") -> DataFrame:
    """The columns keep (all if None) and two columns of array<struct<start, rank, end>> in code points, end exclusive, ranks in KINDS.

    base: what the fixed patterns find, by rank, then start; extra: identifiers found by context that no base span overlaps, by start.
    A null or empty text has no spans; repeated rows each give a row; an empty table gives none.
    """
    carried = F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)])
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), carried.alias("kept"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scanned = scanned.withColumn("base", base_spans(F.col("text")))
    scanned = staged(scanned.select("row", "kept", "base", masked(F.col("text"), F.col("base")).alias("masked")), "pii-scanned", keep=True)

    with scratch(docs.sparkSession):
        hits = staged(bootstrap(scanned, options).select("row", "place", "size").distinct(), "pii-hits")
        # What lies within a larger group that was found is part of it.
        begins = hits.where("size > 1").select("row", F.col("place").alias("first"), "size", F.explode(F.sequence("place", F.col("place") + F.col("size") - 1)).alias("place"))
        within = begins.select("row", "place", F.col("size").alias("of"), F.explode(F.sequence(F.lit(1), F.col("first") + F.col("size") - F.col("place"))).alias("size")).where("size < of")
        hits = hits.join(within.select("row", "place", "size").distinct(), ["row", "place", "size"], "left_anti")
        found = staged(hits.groupBy("row").agg(F.collect_list(F.struct("place", "size")).alias("hits")), "pii-found")
        # Places in the text are worked out where something was found.
        units = scanned.select("row", "masked").join(found, "row").withColumn("units", spans(F.col("masked"), UNIT))
        ends = lambda h: F.struct(F.col("units")[h["place"]]["start"].alias("start"), F.lit(len(BASE)).alias("rank"), F.col("units")[h["place"] + h["size"] - 1]["end"].alias("end"))
        added = units.select("row", F.array_sort(F.transform("hits", ends)).alias("added"))
        # As a table its size is known: where it is small, the rows it goes to are not shuffled.
        added = staged(added, "pii-added", keep=True)
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return scanned.select("row", "kept", "base").join(added, "row", "left").select("kept.*", F.col("base").alias(base), F.coalesce("added", none).alias(extra))


def redact(text: Column, found: Column, kinds: list[str] = KINDS) -> Column:
    """text with the union of each run of overlapping spans of found (by start) replaced by the kind of its first, in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in kinds])
    return _replaced(text, found, lambda s, _: F.lit("") if s is None else names[s["rank"]])
