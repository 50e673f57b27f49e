"""English stems by the published Porter2 rules, as column expressions and for single words.

A rule is a set of endings, the longest of which is looked for, what it becomes, and the region that it has to lie in. Both forms read the same rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm: vowels, regions, endings and what they become, exceptions.
VOWELS = "aeiouy"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
SHORT = f"(?:^[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])$"
FIRST_REGION = f"^(?:gener|commun|arsen|.*?[{VOWELS}][^{VOWELS}])"
SECOND_REGION = f"^.*?[{VOWELS}][^{VOWELS}]"


@dataclass(frozen=True)
class Rule:
    """endings: what each becomes; after: what has to stand before an ending for it to count; region: 1 or 2, or the region of single endings."""

    endings: dict[str, str]
    region: int
    after: dict[str, str]
    regions: dict[str, int]

    def pattern(self) -> str:
        """The longest ending, as the leftmost match."""
        parts = [(f"(?<={self.after[e]})" if e in self.after else "") + e for e in sorted(self.endings, key=len, reverse=True)]
        return f"(?:{'|'.join(parts)})$"


def _rule(endings: dict[str, str], region: int, after: dict[str, str] | None = None, regions: dict[str, int] | None = None) -> Rule:
    return Rule(endings, region, after or {}, regions or {})


RULES = [
    _rule(
        {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
         "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
         "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}, 1, {"ogi": "l", "li": "[cdeghkmnrt]"},
    ),
    _rule({"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}, 1, None, {"ative": 2}),
    _rule(dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"], ""), 2, {"ion": "[st]"}),
]


_COMPILED = [re.compile(rule.pattern()) for rule in RULES]


def stem(word: str) -> str:
    """The stem of one word of letters and digits in lower case."""
    if len(word) <= 2 or word in EXCEPTIONS:
        return EXCEPTIONS.get(word, word)
    word = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", word)
    first = len(m[0]) if (m := re.search(FIRST_REGION, word)) else len(word)
    second = first + len(m[0]) if (m := re.search(SECOND_REGION, word[first:])) else len(word)
    found = (m := re.search("(?:sses|ied|ies|us|ss|s)$", word)) and m[0]
    if found == "sses":
        word = word[:-2]
    elif found in ("ied", "ies"):
        word = word[: -2 if len(word) > 4 else -1]
    elif found == "s" and re.search(f"[{VOWELS}].+s$", word):
        word = word[:-1]
    if word in FINISHED:
        return word
    found = (m := re.search("(?:eedly|eed|ingly|edly|ing|ed)$", word)) and m[0]
    if found in ("eed", "eedly"):
        word = word[: -len(found)] + "ee" if len(word) - len(found) >= first else word
    elif found and re.search(f"[{VOWELS}]", word[: -len(found)]):
        word = word[: -len(found)]
        if re.search("(?:at|bl|iz)$", word):
            word += "e"
        elif re.search("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif first >= len(word) and re.search(SHORT, word):
            word += "e"
    word = re.sub(f"(?<=.[^{VOWELS}])[yY]$", "i", word)
    for rule, pattern in zip(RULES, _COMPILED, strict=True):
        if m := pattern.search(word):
            if len(word) - len(m[0]) >= (first, second)[rule.regions.get(m[0], rule.region) - 1]:
                word = word[: -len(m[0])] + rule.endings[m[0]]
    at = len(word) - 1
    if word.endswith("e") and (at >= second or (at >= first and not re.search(SHORT, word[:-1]))) or (word.endswith("ll") and at >= second):
        word = word[:-1]
    return word.replace("Y", "y")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _without_s(word: Column) -> Column:
    ended = F.when(word.endswith("sses"), _cut(word, 2)).when(word.rlike("ie[ds]$"), F.when(F.length(word) > 4, _cut(word, 2)).otherwise(_cut(word, 1)))
    return ended.when(word.rlike("(?:us|ss)$"), word).when(word.rlike(f"[{VOWELS}].+s$"), _cut(word, 1)).otherwise(word)


def _without_ed(word: Column, first: Column) -> Column:
    def mended(short: Column) -> Column:
        return (
            F.when(short.rlike("(?:at|bl|iz)$"), F.concat(short, F.lit("e")))
            .when(short.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(short, 1))
            .when((first >= F.length(short)) & short.rlike(SHORT), F.concat(short, F.lit("e")))
            .otherwise(short)
        )

    eed = F.regexp_extract(word, "eed(?:ly)?$", 0)
    in_region = F.length(word) - F.length(eed) >= first
    ed = F.regexp_extract(word, "(?:ingly|edly|ing|ed)$", 0)
    before = F.substring(word, F.lit(1), F.length(word) - F.length(ed))
    return F.when(eed != "", F.when(in_region, F.regexp_replace(word, "eed(?:ly)?$", "ee")).otherwise(word)).when((ed != "") & before.rlike(f"[{VOWELS}]"), _let(before, mended)).otherwise(word)


def _by(rule: Rule, word: Column, first: Column, second: Column) -> Column:
    becomes = F.create_map(*[F.lit(x) for pair in rule.endings.items() for x in pair])

    def changed(ending: Column) -> Column:
        at = F.length(word) - F.length(ending)
        within = lambda n: at >= (first, second)[n - 1]
        fits = within(rule.region)
        for e, n in rule.regions.items():
            fits = F.when(ending == e, within(n)).otherwise(fits)
        return F.when((ending != "") & fits, F.concat(F.substring(word, F.lit(1), at), becomes[ending])).otherwise(word)

    return _let(F.regexp_extract(word, rule.pattern(), 0), changed)


def _without_e(word: Column, first: Column, second: Column) -> Column:
    at = F.length(word) - 1
    e = word.endswith("e") & ((at >= second) | ((at >= first) & ~_cut(word, 1).rlike(SHORT)))
    return F.when(e | (word.endswith("ll") & (at >= second)), _cut(word, 1)).otherwise(word)


def stemmed(word: Column) -> Column:
    """The stem of each word of letters and digits; capitals count as small letters, null stays null."""

    def changed(w: Column) -> Column:
        length = lambda found, text: F.when(found == "", F.length(text)).otherwise(F.length(found))
        first = length(F.regexp_extract(w, FIRST_REGION, 0), w)
        rest = lambda n: F.substring(w, n + 1, F.length(w))
        second = lambda n: n + length(F.regexp_extract(rest(n), SECOND_REGION, 0), rest(n))
        regions = _let(first, lambda n: F.struct(n.alias("first"), second(n).alias("second")))
        return _let(F.struct(w.alias("w"), regions.alias("r")), lambda x: steps(x["w"], x["r"]["first"], x["r"]["second"]))

    def steps(w: Column, first: Column, second: Column) -> Column:
        def by(rule: Rule):
            return lambda x: _by(rule, x, first, second)

        def rest(w: Column) -> Column:
            done = _let(_without_ed(w, first), lambda x: F.regexp_replace(x, f"(?<=.[^{VOWELS}])[yY]$", "i"))
            for rule in RULES:
                done = _let(done, by(rule))
            return _let(done, lambda x: F.translate(_without_e(x, first, second), "Y", "y"))

        return _let(_without_s(w), lambda x: F.when(x.isin(FINISHED), x).otherwise(rest(x)))

    def whole(w: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
        marked = F.regexp_replace(w, f"^y|(?<=[{VOWELS}])y", "Y")
        return F.when(w.isin(list(EXCEPTIONS)), known[w]).when(F.length(w) <= 2, w).otherwise(_let(marked, changed))

    return _let(F.lower(word), whole)
