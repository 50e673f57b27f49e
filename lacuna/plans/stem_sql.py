"""The English stems in SQL: common table expressions for the queries' SQL, from the same fixed endings as the library's expressions."""

from __future__ import annotations

from lacuna.functions.stems import EXCEPTIONS, FINISHED, FIRST_REGION, RULES, SECOND_REGION, SHORT, VOWELS, Rule


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _region(text: str, pattern: str) -> str:
    return f"coalesce(nullif(length(regexp_extract({text}, '{pattern}')), 0), length({text}))"


def _rule(rule: Rule) -> tuple[str, str]:
    """The ending that x has, and x after the rule."""
    longest = sorted(rule.endings, key=len, reverse=True)
    ending = "CASE " + " ".join(f"WHEN regexp_matches(x, '{rule.after.get(e, '')}{e}$') THEN '{e}'" for e in longest) + " ELSE '' END"
    regions = "CASE " + " ".join(f"WHEN e = '{e}' THEN r{n}" for e, n in rule.regions.items()) + f" ELSE r{rule.region} END" if rule.regions else f"r{rule.region}"
    becomes = "CASE e " + " ".join(f"WHEN '{e}' THEN '{b}'" for e, b in rule.endings.items()) + " END"
    return ending, f"CASE WHEN e <> '' AND length(x) - length(e) >= {regions} THEN left(x, length(x) - length(e)) || {becomes} ELSE x END"


def stem_tables(words: str) -> str:
    """CTEs after one named words with distinct w (letters and digits in lower case): the last is stems (w, stem)."""
    rest = f"substr(x, r1 + 1)"
    out = [
        rf"k0 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([{VOWELS}])y', '\1Y', 'g') AS x FROM {words})",
        f"k1 AS (SELECT w, x, {_region('x', FIRST_REGION)} AS r1 FROM k0)",
        f"k2 AS (SELECT w, x, r1, r1 + {_region(rest, SECOND_REGION)} AS r2 FROM k1)",
        f"""k3 AS (SELECT w, r1, r2, CASE WHEN x LIKE '%sses' THEN left(x, length(x) - 2) WHEN regexp_matches(x, 'ie[ds]$') THEN left(x, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
            WHEN regexp_matches(x, '(us|ss)$') THEN x WHEN regexp_matches(x, '[{VOWELS}].+s$') THEN left(x, length(x) - 1) ELSE x END AS x FROM k2)""",
        "k4 AS (SELECT *, regexp_extract(x, 'eed(ly)?$') AS eed, regexp_extract(x, '(ingly|edly|ing|ed)$') AS ed FROM k3)",
        f"""k5 AS (SELECT w, r1, r2, x AS whole, eed, CASE WHEN eed <> '' THEN CASE WHEN length(x) - length(eed) >= r1 THEN left(x, length(x) - length(eed)) || 'ee' ELSE x END
            WHEN ed <> '' AND regexp_matches(left(x, length(x) - length(ed)), '[{VOWELS}]') THEN left(x, length(x) - length(ed)) ELSE x END AS x FROM k4)""",
        f"""k6 AS (SELECT w, whole, r1, r2, CASE WHEN eed <> '' OR x = whole THEN x WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN regexp_matches(x, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(x, length(x) - 1)
            WHEN r1 >= length(x) AND regexp_matches(x, '{SHORT}') THEN x || 'e' ELSE x END AS x FROM k5)""",
        f"k7 AS (SELECT w, whole, r1, r2, CASE WHEN regexp_matches(x, '.[^{VOWELS}][yY]$') THEN left(x, length(x) - 1) || 'i' ELSE x END AS x FROM k6)",
    ]
    for n, rule in enumerate(RULES):
        ending, changed = _rule(rule)
        out.append(f"e{n} AS (SELECT *, {ending} AS e FROM {f'm{n - 1}' if n else 'k7'})")
        out.append(f"m{n} AS (SELECT w, whole, r1, r2, {changed} AS x FROM e{n})")
    at = "length(x) - 1"
    cut = f"(x LIKE '%e' AND ({at} >= r2 OR ({at} >= r1 AND NOT regexp_matches(left(x, {at}), '{SHORT}')))) OR (x LIKE '%ll' AND {at} >= r2)"
    known = "CASE w " + " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in EXCEPTIONS.items()) + " END"
    out.append(
        f"stems AS (SELECT w, CASE WHEN w IN ({_quoted(EXCEPTIONS)}) THEN {known} WHEN length(w) <= 2 THEN w WHEN whole IN ({_quoted(FINISHED)}) THEN whole"
        f" ELSE replace(CASE WHEN {cut} THEN left(x, {at}) ELSE x END, 'Y', 'y') END AS stem FROM m{len(RULES) - 1})"
    )
    return ",\n    ".join(out)
