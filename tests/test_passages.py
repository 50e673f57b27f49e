"""Passages against a plain model that walks the body with a recursive pattern; inputs, errors and stage results."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import slices
from lacuna.operators import passages, stages

GROUP = r"(?<g>\{(?:[^{}\\]|\\.|(?&g))*\})"
HEADER = regex.compile(rf"\\(?<name>part|section|subsection|subsubsection)\*?\s*(?:\[(?:[^\[\]\\]|\\.)*\]\s*)?{GROUP}", regex.S)
CAPTION = regex.compile(rf"\\caption\s*(?:\[(?:[^\[\]\\]|\\.)*\]\s*)?{GROUP}", regex.S)
LEVELS = ["part", "section", "subsection", "subsubsection"]


def model(body):
    """(start, section, kind, text) by walking over headers, with a stack of titles."""
    heads = list(HEADER.finditer(body))
    cuts = [(0, 0, None)] + [(m.start(), m.end(), m) for m in heads]
    letter = all("acknowledg" in m["g"].lower() for m in heads)
    appendix = regex.search(r"\\appendix\b", body)
    stack, out = [], {}
    for k, (begin, start, m) in enumerate(cuts):
        end = cuts[k + 1][0] if k + 1 < len(cuts) else len(body)
        content = body[start:end]
        if m is None:
            name, late, flags = "Body" if letter else "Front matter", False, (False, letter, False)
        else:
            level, title = LEVELS.index(m["name"]), " ".join(m["g"][1:-1].split())
            stack = [s for s in stack if s[0] < level]
            late = bool(appendix) and begin > appendix.start()
            name = ("Appendix > " if late and not stack else "") + " > ".join([*(t for _, t in stack), title])
            stack.append((level, title))
            flags = tuple(any(regex.search(p, t) for _, t in stack) for p in (K.DATA_STATEMENT_TITLE, K.RESULTS_TITLE, K.SETUP_TITLE))
        statement, results, setup = flags
        if statement:
            out.setdefault((start, len(content)), (name, "data_statement_section"))
            continue
        if late:
            out.setdefault((begin, start - begin), (name, "appendix_header"))
        for c in CAPTION.finditer(content):
            t = c.group()
            if regex.search(K.FEYNMAN, t) or ((setup or regex.search(K.DIAGRAM, t)) and not regex.search(K.CAPTION_DATA, t)):
                continue
            out.setdefault((start + c.start(), len(t)), (name, "caption"))
        blank = regex.sub(r"(?s)\\begin\{(figure|table)\}.*?\\end\{\1\}", lambda f: "\n\n".ljust(len(f.group()), "\n"), content)
        for p in regex.finditer(r"\S(?:(?!\n[ \t]*\n).)*", blank, regex.S):
            t = p.group().rstrip()
            if regex.search(K.AVAILABILITY, t) or ((results or late) and regex.search(K.PRODUCT_WORDS, t)):
                out.setdefault((start + p.start(), len(t)), (name, "paragraph"))
    return sorted((at, n, body[at : at + n], *v) for (at, n), v in out.items())


def generated(rng):
    titles = ["Results", "Detector", "Data availability", "Nested {a {b {c {d {e}}}}}", "Acknowledgements", "Limits \\{open", "Summary"]
    sentences = ["The upper limits are shown.", "Tables are provided at HEPData.", "Nothing here.", "A fiducial cross section is measured.", "Brace \\} and {group {in {group {four {deep}}}}}."]
    captions = ["Observed yields.", "A Feynman diagram.", "Schematic of it.", "Observed {limits {at {95 {per cent}}}}.", "Observed yields."]
    parts = []
    for _ in range(rng.randrange(4, 16)):
        kind = rng.randrange(5)
        if kind == 0:
            parts.append(f"\\{rng.choice(LEVELS[1:])}{rng.choice(['', '*', '[short]'])}{{{rng.choice(titles)}}}")
        elif kind == 1:
            parts.append(f"\\begin{{figure}}\n\\caption{rng.choice(['', '[s]'])}{{{rng.choice(captions)}}}\n\\end{{figure}}")
        elif kind == 2 and rng.random() < 0.3:
            parts.append("\\appendix")
        else:
            parts.append(" ".join(rng.choices(sentences, k=rng.randrange(1, 3))))
    return rng.choice(["\n\n", "\n \t\n", "\n"]).join(parts)


def test_candidates_against_a_plain_model(spark):
    rng = random.Random(8)
    bodies = {f"p{i}": generated(rng) for i in range(120)}
    same = "\\begin{table}\\caption{Observed yields.}\\end{table}"
    bodies["twice"] = f"\\section{{Results}}\n{same}\n\nThe upper limits are shown.\n\n{same}\n\nThe upper limits are shown.\n"
    papers = spark.createDataFrame([(k, f"\\begin{{document}}{b}\\end{{document}}") for k, b in bodies.items()], "arxiv_id string, document string")
    got = {k: [] for k in bodies}
    for r in passages.candidates(passages.sections(passages.bodies(papers))).collect():
        got[r["arxiv_id"]].append((r["start"], len(r["text"]), r["text"], r["section_name"], r["kind"]))
    assert len(got["twice"]) == 4
    for k, body in bodies.items():
        assert sorted(got[k]) == model(body), k


def test_unbalanced_groups_are_loud(spark):
    bad = ["\\section{Open {group}", "\\caption[short{text}", "\\section[a] none", "\\section{fine}\\caption{ \\} "]
    good = ["\\section[x] {Fine \\{}", "no {command", "\\section {a}\n\\caption\n{b}"]
    rows = spark.createDataFrame(list(enumerate(bad + good)), "i int, t string").select("i", slices.arguments("t").alias("a")).collect()
    assert [r["i"] for r in rows if r["a"]["error"]] == [0, 1, 2, 3] and all(not r["a"]["found"] for r in rows if r["i"] < 4)
    papers = spark.createDataFrame([("p", f"\\begin{{document}}{bad[0]}\\end{{document}}")], "arxiv_id string, document string")
    with pytest.raises(Exception, match="unbalanced"):
        passages.sections(passages.bodies(papers)).collect()


def test_papers_with_errors_keep_the_others_going(spark):
    rows = [
        ("good", {"main.tex": "\\documentclass{a}\\begin{document}\\section{Results}\nThe upper limits are shown.\n\\input{one}\\end{document}", "one.tex": "\\input{none}\\input{author_list}\\input{two}", "two.tex": "\\input{gone}", "lost.tex": "\\input{nowhere}"}),
        ("circle", {"main.tex": "\\begin{document}\\input{a}\\input{a}\\end{document}", "a.tex": "\\input{b} \\input{b}", "b.tex": "\\input{a}\\input{a}"}),
        ("open", {"main.tex": "\\begin{document}\\section{x\\end{document}"}), ("none", {"main.tex": "no environment"}), ("empty", {}),
        ("deep", {"main.tex": "\\begin{document}\\input{f0}\\end{document}"} | {f"f{i}.tex": f"\\input{{f{i + 1}}}" for i in range(25)}),
        ("beside", {"sub/main.tex": "\\begin{document}\\input{./part}\\end{document}", "sub/part.tex": "own", "part.tex": "other"}),
    ]
    sources = spark.createDataFrame(rows, "arxiv_id string, tex_files map<string,string>")
    summary, found = stages.select_passages(sources)
    got = {r["arxiv_id"]: r for r in summary.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"good": "ok", "circle": "filter_error", "open": "filter_error", "none": "filter_error", "empty": "filter_error", "deep": "filter_error", "beside": "ok"}
    assert "circle" in got["circle"]["detail"] and "deeper" in got["deep"]["detail"] and got["empty"]["detail"] == "no files"
    assert got["good"]["missing_inputs"] == ["none", "gone"] and got["good"]["skipped_inputs"] == ["author_list"]
    assert [r["text"] for r in found.collect()] == ["The upper limits are shown."]
    assert {r["arxiv_id"]: r["document"] for r in passages.documents(sources).collect()}["beside"] == "\\begin{document}own\\end{document}"


def test_gaps_and_trimmed(spark):
    row = spark.createDataFrame([("ab  \n\n  cd\n\n\n\n e ",)], "t string").select(slices.gaps(F.col("t"), "\n\n").alias("g"), slices.trimmed(slices.gaps(F.col("t"), "\n\n")).alias("t")).first()
    assert [tuple(x) for x in row["g"]] == [(0, "ab  "), (6, "  cd"), (12, ""), (14, " e ")]
    assert [tuple(x) for x in row["t"]] == [(0, "ab"), (8, "cd"), (15, "e")]


def test_texts_without_commands_are_not_read_for_groups(monkeypatch):
    def none(text):
        raise AssertionError("groups of a text without commands")

    monkeypatch.setattr(slices, "Braces", none)
    assert slices._arguments("{ " * 9 + r"\emph{x} and [no command") == (None, [])


def test_what_is_wanted_holds_a_hint(spark):
    """Paragraphs and whole bodies are left out by hints alone, never one that a pattern would take; the cut at the document's ends is the pattern's."""
    said = ["HEPDATA", "Rivet", "pyhf", "SimpleAnalysis", "Auxiliary\tfigures", "supplementary", "Additional  table", "are publicly available.", "Available from x", "provided at x", "can be found in the appendix", "HTTPS://x", r"\url{x}", r"\href{x}{y}",
            "Cut-flows", "cutflow", "efficiency maps", "Covariance matrix", "CORRELATION matrices", "full likelihood", "likelihoods are released", "Upper Limits", "exclusion contour", "is excluded", "total cross-section", "CROSS sections were measured",
            "unfolded data", "likelihood  scan", "acceptance × efficiency", r"Acceptance \times efficiency"]
    other = ["the found word is alone", "a limit", "nothing of the kind", "  ", r"\begin{table} cutflow \end{table}"]
    text = "\n\n".join(x for pair in zip(said, other * 6, strict=True) for x in pair)
    documents = {"a": rf"x \end{{document}} \begin{{document}}{text}\end{{document}} cutflow \end{{document}}", "b": rf"\begin{{document}} {said[0]}", "c": "no document, cutflow", "d": rf"\begin{{document}}\end{{document}}", "e": r"\begin{document} 𝒳é nothing \end{document}"}
    rows = spark.createDataFrame(list(documents.items()), "arxiv_id string, document string")
    got = passages.bodies(rows)
    cut = F.regexp_extract("document", r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\z)", 1)
    assert got.where(~F.col("body").eqNullSafe(cut)).count() == 0
    found = passages.candidates(passages.sections(got))
    assert {(r["arxiv_id"], r["text"]) for r in found.collect()} == {*(("a", x.strip()) for x in said), ("b", said[0])}
    assert passages.bodies(spark.createDataFrame([(None,)], "document string")).first()["body"] is None
