"""LaTeX sources to candidate passages, passages to requests, quotes to verified products: as column expressions, joins and windows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import scalars, slices, text
from lacuna.operators import anchors
from lacuna.staging import staged

MAX_INPUT_DEPTH = 20
# Patterns that results depend on.
_FLOAT = r"\\begin\{(figure\*?|table\*?|sidewaysfigure|sidewaystable|wrapfigure|wraptable)\}.*?\\end\{\1\}"
_BIBLIOGRAPHY = r"\\begin\{thebibliography\}.*?\\end\{thebibliography\}|\\printbibliography(?:\[[^\]]*\])?|\\bibliography\{[^}]*\}"
_INPUT = r"\\(?:input|include)\s*\{([^}]+)\}"
_AUTHORS = r"(?i)auth(or)?s?_?list"
_LEVELS = ["part", "section", "subsection", "subsubsection"]
_PARAGRAPH_BREAK = r"\n[ \t]*\n"

# Marks in a text whose inputs are not put in yet: an input with the files that it is within, one that no file has, one left out, a circle.
_PUT, _WITHIN, _END, _MISSING, _SKIPPED, _CIRCLE, _STEP = (chr(k) for k in (1, 2, 3, 4, 5, 6, 7))


def _marked(kind: str) -> str:
    return f"{kind}([^{_END}]*){_END}"


def documents(sources: DataFrame) -> DataFrame:
    """sources (arxiv_id, tex_files map) -> arxiv_id, main_file, document, missing_inputs, skipped_inputs, error: a row for each source.

    The main file has a document environment, a document class if any has, and is the longest of those. Inputs are looked for beside the
    including file, then at the root; author lists are left out. Inputs that are not there and those left out are told of files that the main file
    reaches, in order. error is null, or says what is wrong: no files, none with a document, inputs in a circle or nested deeper than MAX_INPUT_DEPTH; then document is null.
    """
    files = sources.select("arxiv_id", F.posexplode("tex_files").alias("place", "name", "raw"), F.map_keys("tex_files").alias("names"))
    files = files.withColumn("stripped", text.strip_comments(F.col("raw")))
    folder = F.regexp_extract("name", r"^(.*/)?[^/]*$", 1)

    def resolved(target: Column) -> Column:
        tidy = lambda p: F.regexp_replace(p, r"(^|/)(?:\./)+", "$1")
        ways = F.array(*[tidy(F.concat(base, target, F.lit(end))) for end in ("", ".tex") for base in (folder, F.lit(""))])
        return F.get(F.filter(ways, lambda w: F.array_contains("names", w)), F.lit(0))

    def mark(target: Column) -> Column:
        name = resolved(target)
        put = F.concat(F.lit(_PUT + _WITHIN), name, F.lit(_END))
        return F.when(target.rlike(_AUTHORS), F.concat(F.lit(_SKIPPED), target, F.lit(_END))).when(name.isNull(), F.concat(F.lit(_MISSING), target, F.lit(_END))).otherwise(put)

    targets = F.regexp_extract_all("stripped", F.lit(_INPUT), F.lit(1))
    pieces = F.zip_with(F.split("stripped", _INPUT, -1), F.transform(targets, lambda t: mark(F.trim(t))), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    files = files.withColumn("marked", F.array_join(pieces, ""))
    main = F.max_by("name", F.when(F.contains("stripped", F.lit(r"\begin{document}")), F.struct(F.contains("raw", F.lit(r"\documentclass")), F.length("raw"), -F.col("place"))))
    papers = files.groupBy("arxiv_id").agg(main.alias("main_file"), F.map_from_entries(F.collect_list(F.struct("name", "marked"))).alias("files"))
    # A mark says within which files it stands, so a circle is known at its first turn.
    inside = lambda marked, within: F.replace(marked, F.lit(_PUT + _WITHIN), F.concat(F.lit(_PUT), within, F.lit(_WITHIN)))
    within_main = F.concat(F.lit(_STEP), "main_file", F.lit(_STEP))
    papers = papers.withColumn("document", inside(F.col("files")[F.col("main_file")], within_main))

    def put_in(state: Column, _: Column) -> Column:
        pattern = f"{_PUT}([^{_WITHIN}]*){_WITHIN}([^{_END}]*){_END}"
        marks = F.arrays_zip(F.regexp_extract_all(state, F.lit(pattern), F.lit(1)).alias("within"), F.regexp_extract_all(state, F.lit(pattern), F.lit(2)).alias("name"))

        def put(m: Column) -> Column:
            step = F.concat(m["name"], F.lit(_STEP))
            again = F.contains(m["within"], F.concat(F.lit(_STEP), step))
            return F.when(again, F.concat(F.lit(_CIRCLE), m["name"], F.lit(_END))).otherwise(inside(F.col("files")[m["name"]], F.concat(m["within"], step)))

        parts = F.zip_with(F.split(state, pattern, -1), F.transform(marks, put), lambda gap, own: F.concat(gap, F.coalesce(own, F.lit(""))))
        return F.when(F.contains(state, F.lit(_PUT)), F.array_join(parts, "")).otherwise(state)

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_INPUT_DEPTH)), F.col("document"), put_in)
    papers = papers.withColumn("document", whole)
    listed = lambda kind: F.coalesce(F.regexp_extract_all("document", F.lit(_marked(kind)), F.lit(1)), F.array().cast("array<string>"))
    found = sources.select("arxiv_id", (F.coalesce(F.size("tex_files"), F.lit(0)) > 0).alias("any")).join(papers, "arxiv_id", "left")
    error = (
        F.when(~F.col("any"), "no files")
        .when(F.col("main_file").isNull(), "no file has a document")
        .when(F.contains("document", F.lit(_CIRCLE)), F.concat(F.lit("inputs in a circle: "), F.regexp_extract("document", _marked(_CIRCLE), 1)))
        .when(F.contains("document", F.lit(_PUT)), f"inputs nested deeper than {MAX_INPUT_DEPTH}")
    )
    clean = F.regexp_replace("document", f"[{_MISSING}{_SKIPPED}][^{_END}]*{_END}", "")
    return found.withColumns({"error": error, "missing_inputs": listed(_MISSING), "skipped_inputs": listed(_SKIPPED)}).select("arxiv_id", "main_file", F.when(F.col("error").isNull(), clean).alias("document"), "missing_inputs", "skipped_inputs", "error")


def bodies(papers: DataFrame) -> DataFrame:
    """papers with body, body_tokens (without the bibliography) and the headers and captions of the body (arguments). An unbalanced group becomes the error of a paper
    that has none yet."""
    begin = F.instr("document", r"\begin{document}")
    body = F.when(begin == 0, "").when(begin > 0, F.substring_index(F.substr("document", begin + len(r"\begin{document}")), r"\end{document}", 1))
    found = papers.withColumn("body", body).withColumn("body_tokens", scalars.approx_tokens(F.regexp_replace("body", f"(?s){_BIBLIOGRAPHY}", "")))
    # Texts without a command need not be read in Python.
    found = found.withColumn("arguments", slices.arguments(F.when(F.contains("body", F.lit("\\")), F.col("body"))))
    error = F.col("arguments.error") if "error" not in papers.columns else F.coalesce("error", "arguments.error")
    return found.withColumn("error", error).withColumn("arguments", F.col("arguments.found"))


def sections(papers: DataFrame) -> DataFrame:
    """arxiv_id, body, arguments, error -> a row for each section: ordinal, begins (where its header is in the body), header, start (where its content is), content, captions (start, text),
    level, title, path and flags. A paper with an error is an error here; leave such papers out before.

    What stands before the first header is a section of its own; if there is no header but acknowledgements, it is the whole letter and read like results.
    """
    loud = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("arxiv_id", F.lit(": "), "error")).cast("string")).otherwise(F.col("body"))
    slice_ = lambda start, end: F.substring("body", start + 1, end - start)
    heads = F.filter("arguments", lambda a: a["name"] != "caption")
    captions = F.transform(F.filter("arguments", lambda a: a["name"] == "caption"), lambda a: F.struct(a["start"].alias("start"), slice_(a["start"], a["end"]).alias("text")))
    whole = F.struct(F.lit("").alias("name"), F.lit(0).alias("start"), F.lit(0).alias("open"), F.lit(0).alias("end"))
    rows = papers.withColumn("body", loud).withColumns({"all": F.concat(F.array(whole), heads), "captions": captions})
    rows = rows.select("arxiv_id", "body", "all", "captions", F.posexplode("all").alias("ordinal", "h"))
    following = F.coalesce(F.get("all", F.col("ordinal") + 1)["start"], F.length("body"))
    appendix = F.regexp_instr("body", F.lit(r"\\appendix\b"))
    rows = rows.withColumn("until", following).select(
        "arxiv_id", "ordinal", F.col("h.start").alias("begins"), slice_(F.col("h.start"), F.col("h.end")).alias("header"), F.col("h.end").alias("start"), slice_(F.col("h.end"), F.col("until")).alias("content"),
        F.filter("captions", lambda c: (c["start"] >= F.col("h.end")) & (c["start"] < F.col("until"))).alias("captions"),
        F.when(F.col("ordinal") == 0, -1).otherwise(F.array_position(F.array(*map(F.lit, _LEVELS)), F.col("h.name")).cast("int") - 1).alias("level"),
        scalars.collapse(slice_(F.col("h.open"), F.col("h.end") - 1)).alias("title"),
        ((F.col("ordinal") > 0) & (appendix > 0) & (F.col("h.start") > appendix - 1)).alias("in_appendix"),
    )
    paper = Window.partitionBy("arxiv_id")
    before = paper.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("letter", F.count_if((F.col("ordinal") > 0) & ~F.col("title").rlike("(?i)acknowledg")).over(paper) == 0)
    for k in range(len(_LEVELS)):
        held = F.last(F.when(F.col("level") == k, F.struct("title", F.lit(True).alias("there"))).when(F.col("level") < k, F.struct(F.lit("").alias("title"), F.lit(False).alias("there"))), True).over(before)
        rows = rows.withColumn(f"a{k}", F.when((F.col("level") > k) & held["there"], held["title"]))
    above = F.filter(F.array(*[F.col(f"a{k}") for k in range(len(_LEVELS))]), lambda t: t.isNotNull())
    rows = rows.withColumn("above", above)
    front = F.when(F.col("letter"), "Body").otherwise("Front matter")
    prefix = F.when(F.col("in_appendix") & (F.size("above") == 0), "Appendix > ").otherwise("")
    path = F.when(F.col("ordinal") == 0, front).otherwise(F.concat(prefix, F.array_join(F.concat("above", F.array("title")), " > ")))
    flag = lambda pattern: (F.col("ordinal") > 0) & F.exists(F.concat("above", F.array("title")), lambda t: t.rlike(pattern))
    results = F.when(F.col("ordinal") == 0, F.col("letter")).otherwise(flag(K.RESULTS_TITLE))
    return rows.withColumns({"path": path, "results_like": results, "data_statement": flag(K.DATA_STATEMENT_TITLE), "setup_like": flag(K.SETUP_TITLE)}).drop("letter", "above", *[f"a{k}" for k in range(len(_LEVELS))])


def candidates(found: DataFrame) -> DataFrame:
    """sections() -> arxiv_id, ordinal, start (in the body), section_name, kind, text: each a slice of the body, told by its place, so that a text that comes twice is
    two candidates; of one place the first reason counts."""
    of = lambda parts, kind: F.transform(parts, lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["text"].alias("text")))
    alone = lambda start, c: F.array(F.struct(F.col(start).alias("start"), F.col(c).alias("text")))
    weak = lambda c: F.col("setup_like") | c["text"].rlike(K.DIAGRAM)
    captions = F.filter("captions", lambda c: ~c["text"].rlike(K.FEYNMAN) & (~weak(c) | c["text"].rlike(K.CAPTION_DATA)))
    # Few paragraphs hold a word that what is wanted needs; others are not split off, trimmed or searched.
    hints = list(dict.fromkeys(K.AVAILABILITY_HINTS + K.PRODUCT_HINTS))
    hinted = lambda c: F.exists(F.array(F.lower(c)), lambda low: functools.reduce(operator.or_, [F.contains(low, F.lit(h)) for h in hints]))
    # All separators begin with one of two characters.
    split = slices.gaps(F.col("content"), rf"(?s)(?=[\\\n])(?:{_FLOAT}|{_BIBLIOGRAPHY}|{_PARAGRAPH_BREAK})")
    paragraphs = slices.trimmed(F.filter(F.when(hinted(F.col("content")), split), lambda p: hinted(p["text"])))
    paragraphs = F.coalesce(paragraphs, F.array().cast(slices.GAP))
    wanted = lambda p: p["text"].rlike(K.AVAILABILITY) | ((F.col("results_like") | F.col("in_appendix")) & p["text"].rlike(K.PRODUCT_WORDS))
    paragraphs = F.transform(F.filter(paragraphs, wanted), lambda p: F.struct((p["start"] + F.col("start")).alias("start"), p["text"].alias("text")))
    nothing = F.array().cast("array<struct<kind:string,start:int,text:string>>")
    picked = F.when(F.col("data_statement"), of(alone("start", "content"), "data_statement_section")).otherwise(
        F.concat(F.when(F.col("in_appendix"), of(alone("begins", "header"), "appendix_header")).otherwise(nothing), of(captions, "caption"), of(paragraphs, "paragraph"))
    )
    rows = found.select("arxiv_id", "ordinal", "path", F.posexplode(picked).alias("order", "c"))
    first = rows.groupBy("arxiv_id", F.col("c.start").alias("start"), F.length("c.text").alias("chars")).agg(F.min_by(F.struct("ordinal", "path", "c"), F.struct("ordinal", "order")).alias("f"))
    return first.select("arxiv_id", "f.ordinal", "start", F.col("f.path").alias("section_name"), F.col("f.c.kind").alias("kind"), F.col("f.c.text").alias("text"))


def _packed(pieces: Column, limit: int) -> Column:
    """Neighbouring pieces joined while they fit limit characters."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    step = lambda s, p: F.when((s["open"] != "") & (F.length(s["open"]) + F.length(p) > limit), F.struct(F.array_append(s["done"], s["open"]).alias("done"), p.alias("open"))).otherwise(
        F.struct(s["done"].alias("done"), F.concat(s["open"], p).alias("open"))
    )
    return F.aggregate(pieces, zero, step, lambda s: F.array_append(s["done"], s["open"]))


def split_text(value: Column, max_tokens: int, per_token: float = 4) -> Column:
    """Pieces of max_tokens at most, each a trimmed slice: cut at paragraphs, else lines, else sentences, else at a fixed width."""
    limit = int(max_tokens * per_token)
    trimmed = lambda pieces: F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")

    def level(piece: Column, breaks: list[str]) -> Column:
        if not breaks:
            cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(piece) - 1) / limit).cast("int")), lambda i: F.substring(piece, i * limit + 1, F.lit(limit)))
            return trimmed(cut)
        parts = F.split(F.regexp_replace(piece, f"({breaks[0]})", "$1\u0001"), "\u0001")
        return F.flatten(F.transform(trimmed(_packed(parts, limit)), lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(level(p, breaks[1:]))))

    return F.when(F.length(value) <= limit, F.array(value)).otherwise(level(value, [r"\n[ \t]*\n", r"\n", r"(?<=[.;])\s+"]))


def chunk_numbers(tokens: Column, budget: int) -> Column:
    """The chunk of each passage: passages in order, a chunk closed when the next one would exceed the budget."""
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + t > budget)
        chunk = s["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(full, t).otherwise(s["used"] + t).cast("long").alias("used"), F.array_append(s["out"], chunk).alias("out"))

    return F.aggregate(tokens, zero, step, lambda s: s["out"])


def chunks(found: DataFrame, paper: str = "arxiv_id", budget: int = 2000) -> DataFrame:
    """candidates() -> paper, chunk, passage_id (from 1 in each chunk), section_name, kind, text. A group is one paper's passages."""
    pieces = found.select(paper, "ordinal", "start", "section_name", "kind", F.posexplode(split_text(F.col("text"), budget)).alias("piece", "text"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "start", "piece", "section_name", "kind", "text")))
    papers = pieces.groupBy(paper).agg(ordered.alias("p"))
    papers = papers.withColumn("chunk", chunk_numbers(F.transform("p", lambda x: scalars.approx_tokens(x["text"])), budget))
    rows = papers.select(paper, F.posexplode(F.arrays_zip("p", "chunk")).alias("place", "x")).select(paper, "place", "x.chunk", "x.p.section_name", "x.p.kind", "x.p.text")
    return rows.withColumn("passage_id", F.row_number().over(Window.partitionBy(paper, "chunk").orderBy("place"))).drop("place")


def verified(products: DataFrame, passages: DataFrame, by: list[str]) -> DataFrame:
    """products (with passage_id, evidence_span) against the passages of the same request: evidence or drop_reason.

    A quote under MIN_SPAN_CHARS characters without white space is too_short; the cited passage is tried first, then the others in
    order; the evidence is the passage's own slice.
    """
    # Written once: both sides of the join below must see the same numbers.
    numbered = staged(products.withColumn("__product", F.monotonically_increasing_id()), "numbered-products")
    long_enough = F.length(scalars.squash(F.col("evidence_span"))) >= K.MIN_SPAN_CHARS
    cited = F.col("passage_id") == F.col("__passage")
    pairs = numbered.where(long_enough).select(*by, "__product", "passage_id", "evidence_span").join(passages.select(*by, F.col("passage_id").alias("__passage"), "section_name", "kind", "text"), by)
    pairs = pairs.withColumn("at", text.located(F.col("evidence_span"), F.col("text"))).where("at IS NOT NULL")
    best = pairs.groupBy("__product").agg(F.min_by(F.struct("section_name", "kind", "at"), F.struct(~cited, "__passage")).alias("found"))
    reason = F.when(~long_enough, "too_short").when(F.col("found").isNull(), "not_found")
    joined = numbered.join(best, "__product", "left").withColumn("drop_reason", reason)
    return joined.withColumns({"evidence": F.col("found.at.verbatim"), "match": F.col("found.at.how"), "evidence_section": F.col("found.section_name"), "evidence_kind": F.col("found.kind")}).drop("found", "__product")


def deduped(products: DataFrame, by: list[str]) -> DataFrame:
    """Products of the same type, quote and description (case and white space aside) once, the most confident, at the first place."""
    key = scalars.fingerprint(F.col("product_type"), F.col("evidence"), F.lower(scalars.collapse(F.col("description"))))
    rows = products.withColumn("__same", key)
    rest = [c for c in products.columns if c not in by]
    best = rows.groupBy(*by, "__same").agg(F.max_by(F.struct(*rest), F.struct("confidence", -F.col("ordinal"))).alias("b"), F.min("ordinal").alias("place"))
    return best.select(*by, "b.*", "place")


def holding(texts: DataFrame, quotes: DataFrame, text_column: str, quote_column: str) -> DataFrame:
    """Rows of texts and quotes where the text contains the quote: a join by hashes of windows (anchors.py)."""
    return anchors.containing(texts, quotes, text_column, quote_column)
