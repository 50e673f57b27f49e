"""Stems against published pairs, the stored index against search over the products."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lacuna.functions.stems import stem, stemmed
from lacuna.operators import search, text_index

# Words and their stems as published with the rules.
PAIRS = """
consign consign  consigned consign  consigning consign  consignment consign  consist consist  consisted consist  consistency consist
consistent consist  consistently consist  consisting consist  consists consist  consolation consol  consolations consol  consolatory consolatori
console consol  consoled consol  consoles consol  consolidate consolid  consolidated consolid  consolidating consolid  consoling consol
consolingly consol  consols consol  consonant conson  consort consort  consorted consort  consorting consort  conspicuous conspicu
conspicuously conspicu  conspiracy conspiraci  conspirator conspir  conspirators conspir  conspire conspir  conspired conspir  conspiring conspir
constable constabl  constables constabl  constance constanc  constancy constanc  constant constant  knack knack  knackeries knackeri  knacks knack
knag knag  knave knave  knaves knave  knavish knavish  kneaded knead  kneading knead  knee knee  kneel kneel  kneeled kneel  kneeling kneel
kneels kneel  knees knee  knell knell  knelt knelt  knew knew  knick knick  knif knif  knife knife  knight knight  knightly knight  knights knight
knit knit  knits knit  knitted knit  knitting knit  knives knive  knob knob  knobs knob  knock knock  knocked knock  knocker knocker  knockers knocker
knocking knock  knocks knock  knopp knopp  knot knot  knots knot  generate generat  generates generat  general general  generally general
communication communic  hopping hop  hoping hope  falling fall  failing fail  happy happi  relational relat  conditional condit  rational ration
agreed agre  plastered plaster  motoring motor  sky sky  dying die  cries cri  ties tie  gas gas  this this  gaps gap  kiwis kiwi  luxuriated luxuri
hopped hop  bed bed  shed shed  shred shred  says say  by by  cry cri  feudalism feudal  decisiveness decis  hopefulness hope  callousness callous
formality formal  sensitivity sensit  sensibility sensibl  formative format  formalize formal  electricity electr  electrical electr  hopeful hope
goodness good  revival reviv  allowance allow  inference infer  adjustable adjust  defensible defens  irritant irrit  replacement replac
adjustment adjust  dependent depend  adoption adopt  activate activ  angularity angular  homologous homolog  effective effect  rate rate  cease ceas
roll roll  proceeding proceed  succeed succeed  inning inning  only onli  youth youth  boyish boyish  analogies analog  measurements measur
measured measur  measurement measur  cross cross  sections section  luminosities luminos  distributions distribut
""".split()


def test_stems_are_the_published_ones(spark):
    words, stems = PAIRS[::2], PAIRS[1::2]
    assert [stem(w) for w in words] == stems
    rows = spark.createDataFrame([(w.upper(),) for w in words], "w string").select("w", stemmed(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in rows] == stems


def test_both_forms_of_the_stems_agree(spark):
    rng = random.Random(2)
    endings = ["", "s", "ies", "ied", "ed", "ing", "ingly", "eed", "ational", "ization", "fulness", "iviti", "li", "ogi", "lessli", "ative", "ement", "sion", "tion", "e", "ell", "y", "ay", "ss", "us", "iz", "ator", "2"]
    words = ["", "y", "yy", "sky", "inning", "innings", "exceeding", "ying", "generously", *{"".join(rng.choice("abeiklnorstyz") for _ in range(rng.randrange(7))) + rng.choice(endings) for _ in range(1500)}]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stemmed(F.col("w")).alias("s")).collect()
    assert [(r["w"], r["s"]) for r in rows] == [(w, stem(w)) for w in words]
    assert spark.createDataFrame([(None,)], "w string").select(stemmed(F.col("w"))).first()[0] is None


FIELDS = {"description": 1.0, "title": 0.4}
WORDS = "limits limit measured measurement cross section sections masses mass the of likelihood likelihoods".split()


def products(rng, keys):
    text = lambda: rng.choice([None, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))])
    return [(k, text(), text()) for k in keys]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, description string, title string")


QUERIES = ["limit", '"cross sections" OR masses', "measured -mass", '"mass limits" likelihood', "nothing here", "the of"]


def test_index_gives_what_search_gives(spark, tmp_path):
    """Over runs that add, change, repeat and take away; and again in one segment."""
    rng = random.Random(4)
    index = text_index.Index(str(tmp_path / "index"), fields=FIELDS, buckets=8)
    assert text_index.search(spark, index, "limit").count() == 0
    now = products(rng, range(40))
    for run in range(3):
        assert text_index.update(frame(spark, now), index)["segment"] == run + 1
        again = text_index.compact(spark, index) if run == 2 else 0
        assert bool(again) == (run == 2)
        for q in QUERIES:
            want = search.search(frame(spark, now), q, "id", FIELDS).collect()
            got = text_index.search(spark, index, q).collect()
            assert [(r["id"], round(r["rank"], 9)) for r in got] == [(r["id"], round(r["rank"], 9)) for r in want], q
        want = {r["term"]: r["n"] for r in search.postings(frame(spark, now), "id", FIELDS).groupBy("term").agg(F.count_distinct("id").alias("n")).collect()}
        assert {r["term"]: r["n"] for r in text_index.frequencies(spark, index).collect()} == want
        kept = [row for row in now if row[0] % 7 != run and row[0] not in range(20, 26)]
        now = [*kept, *products(rng, range(20, 26)), *products(rng, range(50 + run * 5, 55 + run * 5))]


def test_a_run_writes_what_changed_and_a_query_reads_its_buckets(spark, tmp_path):
    index = text_index.Index(str(tmp_path / "index"), fields=FIELDS)
    rows = [(k, f"limit number{k}", "cross section") for k in range(300)]
    text_index.update(frame(spark, rows), index)
    rows[7] = (7, "likelihood", None)
    said = text_index.update(frame(spark, rows), index)
    assert said == {"changed": 1, "gone": 0, "segment": 2}
    assert spark.read.parquet(f"{index.folder}/postings").where("segment = 2").count() == 1
    assert text_index.update(frame(spark, rows[:10]), index, whole=False)["gone"] == 0
    found = text_index.postings(spark, index, search.terms_of("likelihood"))
    assert [tuple(r) for r in found.select("id", "positions").collect()] == [(7, [0])]
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    buckets = text_index._buckets(spark, index, ["likelihood"])
    assert re.search(rf"PartitionFilters: .*bucket#\d+ (?:IN \({buckets[0]}\)|= {buckets[0]}\b)", plan) and len(buckets) == 1
    assert spark.read.parquet(f"{index.folder}/postings").select("bucket").distinct().count() > 20
    assert {r["id"] for r in text_index.search(spark, index, "limit").collect()} == set(range(300)) - {7}


def test_a_broken_run_is_not_seen(spark, tmp_path, monkeypatch):
    index = text_index.Index(str(tmp_path / "index"), fields=FIELDS)
    text_index.update(frame(spark, [(1, "limit", None)]), index)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(text_index, "_point", broken)
        with pytest.raises(OSError):
            text_index.update(frame(spark, [(2, "limit", None)]), index)
    assert [r["id"] for r in text_index.search(spark, index, "limit").collect()] == [1]
    text_index.update(frame(spark, [(2, "limit", None), (None, "limit", "x")]), index)
    assert [r["id"] for r in text_index.search(spark, index, "limit").collect()] == [2]


def test_a_long_text_is_not_carried_by_its_words(spark):
    """One text of 40000 words: a row of a word that carries its text would make 12 GB of them. Places, stems and stop words are those of a walk."""
    words = [f"limit{i % 997}s" if i % 3 else "of" for i in range(40_000)]
    rows = frame(spark, [(1, " ".join(words), None), (2, "--Masses, mass!", "The mass"), (2, "mass", None), (3, None, "")])
    found = search.postings(rows, "id", FIELDS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Generate .*words", plan) and "MapInArrow" in plan
    got = {(r["term"], r["id"], r["field"]): r["positions"] for r in found.collect()}
    want = {}
    for i, w in enumerate(words):
        if w != "of":
            want.setdefault((stem(w), 1, "description"), []).append(i)
    want |= {("mass", 2, "description"): [0, 1, 2], ("mass", 2, "title"): [1]}
    assert got == want
    assert [tuple(r) for r in search.postings(rows, "id", FIELDS, ["mass"]).orderBy("field").collect()] == [("mass", 2, "description", 1.0, [0, 1, 2]), ("mass", 2, "title", 0.4, [1])]
    assert search.postings(rows, "id", FIELDS, []).count() == 0


def test_a_run_stages_a_row_for_each_text(spark, tmp_path, monkeypatch):
    """Not one for each posting, which were written and shuffled once more than the index needs."""
    made, plain = {}, text_index.staged

    def kept(rows, name):
        made[name] = plain(rows, name)
        return made[name]

    monkeypatch.setattr(text_index, "staged", kept)
    index = text_index.Index(str(tmp_path / "index"), fields={"description": 1.0})
    text_index.update(frame(spark, [(k, "limit mass section", None) for k in range(20)]), index)
    assert made["index-postings"].count() == 20
    text_index.update(frame(spark, [(k, "limit mass section" if k else "likelihood", None) for k in range(19)]), index)
    assert "terms" not in made["index-known"].columns
    assert {r["term"]: r["n"] for r in text_index.frequencies(spark, index).collect()} == {"limit": 18, "mass": 18, "section": 18, "likelihood": 1}
    assert [tuple(r) for r in text_index.search(spark, index, "likelihood").select("id").collect()] == [(0,)]
