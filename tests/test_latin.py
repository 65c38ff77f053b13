"""What is measured in one pass over Latin texts, against the patterns; and what the passes over pairs cost."""

import itertools

import pytest
from pyspark.sql import functions as F

from lexmill import queries
from lexmill.functions import latin, text
from lexmill.operators import checks
from lexmill.sources import segments

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", " ", "\xa0", "\x1c", "the and", "The  pump runs. It is OFF!", "the pump runs. it is off!", "THE PUMP RUNS. IT IS OFF!", "a\x1cb", "a b", "A B", "Straße", "STRASSE",
    "Ein Satz für", "Ein Satz FÜR", "²für", "_für", "xfür", "für", "1für", "deſ", "Ende.)", "Ende.\xa0)", ".)\xa0", ". ", "Ende.\x85", "Ende.\n", "One. Two. Three and a long way to go, with the pump", "One two three and",
    ")" * 70, "." + ")" * 70, "." + ")" * 70 + "\xa0", "ªµº×÷ÿ²¼ text of letters", "– “quoted” … 24 °C €", "Ω the and", "ΑΣ the", "İ the and", "東京 the and", "𝔸 and the", "ﬁ", "A.B. C? D!E? ", "Set AHU-1 to AHU-12 of the", "with the AHU-1. And the BMS", "é the and", None,
]


@pytest.fixture
def written(monkeypatch):
    held = {}
    keep = checks.materialize
    monkeypatch.setattr(checks, "materialize", lambda df, name, *a, **k: keep(held.setdefault(name, df), name, *a, **k))
    return held


def odd_pairs(spark):
    hints = [[], [("BMS", "BMS", True, "glossary")], [("the", "the", False, "glossary"), ("pump", "Pumpe", False, "glossary")]]
    rows = [(i, "0", f"{i}/{i}", 1, a, a, b, ["AHU-1", "", "AHU-12"] if i % 3 else [], hints[i % 4 % 3], False) for i, (a, b) in enumerate(itertools.product(TEXTS, TEXTS))]
    return spark.createDataFrame(rows, "doc_id long, pos string, seg_id string, container int, source string, plain string, target string, protected array<string>, hints array<struct<source:string,target:string,keep:boolean,origin:string>>, kept boolean").repartition(4)


@pytest.mark.parametrize("tgt", ["de", "fr"])
def test_latin_equals_the_patterns(spark, written, monkeypatch, tgt):
    pairs = odd_pairs(spark).localCheckpoint()
    got = sorted(map(str, checks.completeness(pairs, "en", tgt).collect()))
    measured = pairs.select(latin.measures((), checks.CLOSING, frozenset(), 1)(*map(F.col, ("plain", "target", "protected")), F.lit(None).cast("string")).alias("m"))
    n = measured.where("m is not null").count()
    assert 0.4 * len(TEXTS) ** 2 < n < len(TEXTS) ** 2  # both ways are taken
    none = latin.measures((), "", frozenset(), 1)
    monkeypatch.setattr(checks.latin, "measures", lambda *a: lambda *c: F.when(F.lit(False), none(*c)))
    written.clear()
    assert sorted(map(str, checks.completeness(pairs, "en", tgt).collect())) == got


def test_texts_that_read_alike_have_one_hash(spark):
    more = [f"{a}{b}" for a in ("Straße", "ΑΣ", "İ", "K", "ẞ a", "a\tb") for b in ("", ".", " 。", "!\xa0", "\x1c")] + ["STRASSE", "ας", "k", "ss A", "a  B"]
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, *more]], "t string").select(text.repeat_key(F.col("t"), True).alias("key"), latin.repeat_hash(F.col("t")).alias("h"))
    each = rows.where("key is not null").groupBy("key").agg(F.count_distinct("h").alias("n"))
    assert {r.n for r in each.collect()} == {1}
    assert rows.select("h").distinct().count() > len(TEXTS) // 2


def test_making_pairs_sorts_them_once(spark):
    plan = queries.full_pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Sort [") == 1


def test_lines_of_a_page_follow_each_other(spark):
    rows = queries.lines(spark, SF)
    a = segments.mutated(rows).select("seg_id", "mutation", "target").collect()
    b = segments.mutated(rows.drop("container")).select("seg_id", "mutation", "target").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_sources_that_repeat_are_found_by_hash(spark, written):
    rows = [(1, i, f"1/{i}", i // 2, s, t, False) for i, (s, t) in enumerate([("The pump.", "Pumpe"), ("the  PUMP", "Die Pumpe"), ("once", "eins"), ("12", "a"), ("12", "b"), ("twice", "zwei"), ("twice", "zwei!")])]
    pairs = spark.createDataFrame(rows, "doc_id long, pos int, seg_id string, container int, plain string, target string, kept boolean")
    found = checks.same_source_differs(pairs, "de").collect()
    assert [r.segments for r in found] == [["1/0", "1/1"]]
    assert written["repeated"].columns == ["doc_id", "repeat_hash"] and written["repeated"].count() == 2
