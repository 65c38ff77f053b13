"""Translations from memory are checked once, and clean-up of rare characters leaves other texts alone."""

from pyspark.sql import functions as F

from lexmill.functions.text import tidy
from lexmill.plans import translate

ROW = "seg_id string, source string, plain string, protected array<string>, hints array<struct<source:string,target:string,keep:boolean,origin:string>>, __memory string"


def test_problems_of_memory_are_looked_for_once(spark):
    rows = [("a", "one 24 line", "one 24 line", [], [], "eine 24 Zeile"), ("b", "one 24 line", "one 24 line", [], [], "eine Zeile"), ("c", "x", "x", [], [], None)]
    found = translate._known(spark.createDataFrame(rows, ROW), "en", "de")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()  # they are read, not told again for the condition
    assert [(r.seg_id, r.output, r.status, r.score) for r in found.collect()] == [("a", "Eine 24 Zeile", "memory", 0)]


def test_wide_characters(spark):
    texts = {"a（b）～c〜d，e；f：g！　h  i": "A(b)–c–d, e; f: g! h i", "two  blanks": "Two blanks", "豈 Ａ": "豈 A", "豈 x": "豈 x", "": "", None: None}
    df = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, w string").select("w", tidy(F.lit("source"), F.col("t"), "de").alias("got"))
    for r in df.collect():
        assert r.got == r.w
