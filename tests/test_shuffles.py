"""What the checks, mining and encoding of runs write and shuffle."""

import pytest
from pyspark.sql import functions as F

from lexmill import queries
from lexmill.functions import tokens
from lexmill.operators import checks, glossary, terms
from lexmill.sources import segments

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning")


@pytest.fixture
def written(monkeypatch):
    held = {}
    for module in (checks, terms):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, keep=keep: keep(held.setdefault(name, df), name))
    return held


def test_completeness_writes_no_texts(spark, written):
    found = checks.completeness(queries.full_pairs(spark, SF), "en", "de")
    assert not {"source", "plain", "target", "hints"} & set(written["qc-completeness"].columns)
    assert {"not_translated", "added_text", "possible_omission"} <= {r.code for r in found.collect()}


def test_mining_shuffles_segments_once(spark, written):
    assert terms.mined_english(queries.lines(spark, SF)).count()
    assert exchanges(written["phrases"]) == 1


def test_runs_are_shuffled_once_and_styles_may_be_null(spark):
    rows = [("p", 1, None, "ab "), ("p", 2, "b", "long one"), ("p", 3, None, "c"), ("p", 4, "i", " "), ("p", 5, "i", "d"), ("q", 1, "a", None), ("q", 2, "b", "x")]
    out = segments.encoded_runs(spark.createDataFrame(rows, "para string, seq int, style string, text string"))
    assert exchanges(out) == 1
    assert {r.para: r.source for r in out.collect()} == {"p": "<g1>ab </g1>long one<g1>c</g1> <g2>d</g2>", "q": "x"}


def test_keywords_around(spark):
    rows = spark.createDataFrame([("a thing", "of the BMS"), ("a thing", "else")], "plain string, around string")
    term = [("thing", "Ding", "en", "de", False, "normal", "bms, ahu", 0)]
    held = spark.createDataFrame(term, "source_term string, target_term string, source_lang string, target_lang string, do_not_translate boolean, priority string, context string, term_seq int")
    out = glossary.with_hints(rows, held, "en", "de", around="around")
    assert sorted((r.around, len(r.hints)) for r in out.select("around", F.col("hints")).collect()) == [("else", 0), ("of the BMS", 1)]


def test_pairs_are_shuffled_once(spark):
    """By document, and as their sources only; all that is told of a page or document comes after."""
    out = queries.full_pairs(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert exchanges(out) == 1 and "Join" not in plan


def test_keywords_on_the_page(spark):
    rows = spark.createDataFrame([(1, 1, 0, "a thing"), (1, 1, 1, "of the BMS"), (1, 2, 2, "a Thing"), (2, 1, 0, "BMS thıng"), (2, 1, 1, None)], "doc_id long, container int, pos int, plain string")
    term = [("thing", "Ding", "en", "de", False, "normal", "bms, ahu", 0), ("of", "von", "en", "de", False, "normal", "", 1)]
    held = spark.createDataFrame(term, "source_term string, target_term string, source_lang string, target_lang string, do_not_translate boolean, priority string, context string, term_seq int")
    more = [(f"word{i}", "x", "en", "de", False, "normal", f"key{i}", 2 + i) for i in range(glossary.KEYWORDS)]
    want = [(1, 0, ["thing"]), (1, 1, ["of"]), (1, 2, []), (2, 0, ["thing"]), (2, 1, [])]
    for terms_ in (held, held.unionByName(spark.createDataFrame(more, held.schema))):  # looked for in Spark, and not
        out = glossary.with_hints(rows, terms_, "en", "de", page=["doc_id", "container"])
        assert sorted((r.doc_id, r.pos, [h.source for h in r.hints]) for r in out.select("doc_id", "pos", "hints").collect()) == want


def test_identifiers_by_what_they_need(spark):
    texts = ["x.co", "1.2.3.4:5", "see C:\\a\\b c", "AHU-1 a.b", "AHU-\u0661", "v1.2", "a@b.de", "xhttps://y", "end. Next", "12:30", "A-B", "v\u0661.\u0662", "-", "", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.opaque_tokens(F.col("t")).alias("got"), F.transform(F.regexp_extract_all("t", F.lit(tokens.OPAQUE), F.lit(0)), tokens.trimmed).alias("want"))
    assert all(r.got == (r.want or []) for r in out.collect())
