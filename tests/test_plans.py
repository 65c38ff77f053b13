"""The plans that put operators together: translating with retries and own terms, repairing, checking from outside."""

import json

from pyspark.sql import functions as F

from lexmill.operators import checks, compare, geometry, terms
from lexmill.plans import qc, translate
from lexmill.sources.segments import encoded_runs

SEGMENT = "doc_id long, pos int, seg_id string, container int, kind string, source string, target string"
GLOSSARY = "source_term string, target_term string, source_lang string, target_lang string, do_not_translate boolean, priority string, context string, term_seq int"


def pairs(spark, sources, glossary=()):
    rows = [(1, i, f"s{i}", 1, "body", s, None) for i, s in enumerate(sources)]
    held = spark.createDataFrame([(a, b, "en", "de", False, "normal", "", i) for i, (a, b) in enumerate(glossary)], GLOSSARY) if glossary else None
    return qc.pairs_of(spark.createDataFrame(rows, SEGMENT), held, "en", "de")


def engine_of(answers):
    """Answers by text; where the text has none, by text and what the attempt is told."""

    def engine(rows):
        told = F.lit("")
        for c in ("feedback", "bare"):
            if c in rows.columns:
                told = F.concat(F.lit(f"|{c}"), told)
        key = F.concat("text", told)
        known = F.create_map(*[F.lit(x) for kv in answers.items() for x in kv])
        return rows.select("seg_id", F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.col("text")), F.lit("")).alias("output"))

    return engine


def test_ladder_of_attempts(spark):
    answers = {
        "Open the valve": "Klappe öffnen", "Open the Ventil": "Ventil öffnen",  # the term put in
        "Tank 4711 is full": "Tank ist voll", "Tank 4711 is full|feedback": "Der Tank 4711 ist voll",  # told what is wrong
        "Pump 815 runs": "Pumpe", "Pump 815 runs|bare": "Pumpe 815 läuft",  # without context
        "<g1>Start</g1> now": "Jetzt Start", "Start now": "Jetzt Start",  # tags put back, or not
        "<g1>Stop</g1> now": "Jetzt anhalten", "Stop now": "Jetzt anhalten",
        "Same again": "Same again", "No tags": "<g9>Keine Marken</g9>",
    }
    sources = ["Open the valve", "Tank 4711 is full", "Pump 815 runs", "<g1>Start</g1> now", "<g1>Stop</g1> now", "Same again", "No tags", "12"]
    done = translate.translated(pairs(spark, sources, [("valve", "Ventil"), ("Start", "Start")]), engine_of(answers), "en", "de")
    got = {r.seg_id: (r.status, r.target, r.score) for r in done.collect()}
    assert got == {
        "s0": ("retried", "Ventil öffnen", 0), "s1": ("retried", "Der Tank 4711 ist voll", 0), "s2": ("retried", "Pumpe 815 läuft", 0),
        "s3": ("retagged", "Jetzt <g1>Start</g1>", 0), "s4": ("simplified", "Jetzt anhalten", 5),
        "s5": ("failed", None, 110), "s6": ("translated", "Keine Marken", 0), "s7": ("kept", "12", 0),
    }
    better = translate.repaired(done, engine_of({"Same again": "Noch einmal", "Stop now": "Halt", "<g1>Stop</g1> now": "Halt"}), "en", "de")
    fixed = {r.seg_id: (r.status, r.target) for r in better.collect()}
    assert fixed["s5"] == ("repaired", "Noch einmal") and fixed["s4"] == ("simplified", "Jetzt anhalten")
    assert {k: v[:2] for k, v in got.items() if k not in ("s5",)} == {k: v for k, v in fixed.items() if k != "s5"}
    assert {r.source_text for r in translate.to_remember(done, "en", "de").collect()} == {"Open the valve", "Tank 4711 is full", "Pump 815 runs", "<g1>Start</g1> now", "No tags"}


def test_identifiers_behind_placeholders(spark):
    ps = pairs(spark, ["Ask ops@lager.example.org about 172.20.4.9", "See 172.20.4.9"])
    engine = engine_of({"Ask <x1/> about <x2/>": "Wegen <x2/> bitte <x1/> fragen", "See <x1/>": "<x1/> und <x1/>"})
    got = {r.seg_id: (r.target, [p.code for p in r.problems]) for r in translate.translated(ps, engine, "en", "de", mask=True).collect()}
    assert got["s0"] == ("Wegen 172.20.4.9 bitte ops@lager.example.org fragen", [])
    assert got["s1"] == ("172.20.4.9 und 172.20.4.9", ["placeholders"])


def test_terms_of_a_document(spark):
    sources = ["The feed water pump runs", "A feed water pump stops", "Oil the feed water pump"]
    ps = pairs(spark, sources)
    found = terms.mined_english(ps)
    engine = engine_of({"feed water pump": "「Speisepumpe」", sources[0]: "Die Speisepumpe läuft", sources[1]: "Eine Speisepumpe hält", sources[2]: "Die Pumpe ölen", "Oil the Speisepumpe": "Die Speisepumpe ölen"})
    done, own = translate.translated_with_terms(ps, found, engine, "en", "de")
    assert [(r.phrase, r.occurrences, r.candidates, r.target) for r in own.collect()] == [("feed water pump", 3, ["Speisepumpe"], "Speisepumpe")]
    assert {r.target for r in done.collect()} == {"Die Speisepumpe läuft", "Eine Speisepumpe hält", "Die Speisepumpe ölen"}
    assert terms.resolved(own).count() == 1
    hinted = terms.with_document_hints(pairs(spark, ["A feed water pump", "Feed water pumps", "A valve"], [("water", "Wasser")]), own)
    assert [[(h.source, h.target) for h in r.hints] for r in hinted.orderBy("pos").collect()] == [[("water", "Wasser"), ("feed water pump", "Speisepumpe")], [("water", "Wasser"), ("feed water pump", "Speisepumpe")], []]
    rows = spark.createDataFrame([(1, "a", "A", ["A"], 3), (1, "b", "", ["B", "C"], 2), (1, "c", None, [], 2)], "doc_id long, phrase string, target string, candidates array<string>, occurrences int")
    told = {r.source_term: (r.target_term, r.notes) for r in terms.review_rows(rows).collect()}
    assert told == {"a": ("A", "3 paragraphs; review before importing"), "b": ("B", "UNRESOLVED (2 paragraphs, translated inconsistently); candidates: B / C — correct the target before importing")}
    cut = spark.createDataFrame([("the pump of QX-9004",)], "t string").select(terms.masked(F.col("t"), F.array(F.struct(F.lit("pump").alias("source")))).alias("m")).first().m
    assert cut == "the  |  of  | "


def test_check_of_other_documents(spark):
    rows = [(1, i, f"s{i}", 1, "body", s, None) for i, s in enumerate(["The pump runs.", "Tank 4711", "Old text here"])]
    original = spark.createDataFrame(rows, SEGMENT).drop("target")
    other = original.withColumn("source", F.element_at(F.array(F.lit("Die Pumpe läuft."), F.lit("Tank 4712"), F.lit("Old text here")), F.col("pos") + 1))
    notes = spark.createDataFrame([(1, "slide 3: text in a picture"), (1, "a chart")], "doc_id long, note string")
    shapes = original.withColumns({"shape_key": F.lit("b1"), "formatting_simplified": F.lit(True), "target": F.lit("x")})
    issues = spark.createDataFrame([(1, "overflow", "info", "b1", "slide 2 is full"), (1, "missing_glyphs", "warning", "s1", "none")], "doc_id long, code string, severity string, ref string, message string")
    got = qc.check_documents(original, other, None, "en", "de", notes=notes, issues=issues, segments=shapes, reread=other.select("seg_id", F.col("source").alias("text")).where("seg_id <> 's0'"))
    found = sorted((r.code, r.severity, tuple(r.segments), tuple(r.pages)) for r in got.collect())
    assert found == [
        ("formatting_simplified", "info", ("s0", "s1", "s2"), (1,)), ("missing_glyphs", "warning", ("s1",), ()), ("not_translatable", "info", (), ()), ("not_translated", "error", ("s2",), (1,)),
        ("not_written", "error", ("s0",), (1,)), ("number_changed", "warning", ("s1",), (1,)), ("overflow", "warning", ("s0", "s1", "s2"), (2,)), ("picture_text", "warning", (), (3,)),
    ]
    box = lambda df: df.withColumns({"page": F.lit(1), "id": F.col("seg_id"), "seq": F.col("pos"), "x0": F.lit(0.0), "x1": F.lit(9.0), "y0": F.col("pos") * 20.0, "y1": F.col("pos") * 20.0 + 10})
    placed = qc.check_documents(box(original), box(other).withColumn("text", F.col("source")), None, "en", "de", boxes=True)
    assert sorted((r.code, *r.segments) for r in placed.collect()) == [("not_translated", "s2"), ("number_changed", "s1")]
    alone = qc.check_edits(original, other.select("seg_id", F.col("source").alias("target")).where("seg_id = 's1'"), None, "en", "de").collect()
    assert [(r.code, json.loads(r.detail)) for r in alone] == [("number_changed", {"missing": ["4711"], "new": ["4712"]})]
    seen = qc.inspected(original).first()
    assert (seen.language, seen.target, seen.n_segments, seen.n_pages) == ("en", "ja", 3, 1)


def test_small_rules(spark):
    runs = [(1, 0, "a", "Press "), (1, 1, "b", "Start"), (1, 2, "b", " now"), (1, 3, "a", ", wait, "), (1, 4, "c", " "), (1, 5, "c", "x"), (2, 0, None, "plain"), (3, 0, "q", ""), (1, 6, "a", "and hold on")]
    got = {r.para: r.source for r in encoded_runs(spark.createDataFrame(runs, "para long, seq int, style string, text string")).collect()}
    assert got == {1: "Press <g1>Start now</g1>, wait,  <g2>x</g2>and hold on", 2: "plain", 3: ""}
    models = spark.createDataFrame([("m", True, ["en", "de"]), ("n", True, ["en", "de", "ja"]), ("o", False, ["en", "de"]), ("p", True, ["en"])], "model string, installed boolean, languages array<string>")
    assert {r.model: r.reason for r in compare.usable_models(models, "m", "en", "de").collect()} == {"m": "repair model is the same as the main model", "n": None, "o": "o is not installed", "p": "p is not used for this language pair"}
    styles = spark.createDataFrame([(1, 0, None, True), (1, 1, 20, None), (1, 2, 30, False), (2, 0, None, None)], "shape int, distance int, size int, bold boolean")
    assert {r.shape: (r["size"], r.bold) for r in geometry.nearest_style(styles, ["shape"], ["size", "bold"], {"size": 18}).collect()} == {1: (20, True), 2: (18, None)}
    row = spark.range(1).select(geometry.page_shown(F.lit(0), F.lit(5)).alias("a"), geometry.page_shown(F.lit(9), F.lit(5)).alias("b"), geometry.highlight(*[F.lit(float(v)) for v in (10, 20, 60, 40, 100, 200)]).alias("h")).first()
    assert (row.a, row.b, tuple(row.h)) == (1, 5, (0.1, 0.1, 0.5, 0.1))
    assert checks.LAYOUT["overflow"] == "warning"
