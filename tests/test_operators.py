"""Golden cases of the operators on small tables."""

import json

from pyspark.sql import functions as F

from lexmill.operators import checks, compare, context, evaluate, findings, geometry, glossary, memory, report, stored, terms, validate
from lexmill.plans import qc, translate
from lexmill.sources import tables
from lexmill.streaming.checks import validated

TERM = "source_term string, target_term string, source_lang string, target_lang string, do_not_translate boolean, priority string, context string, term_seq int"


def glossary_of(spark, *rows):
    return spark.createDataFrame([(s, t, "en", "ja", keep, p, c, i) for i, (s, t, keep, p, c) in enumerate(rows)], TERM)


def pairs(spark, rows, terms_=None, src="en", tgt="ja"):
    data = [(1, i, f"s{i}", 1, "body", s, t) for i, (s, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, pos int, seg_id string, container int, kind string, source string, target string")
    return qc.pairs_of(df, terms_, src, tgt)


def hints(spark, text, terms_, src, tgt, around="", **more):
    df = spark.createDataFrame([(text, around)], "plain string, around string")
    return [(h.source, h.target) for h in glossary.with_hints(df, terms_, src, tgt, "plain", "around", **more).first().hints]


def test_glossary_matching(spark):
    g = glossary_of(spark, ("Building Management System", "ビル管理システム", False, "normal", ""), ("BACnet", "", True, "normal", ""))
    ctx = glossary_of(spark, ("alarm", "警報", False, "normal", ""), ("alarm", "アラーム", False, "normal", "screen, display"))
    prio = glossary_of(spark, ("chiller", "チラー", False, "low", ""), ("chiller", "冷凍機", False, "high", ""))
    for more in ({}, {"shard_bytes": 8}):
        assert hints(spark, "ビル管理システムはBACnetを使用", g, "ja", "en", **more) == [("ビル管理システム", "Building Management System"), ("BACnet", "BACnet")]
        assert len(hints(spark, "The building management systems use BACnet.", g, "en", "ja", **more)) == 2
        assert hints(spark, "Alarm list", ctx, "en", "ja", **more) == [("alarm", "警報")]
        assert hints(spark, "Alarm list", ctx, "en", "ja", "Operator screen layout", **more) == [("alarm", "アラーム")]
        assert hints(spark, "the chillers", prio, "en", "ja", **more) == [("chiller", "冷凍機")]


def test_glossary_injection_and_csv(spark, tmp_path):
    g = glossary_of(spark, ("Air Handling Unit", "空調機", False, "normal", ""))
    df = glossary.with_hints(spark.createDataFrame([("<g1>Air Handling Unit</g1> (AHU) control",)], "plain string"), g, "en", "ja")
    assert df.select(glossary.injected().alias("x")).first().x == "<g1>空調機</g1> (AHU) control"
    path = tmp_path / "g.csv"
    path.write_text('﻿source_term,target_term,source_lang,target_lang,category,notes,do_not_translate,priority,context\n alarm ,"警報, a",en,ja,x,,Yes,HIGH,\n ,y,en,ja,,,,,\nb,c,en,ja,,,,,\n', encoding="utf-8")
    rows = tables.read_glossary(spark, str(path)).orderBy("source_term").collect()
    assert [(r.source_term, r.target_term, r.do_not_translate, r.priority) for r in rows] == [("alarm", "警報, a", True, "high"), ("b", "c", False, "normal")]
    tables.write_glossary(tables.read_glossary(spark, str(path)), str(tmp_path / "out"))
    again = tables.read_glossary(spark, str(tmp_path / "out")).orderBy("source_term").collect()
    assert again == rows


def problem_codes(spark, source, output, src, tgt, tokens=(), required=None):
    arr = F.array(*[F.lit(t) for t in tokens]).cast("array<string>")
    need = None if required is None else F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in required])
    found = validate.problems(F.lit(source), F.lit(output), arr, src, tgt, need)
    return [p.code for p in spark.range(1).select(found.alias("p")).first().p]


def test_validation(spark):
    assert problem_codes(spark, "Open <g1>valve</g1> at 172.20.4.9", "<g1>Klappe</g1> öffnen", "en", "de", ["172.20.4.9"], [("valve", "Ventil")]) == ["token_missing", "number_mismatch", "term_missing"]
    assert problem_codes(spark, "Pump", "Pump ", "en", "de") == ["untranslated"]
    assert problem_codes(spark, "給水", "Pump 弁", "ja", "en")[-1] == "untranslated"
    assert "foreign_script" in problem_codes(spark, "The pumps run", "насосы 給水", "en", "ja")
    assert problem_codes(spark, "<g2>Pump</g2> and tank", "<g2>Pumpe</g2> und <g2>Tank</g2>", "en", "de") == ["tags"]
    assert problem_codes(spark, "b", "\n ", "en", "de") == ["empty"]
    assert "added_text" in problem_codes(spark, "Pump", "Pumpe\nTank", "en", "de")
    assert "parentheses_lost" in problem_codes(spark, "Pump (FWP)", "Pumpe FWP", "en", "de", ["FWP"])
    attempts = spark.createDataFrame([("s", 1, 10), ("s", 2, 1), ("s", 3, 1)], "seg_id string, attempt int, score int")
    assert validate.best_attempts(attempts).first().attempt == 2
    one = lambda *codes: F.array(*[F.struct(F.lit(c).alias("code"), F.lit(1).alias("count")) for c in codes])
    row = spark.range(1).select(validate.outcome_score(one("untranslated", "length_suspicious"), F.lit(False)).alias("a"), validate.outcome_score(one("tags"), F.lit(True)).alias("b")).first()
    assert (row.a, row.b) == (111, 15)


def codes(df):
    return sorted((r.code, r.segments[0]) for r in df.collect())


def test_checks_find_what_was_done_and_nothing_else(spark):
    clean = pairs(spark, [("The pump moves water.", "ポンプが水を送ります。"), ("Hold 31 °C in QX-9004.", "QX-9004を31 °Cに保ちます。"), ("UDP", "UDP")])
    assert codes(qc.check(clean, "en", "ja")) == []
    bad = pairs(spark, [("The same text again", "The same text again"), ("Small valves open before large pumps start", "小さい valves は large ポンプの前に開く"), ("The tank of the plant is full.", "工場のタンクは、"), ("Gone", None)])
    found = checks.completeness(bad, "en", "ja")
    assert codes(found) == [("not_translated", "s0"), ("not_translated", "s3"), ("partly_translated", "s1"), ("possible_omission", "s2")]
    left = [json.loads(r.detail)["left"] for r in found.where("code = 'partly_translated'").collect()]
    assert left == [["valves", "large"]]
    ids = pairs(spark, [("Ask 172.20.4.90 first", "まず 172.20.4.9 に聞く"), ("Between 8 kPa and 9 kPa", "8 kPaと9 barの間"), ("It lifts 2,750 kg", "2,570 kgを上げる"), ("Look it up", "https://wiki.example.org/a で調べる")])
    found = checks.identifiers(ids)
    assert codes(found) == [("number_changed", "s1"), ("number_changed", "s2"), ("token_added", "s3"), ("token_changed", "s0")]
    assert json.loads(found.where("code = 'token_changed'").first().detail) == {"from": "172.20.4.90", "to": "172.20.4.9"}
    assert json.loads(found.where("code = 'number_changed' and segments[0] = 's2'").first().detail) == {"missing": ["2750"], "new": ["2570"]}


def test_terminology(spark):
    g = glossary_of(spark, ("chiller", "冷凍機", False, "normal", ""))
    ps = pairs(spark, [("The chiller runs", "チラーが動く"), ("A chiller stops", "冷凍機が止まる"), ("Alarm list", "警報一覧"), ("Alarm list.", "アラーム一覧")], g)
    used = checks.glossary_terms(ps, "ja").collect()
    assert [(r.message, r.segments) for r in used] == [("approved glossary term not used in 1 of 2 paragraph(s)", ["s0"])]
    differs = checks.same_source_differs(ps, "ja").collect()
    assert [r.segments for r in differs] == [["s2", "s3"]]
    assert json.loads(differs[0].detail) == {"source": "Alarm list", "variants": {"警報一覧": ["s2"], "アラーム一覧": ["s3"]}}
    candidates = spark.createDataFrame([(1, "trend log", "トレンドログ"), (1, "trend log", "傾向ログ")], "doc_id long, phrase string, candidate string")
    logs = pairs(spark, [("trend log a", "トレンドログA"), ("trend log b", "トレンドログB"), ("trend log c", "傾向ログC")])
    uses = logs.select("doc_id", F.lit("trend log").alias("phrase"), "seg_id", "target")
    vote = terms.voted(candidates, uses, "ja")
    assert [(r.winner, r.support, r.n) for r in vote.collect()] == [("トレンドログ", 2, 3)]
    told = checks.term_variants(logs, candidates, uses, vote, "ja").collect()
    assert [(r.severity, r.segments) for r in told] == [("warning", ["s2"])]
    assert json.loads(told[0].detail)["variants"] == {"トレンドログ": ["s0", "s1"], "傾向ログ": ["s2"]}
    even = uses.where("seg_id <> 's1'")
    assert terms.voted(candidates, even, "ja").first().winner is None


def test_mining(spark):
    rows = ["Every feed water pump starts slowly.", "One feed water pump may stop; a feed water line leaks.", "Oil the feed water pump, please", "Other words"]
    df = spark.createDataFrame([(1, f"s{i}", t) for i, t in enumerate(rows)], "doc_id long, seg_id string, source string")
    found = terms.mined_english(df)
    assert {(r.phrase, r.n) for r in found.select("phrase", "n").distinct().collect()} == {("feed water", 3), ("feed water pump", 3), ("water pump", 3)}
    assert {(r.phrase, r.occurrences) for r in terms.top_terms(terms.maximal(found)).collect()} == {("feed water pump", 3)}
    ja = spark.createDataFrame([(1, f"s{i}", t) for i, t in enumerate(["給水ポンプを始動", "給水ポンプ用の弁", "夜の給水ポンプ"])], "doc_id long, seg_id string, source string")
    assert "給水ポンプ" in {r.phrase for r in terms.occurrences(ja, terms.japanese_phrases(F.col("source"))).collect()}


def test_memory(spark):
    schema = "source_lang string, target_lang string, source_text string, target_text string, origin string, created_at long"
    rows = [("en", "ja", "The alarm function is enabled.", "m", "model", 5), ("en", "ja", "The alarm function is enabled.", "h", "human", 1), ("en", "ja", "The alarm function is disabled.", "d", "model", 2), ("en", "ja", "Nothing like it at all, really.", "n", "model", 3)]
    mem = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(1, "en", "ja", "The alarm function is enabled."), (2, "en", "ja", "unknown")], "lookup_id long, source_lang string, target_lang string, source_text string")
    exact = {r.lookup_id: r.target_text for r in memory.exact(asked, mem).collect()}
    assert exact == {1: "h", 2: None}
    near = memory.similar(asked, mem).collect()
    assert [(r.lookup_id, r.target) for r in near] == [(1, "d")] and 80 <= near[0].score < 100
    kept = memory.stored(mem, spark.createDataFrame([("en", "ja", "The alarm function is enabled.", "new", "model", 9)], schema))
    assert kept.count() == 4 and kept.where("target_text = 'new'").count() == 1


def test_stored_glossary(spark):
    schema = "id int, glossary_id int, source_term string, source_lang string, target_lang string, context string, target_term string"
    df = spark.createDataFrame([(1, 1, "a", "en", "ja", "", "x")], schema)
    new = spark.createDataFrame([(1, "a", "en", "ja", "", "y", 1), (1, "b", "en", "ja", "", "z", 2)], schema.replace("id int, ", "", 1) + ", seq int")
    assert sorted((r.id, r.source_term, r.target_term) for r in glossary.upserted(df, new).collect()) == [(1, "a", "y"), (2, "b", "z")]
    try:
        glossary.updated(df, 1, nothing="x")
        raise AssertionError
    except ValueError as e:
        assert "nothing" in str(e)


def test_stored_tables(spark):
    names = spark.createDataFrame([(3, "a")], "id int, name string")
    assert sorted(tuple(r) for r in stored.ensured(stored.ensured(names, "a"), "b").collect()) == [(3, "a"), (4, "b")]
    assert [tuple(r) for r in stored.ensured(names.limit(0), "z").collect()] == [(1, "z")]
    jobs = spark.createDataFrame([(7, "done", 0)], "id int, status string, warnings int")
    got = stored.recorded(jobs, spark.createDataFrame([(1, "failed", ["x", "y"])], "seq int, status string, issues array<string>"))
    assert sorted(tuple(r) for r in got.collect()) == [(7, "done", 0), (8, "failed", 2)]
    assert stored.cleared(jobs)[0] == 1 and stored.cleared(jobs)[1].isEmpty()
    sheet = spark.createDataFrame([(1, "chiller", "冷凍機", ""), (1, "VAV", "VAV", None), (1, "alarm", "", "UNRESOLVED: a / b")], "doc_id long, source_term string, target_term string, notes string")
    texts = ["The chillers run", "A Chiller stops, an alarm", "vav box, alarm", "VAV-2 here", "prechiller"]
    segments = spark.createDataFrame([(1, f"s{i}", t) for i, t in enumerate(texts)], "doc_id long, seg_id string, plain string")
    assert [(r.source_term, r.occurrences) for r in stored.restored_sheet(sheet, segments).collect()] == [("chiller", 2)]
    rows = spark.createDataFrame([(1, "a", "Old text", "new"), (1, "b", "Kept", "K ept"), (1, "c", "Gone", "weg")], "doc_id long, seg_id string, source string, target string")
    drawn = spark.createDataFrame([(1, "Old  text"), (1, "Kept")], "doc_id long, text string")
    assert [r.seg_id for r in stored.still_drawn(rows, drawn).collect()] == ["a"]


def test_geometry(spark):
    box = "page long, id string, seq int, text string, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, "a", 0, "", 0.0, 0.0, 100.0, 50.0), (1, "b", 1, "", 0.0, 40.0, 100.0, 90.0), (2, "c", 0, "", 0.0, 0.0, 500.0, 500.0)], box)
    b = spark.createDataFrame([(1, "x", 0, "two", 0.0, 25.0, 100.0, 50.0), (1, "y", 1, "one", 0.0, 0.0, 100.0, 20.0), (1, "z", 2, "three", 0.0, 60.0, 100.0, 80.0), (2, "w", 0, "far", 450.0, 450.0, 480.0, 480.0)], box)
    assert {r.seg_id: r.translation for r in geometry.paired(a, b).collect()} == {"a": "one\ntwo", "b": "three", "c": "far"}
    assert geometry.outside_tables(b, a.where("page = 2")).count() == 3
    lines = spark.createDataFrame([(1, "Feed", 0.0, 0.0, 40.0, 10.0, 0.9), (1, "(FWP)", 43.0, 1.0, 70.0, 11.0, 0.8), (1, "other cell", 200.0, 0.0, 250.0, 10.0, 0.9), (1, "pumps", 0.0, 12.0, 50.0, 22.0, 0.9), (1, "• tank", 0.0, 24.0, 50.0, 34.0, 0.9)], geometry.FRAGMENT)
    merged = {r.text: (r.x0, r.y0, r.x1, r.y1, r.score) for r in geometry.merged_fragments(lines).collect()}
    assert set(merged) == {"Feed (FWP)", "other cell", "pumps", "• tank"} and merged["Feed (FWP)"] == (0.0, 0.0, 70.0, 11.0, 0.8)
    para = {r.text: r.para for r in geometry.paragraphs(lines).collect()}
    assert para["Feed"] == para["pumps"] != para["• tank"]


def test_context_and_compare(spark):
    rows = [(1, i, f"s{i}", 1, k, t) for i, (k, t) in enumerate([("body", "early"), ("title", "T"), ("body", "b"), ("note", "n")])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, seg_id string, container int, kind string, source string")
    assert [r.heading for r in context.with_heading(df).orderBy("pos").collect()] == [None, None, "T", None]
    assert context.note_context(df).first().context == "Heading: T\nearly\nb"
    assert context.note_context(df, most=12).first().context == "Heading: T"
    got = compare.paired_by_id(df, df.where("pos > 0")).orderBy("pos").collect()
    assert [r.target for r in got] == [None, "T", "b", "n"]
    assert compare.page_counts(df, df.withColumn("container", F.lit(2))).first().error.startswith("The files have")
    fonts = spark.createDataFrame([(1, ["A", "B"])], "page int, fonts array<string>")
    assert compare.new_fonts(spark.createDataFrame([(1, ["A"])], fonts.schema), fonts).first().fonts == ["B"]


def test_findings_and_reports(spark):
    rows = [(1, "layout", "overflow", "info", "m", ["s1"], [3], None), (1, "identifiers", "token_missing", "error", "m", ["s1", "s2"], [2], '{"missing":"BMS"}'), (1, "completeness", "picture_text", "warning", "m", [], [], None)]
    df = spark.createDataFrame(rows, findings.SCHEMA)
    assert [r.code for r in findings.ordered(df).collect()] == ["token_missing", "picture_text", "overflow"]
    assert {r.category: (r.errors, r.warnings, r["info"]) for r in findings.summary(df).collect()} == {"terminology": (0, 0, 0), "completeness": (0, 1, 0), "identifiers": (1, 0, 0), "layout": (0, 0, 1)}
    assert df.select(findings.described().alias("d")).collect()[1].d == "Identifier missing: BMS"
    assert "detail" not in findings.public(df).columns
    assert {r.seg_id for r in findings.flagged(df).collect()} == {"s1", "s2"}
    ps = pairs(spark, [("a", "x"), ("b", "y"), ("c", "z")])
    assert findings.sheet(df, ps).count() == 4
    assert report.one_wording(spark.createDataFrame([("s1", "ab a")], "seg_id string, target string"), spark.createDataFrame([("s1", "a"), ("s1", "(other wording)")], "seg_id string, wording string"), spark.createDataFrame([("z",)], "wording string")).first().target == "zb z"


def test_evaluation(spark):
    ref = spark.createDataFrame([(1, 0, "abcd"), (1, 1, "")], "page int, line_no int, line string")
    assert evaluate.character_errors(ref, spark.createDataFrame([(1, "abxd"), (1, "zzzz")], "page int, line string")).first().errors == 1
    measured = spark.createDataFrame([(1, True, True), (2, True, None), (3, False, True), (4, False, False)], "k int, a boolean, p boolean")
    assert tuple(evaluate.confusion(measured, ["k"], "a", "p").first()) == (1, 1, 1, 1)


def test_translation_plan(spark):
    g = glossary_of(spark, ("chiller", "冷凍機", False, "normal", ""))
    ps = pairs(spark, [("The chiller alarm", None), ("BMS", None), ("stored alarm", None)], g)
    mem = spark.createDataFrame([("en", "ja", "stored alarm", "保存された警報", "human", 1)], "source_lang string, target_lang string, source_text string, target_text string, origin string, created_at long")
    engine = translate.dictionary_engine({"The ": "", "chiller": "チラー", "alarm": "警報", "stored": "保存"})
    got = {r.seg_id: (r.status, r.target) for r in translate.translated(ps, engine, "en", "ja", mem).collect()}
    assert got == {"s0": ("retried", "冷凍機警報"), "s1": ("kept", "BMS"), "s2": ("memory", "保存された警報")}


def test_streaming_equals_batch(spark, tmp_path):
    rows = [("Set AHU-12 to 24 °C", "AHU-12 auf 24 °C"), ("Set AHU-12 to 24 °C", "auf 42 °C"), ("x", None)]
    df = spark.createDataFrame(rows, "source string, target string")
    df.write.parquet(str(tmp_path / "in"))
    stream = validated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "en", "de")
    q = stream.writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("checked").collect())) == sorted(map(str, validated(df, "en", "de").collect()))
