from lexmill.operators import report


def test_document_term_metrics(spark):
    outcomes = spark.createDataFrame([("a", "Die Pumpe"), ("b", "Eine pumpe"), ("c", "Das Rad"), ("d", None)], "seg_id string, target string")
    sheet = spark.createDataFrame([(1, "pump", "Pumpe", ["Pumpe"]), (1, "fan", "", ["x", "y"]), (1, "cap", "", []), (1, "hub", None, ["z"])], "doc_id long, phrase string, target string, candidates array<string>")
    found = spark.createDataFrame([(1, "pump", s) for s in "abcd"] + [(1, "fan", "a")], "doc_id long, phrase string, seg_id string")
    got = report.term_metrics(outcomes, sheet, found, "de").first()
    assert (got.doc_term_checks, got.doc_term_hits, got.doc_terms, got.unresolved_terms, got.doc_term_consistency_pct) == (3, 2, 1, 2, 66.7)
    none = report.term_metrics(outcomes, sheet.limit(0), found, "de").first()
    assert (none.doc_term_checks, none.doc_term_consistency_pct) == (0, None)


def test_checked_counts(spark):
    hint = "array<struct<source:string,target:string,keep:boolean,origin:string>>"
    h = lambda keep: ("s", "t", keep, "glossary")
    pairs = spark.createDataFrame([(1, "a", 1, "Die Pumpe", False, ["x", "y"], [h(False), h(True)]), (1, "b", 1, None, False, ["z"], [h(False)]), (1, "c", 1, "12", True, ["12"], []), (1, "d", 1, "Ein Rad dreht sich", False, [], [])], f"doc_id long, seg_id string, container int, target string, kept boolean, protected array<string>, hints {hint}")
    reread = spark.createDataFrame([("a", "Die  Pumpe"), ("d", "anderes")], "seg_id string, text string")
    assert report.checked(pairs).first().asDict() == {"paragraphs": 4, "translated": 2, "identifiers": 2, "glossary_terms": 1, "recurring_terms": 0}
    assert report.checked(pairs, pairs.limit(3), reread).first().asDict() == {"paragraphs": 4, "translated": 2, "identifiers": 2, "glossary_terms": 1, "recurring_terms": 3, "written_verified": 1}
