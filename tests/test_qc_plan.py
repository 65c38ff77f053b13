"""The checking plan makes the findings on recurring terms and layout too."""

from pyspark.sql import functions as F
from test_operators import pairs

from lexmill.plans import qc


def test_terms_and_layout(spark):
    logs = pairs(spark, [("trend log a", "トレンドログA"), ("trend log b", "トレンドログB"), ("trend log c", "傾向ログC")])
    candidates = spark.createDataFrame([(1, "trend log", "トレンドログ"), (1, "trend log", "傾向ログ")], "doc_id long, phrase string, candidate string")
    uses = logs.select("doc_id", F.lit("trend log").alias("phrase"), "seg_id", "target")
    issues = spark.createDataFrame([(1, "overflow", "warning", "s1", "text runs over")], "doc_id long, code string, severity string, ref string, message string")
    segments = logs.withColumns({"shape_key": F.col("seg_id"), "formatting_simplified": F.col("seg_id") == "s0"})
    told = {r.code: r.segments for r in qc.check(logs, "en", "ja", candidates, uses, issues, segments).collect()}
    assert told["term_variants"] == ["s2"] and told["overflow"] == ["s1"] and "formatting_simplified" in told
    assert not {"term_variants", "overflow"} & {r.code for r in qc.check(logs, "en", "ja").collect()}
