"""Findings of quality checks: one schema, their order, counts, wording and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, category string, code string, severity string, message string, segments array<string>, pages array<int>, detail string"
CATEGORIES = {"terminology": "Terminology consistency", "completeness": "Missing or partial translation", "identifiers": "Identifiers and numbers", "layout": "Layout and fonts"}
RANK = {"error": 0, "warning": 1, "info": 2}


def finding(category: str, code: str | Column, severity: str | Column, message: Column, detail: Column | None = None, segments: Column | None = None, pages: Column | None = None) -> list[Column]:
    """The columns of a finding; of one segment unless segments and pages are given."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        F.col("doc_id"),
        F.lit(category).alias("category"),
        as_col(code).alias("code"),
        as_col(severity).alias("severity"),
        message.alias("message"),
        (F.array("seg_id") if segments is None else segments).alias("segments"),
        (F.array(F.col("container").cast("int")) if pages is None else pages).alias("pages"),
        (F.lit(None).cast("string") if detail is None else F.to_json(detail)).alias("detail"),
    ]


def union(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first


def _of(mapping: dict, name: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(name))


def ordered(findings: DataFrame) -> DataFrame:
    """Errors first, then by category and first page; the rest of the order is fixed too."""
    place = {k: i for i, k in enumerate(CATEGORIES)}
    return findings.orderBy(_of(RANK, "severity"), _of(place, "category"), F.coalesce(F.try_element_at("pages", F.lit(1)), F.lit(0)), "doc_id", "code", F.array_join("segments", ","))


def by_segment(findings: DataFrame) -> DataFrame:
    return findings.withColumn("seg_id", F.explode("segments")).drop("segments")


def flagged(findings: DataFrame) -> DataFrame:
    return by_segment(findings.where("severity <> 'info'")).select("seg_id").distinct()


def summary(findings: DataFrame) -> DataFrame:
    """A row for each category, those without findings too."""
    spark: SparkSession = findings.sparkSession
    known = spark.createDataFrame(list(CATEGORIES.items()), "category string, label string")
    counts = findings.groupBy("category").agg(*(F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))))
    return F.broadcast(known).join(counts, "category", "left").na.fill(0)


def public(findings: DataFrame) -> DataFrame:
    """What may leave with a report: nothing with document text."""
    return findings.select("category", "code", "severity", "message", "segments", "pages")


def described() -> Column:
    """One sentence for a reviewer, from code and detail."""
    d = lambda k: F.get_json_object("detail", f"$.{k}")
    listed = lambda k: F.array_join(F.from_json(d(k), "array<string>"), ", ")
    quoted = lambda c: F.concat(F.lit("“"), c, F.lit("”"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    variants = F.when(F.coalesce(d("majority"), F.lit("")) != "", say(quoted(d("term")), " is ", quoted(d("majority")), " in most places"))
    # The sentence for each code.
    texts = {
        "glossary_term": say("Glossary: ", quoted(d("term")), " should be ", quoted(d("approved"))),
        "term_variants": variants.otherwise(say(quoted(d("term")), " is translated differently")),
        "same_source_differs": F.lit("The same text is translated differently elsewhere"),
        "not_translated": F.lit("Not translated"),
        "partly_translated": say("Left untranslated: ", listed("left")),
        "possible_omission": F.lit("Shorter than expected: part of the text may be missing"),
        "foreign_script": F.lit("Contains characters from another language"),
        "added_text": F.lit("Has extra lines: the model may have added text"),
        "not_written": F.lit("Missing from the written file"),
        "original_left": F.lit("The original text is still visible on the page"),
        "token_changed": say("Identifier changed: ", d("from"), " → ", d("to")),
        "token_missing": say("Identifier missing: ", d("missing")),
        "token_added": say("Not in the original: ", listed("added")),
        "number_changed": say("Number or unit missing or changed: ", listed("missing")),
        "overflow": F.lit("Text may not fit its box"),
        "font_reduced": F.lit("Font made smaller to fit"),
        "box_grows": F.lit("Text box grows with the longer text: check it does not cover other content"),
        "overflow_inherited": F.lit("Text runs past its box, as it did in the original"),
        "extra_lines": F.lit("Title wraps onto more lines than the original"),
        "formatting_simplified": F.lit("Mixed formatting (e.g. bold words) simplified to one style"),
        "missing_glyphs": say("Characters no installed font can show: ", F.coalesce(d("characters"), F.lit(""))),
        "substitute_font": F.lit("Some characters are shown in a substitute font"),
        "font_not_installed": say("Font not installed on this PC: ", F.coalesce(d("font"), F.lit(""))),
    }
    out = None
    for code, text in texts.items():
        out = F.when(F.col("code") == code, text) if out is None else out.when(F.col("code") == code, text)
    return F.coalesce(out, F.col("message"))


def sheet(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the findings sheet: a finding and a segment each, one with an empty segment where it has none."""
    rows = findings.withColumn("text", described()).withColumn("segment", F.explode_outer("segments"))
    texts = pairs.select(F.col("seg_id").alias("segment"), F.col("container").alias("page"), F.col("plain").alias("source"), F.col("target").alias("translation"))
    out = rows.select("severity", "category", "text", "segment", F.try_element_at("pages", F.lit(1)).alias("first_page")).join(texts, "segment", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select("severity", F.col("category").alias("check"), F.col("text").alias("finding"), F.coalesce("page", "first_page").alias("page"), blank("segment").alias("segment"), blank("source").alias("source"), blank("translation").alias("translation"))
