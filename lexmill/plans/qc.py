"""Checking a document's translation: pairs, the checks over them, and what comes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import default_target, detected
from ..functions.tags import strip_tags
from ..functions.tokens import nothing_to_translate, protected_tokens
from ..operators import checks
from ..operators.compare import paired_by_id
from ..operators.context import document_text
from ..operators.findings import flagged, union
from ..operators.geometry import paired
from ..operators.glossary import HINT, kept_terms, with_hints
from ..operators.report import metrics
from ..operators.terms import voted
from ..sources.scratch import materialize


def pairs_of(segments: DataFrame, terms: DataFrame | None, src: str, tgt: str) -> DataFrame:
    """Segments (with target) as pairs: plain source, glossary hints by the page around, identifiers, kept."""
    rows = segments.withColumns({"plain": strip_tags(F.col("source")), "target": strip_tags(F.col("target"))})
    if terms is None:
        rows = rows.withColumn("hints", F.array().cast(HINT))
    else:
        rows = with_hints(rows, terms, src, tgt, "plain", page=["doc_id", "container"])
    rows = checks.with_repeat_hash(rows)
    rows = rows.withColumn("protected", protected_tokens(F.col("plain"), kept_terms()))
    return rows.withColumn("kept", nothing_to_translate(F.col("plain"), src, F.col("protected")))


def check(
    pairs: DataFrame, src: str, tgt: str, candidates: DataFrame | None = None, uses: DataFrame | None = None, issues: DataFrame | None = None, segments: DataFrame | None = None, notes: DataFrame | None = None, reread: DataFrame | None = None
) -> DataFrame:
    """The findings of all checks on pairs, which are written once and read by each check.

    Recurring terms are checked where their candidates (doc_id, phrase, candidate) and uses (doc_id, phrase, seg_id,
    target) are given, layout where issues of rendering and the segments they are about are, as checks.layout takes them,
    the reader's notes (doc_id, note) where they are, and the written file where its texts as read again (seg_id, text) are.
    """
    return found_in(materialize(pairs, "qc-pairs"), src, tgt, candidates, uses, issues, segments, notes, reread)


def found_in(pairs: DataFrame, src: str, tgt: str, candidates: DataFrame | None = None, uses: DataFrame | None = None, issues: DataFrame | None = None, segments: DataFrame | None = None, notes: DataFrame | None = None, reread: DataFrame | None = None) -> DataFrame:
    """check() on pairs that are written already."""
    found = [checks.completeness(pairs, src, tgt), checks.glossary_terms(pairs, tgt), checks.same_source_differs(pairs, tgt), checks.identifiers(pairs)]
    if candidates is not None:
        found.append(checks.term_variants(pairs, candidates, uses, voted(candidates, uses, tgt), tgt))
    if issues is not None:
        found.append(checks.layout(issues, segments))
    if notes is not None:
        found.append(checks.notes(notes))
    if reread is not None:
        found.append(checks.unwritten(pairs.where("target is not null and not kept"), reread))
    return union(*found)


def check_documents(original: DataFrame, translation: DataFrame, terms: DataFrame | None, src: str, tgt: str, boxes: bool = False, **more: DataFrame) -> DataFrame:
    """The findings on translations that come from outside: their segments meet the originals' by id or, where both have
    boxes (page, id, seq, text, x0 …), by place. more goes to check()."""
    if boxes:
        texts = paired(original.withColumn("id", F.col("seg_id")), translation).withColumnRenamed("translation", "target")
        rows = original.drop("target").join(texts, "seg_id", "left")
    else:
        rows = paired_by_id(original, translation)
    return check(pairs_of(rows, terms, src, tgt), src, tgt, **more)


def check_edits(segments: DataFrame, edits: DataFrame, terms: DataFrame | None, src: str, tgt: str) -> DataFrame:
    """The findings that segments would have by themselves with other translations (seg_id, target)."""
    return check(pairs_of(segments.drop("target").join(edits.select("seg_id", "target"), "seg_id"), terms, src, tgt), src, tgt)


def inspected(segments: DataFrame, preferred: str = "", text: str = "source") -> DataFrame:
    """Per document: language, confidence, target to offer, segments, pages."""
    counts = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count_distinct("container").alias("n_pages"))
    told = document_text(segments, text).withColumn("d", detected(F.col("document_text")))
    return counts.join(told.select("doc_id", "d.language", "d.confidence", default_target(F.col("d.language"), F.lit(preferred)).alias("target")), "doc_id")


def summarised(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: a translation's measures, how many segments were edited or are flagged, and its findings by severity."""
    counts = findings.agg(*(F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "notes"))))
    serious = flagged(findings).agg(F.count(F.lit(1)).alias("flagged"))
    edits = outcomes.agg(F.count_if(F.col("status") == "edited").alias("edited"), F.count_if(F.col("status") == "repaired").alias("repaired"))
    one = lambda df: df.withColumn("k", F.lit(1))
    out = one(metrics(outcomes))
    for more in (edits, serious, counts):
        out = out.join(one(more), "k")
    return out.drop("k")
