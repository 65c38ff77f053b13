"""Reports, review sheets, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import uses
from .checks import compared
from .findings import described


def percent(hits: Column, total: Column) -> Column:
    """To one decimal; null of nothing."""
    return F.round(100 * hits / F.nullif(total, F.lit(0)), 1)


def status_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def metrics(outcomes: DataFrame) -> DataFrame:
    """One row over outcomes (status, target, n_tokens, n_token_hits, n_terms, n_term_hits, has_tags, simplified,
    ocr_confidence)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return outcomes.agg(
        F.count(F.lit(1)).alias("segments"),
        F.count("target").alias("translated_segments"),
        percent(F.count("target"), F.count(F.lit(1))).alias("translated_pct"),
        percent(total("n_token_hits"), total("n_tokens")).alias("protected_token_integrity_pct"),
        percent(total("n_term_hits"), total("n_terms")).alias("glossary_adherence_pct"),
        percent(F.count_if(F.col("has_tags") & ~F.col("simplified")), F.count_if("has_tags")).alias("tag_integrity_pct"),
        F.count("ocr_confidence").alias("ocr_segments"),
    )


def term_metrics(outcomes: DataFrame, sheet: DataFrame, found: DataFrame, tgt: str) -> DataFrame:
    """One row: how many translated segments have a term of the document that is settled (sheet: doc_id, phrase, target;
    found: doc_id, phrase, seg_id), how many of these use it, both as a percentage, how many terms are settled, and how many aren't though they have candidates."""
    settled = sheet.where("target <> ''").select("doc_id", "phrase", F.col("target").alias("__to"))
    texts = outcomes.where(F.col("target").isNotNull()).select("seg_id", "target")
    each = found.select("doc_id", "phrase", "seg_id").join(settled, ["doc_id", "phrase"]).join(texts, "seg_id")
    used = each.agg(F.count(F.lit(1)).alias("doc_term_checks"), F.count_if(uses(F.col("target"), F.col("__to"), tgt)).alias("doc_term_hits"))
    open_ = F.coalesce("target", F.lit("")) == ""
    worded = open_ & (F.size("candidates") > 0) if "candidates" in sheet.columns else open_
    terms = sheet.agg(F.count_if(~open_).alias("doc_terms"), F.count_if(worded).alias("unresolved_terms"))
    one = lambda df: df.withColumn("__k", F.lit(1))
    out = one(used).join(one(terms), "__k").drop("__k")
    return out.withColumn("doc_term_consistency_pct", percent(F.col("doc_term_hits"), F.col("doc_term_checks")))


def checked(pairs: DataFrame, recurring: DataFrame | None = None, reread: DataFrame | None = None) -> DataFrame:
    """What a check looked at, one row: paragraphs, of which translated, the identifiers and glossary terms of these,
    the recurring terms of a sheet, and how many translations stand in the written file as read again (seg_id, text)."""
    active = ~F.col("kept") & F.col("target").isNotNull()
    total = lambda n: F.coalesce(F.sum(F.when(active, n)), F.lit(0))
    out = pairs.agg(
        F.count(F.lit(1)).alias("paragraphs"),
        F.count_if(active).alias("translated"),
        total(F.size("protected")).alias("identifiers"),
        total(F.size(F.filter("hints", lambda h: ~h["keep"]))).alias("glossary_terms"),
    )
    one = lambda df: df.withColumn("__k", F.lit(1))
    counts = [] if recurring is None else [recurring.agg(F.count(F.lit(1)).alias("recurring_terms"))]
    if reread is not None:
        counts.append(compared(pairs.where(active), reread).agg(F.count_if("written").alias("written_verified")))
    for more in counts:
        out = one(out).join(one(more), "__k").drop("__k")
    return out if recurring is not None else out.withColumn("recurring_terms", F.lit(0).cast("long"))


def review_sheet(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each segment with what was found on it, errors first."""
    said = findings.withColumn("text", F.concat("severity", F.lit(": "), described())).withColumn("seg_id", F.explode("segments"))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    said = said.groupBy("seg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "code", "text"))), lambda s: s["text"]), "; ").alias("checks"))
    rows = outcomes.join(said, "seg_id", "left")
    return rows.select(F.col("container").alias("page"), F.col("seg_id").alias("segment"), "kind", "status", F.coalesce("checks", F.lit("")).alias("checks"), "source", F.coalesce("target", F.lit("")).alias("translation"))


def filtered(rows: DataFrame, focus: list[str] | None = None, show: str = "all", category: str | None = None, search: str = "") -> DataFrame:
    """Rows of a review (segment, status, severities, categories, source, translation) that a reviewer asked for."""
    wanted = {"all": F.lit(True), "flagged": F.arrays_overlap("severities", F.array(F.lit("error"), F.lit("warning"))), "edited": F.col("status") == "edited"}[show]
    if category:
        wanted = wanted & F.array_contains("categories", category)
    if focus:
        wanted = F.col("segment").isin(focus)
    has = F.lower(F.concat_ws("\n", "source", "translation")).contains(search.lower())
    return rows.where(wanted & has)


def tallies(issues: DataFrame) -> DataFrame:
    """Issues by code, most frequent first."""
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code")


def history(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(n)


def job_summary(jobs: DataFrame) -> DataFrame:
    """Per status, how many jobs and their totals; tokens a second where there was time."""
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tokens"), 3).alias("tokens"), F.round(F.sum("tokens") / F.nullif(F.sum("seconds"), F.lit(0)), 6).alias("rate"))


def edited(outcomes: DataFrame, edits: DataFrame) -> DataFrame:
    """outcomes with the edits (seg_id, target) put in; their status says so."""
    new = edits.select("seg_id", F.col("target").alias("__new"))
    return outcomes.join(new, "seg_id", "left").withColumns({"target": F.coalesce("__new", "target"), "status": F.when(F.col("__new").isNotNull(), "edited").otherwise(F.col("status"))}).drop("__new").select(*outcomes.columns)


def one_wording(targets: DataFrame, wordings: DataFrame, chosen: DataFrame) -> DataFrame:
    """targets (seg_id, target) with the known other wordings (seg_id, wording) of a term replaced by the chosen one
    (one row: wording)."""
    to = chosen.select(F.col("wording").alias("__to"))
    other = wordings.where(~F.col("wording").startswith("(")).crossJoin(F.broadcast(to.limit(1))).where("wording <> __to")
    swaps = other.groupBy("seg_id").agg(F.array_sort(F.collect_set(F.struct(F.col("wording").alias("a"), F.col("__to").alias("b")))).alias("__swaps"))
    changed = F.aggregate("__swaps", F.col("target"), lambda at, s: F.replace(at, s["a"], s["b"]))
    return targets.join(swaps, "seg_id", "left").withColumn("target", F.when(F.col("__swaps").isNull(), F.col("target")).otherwise(changed)).select(*targets.columns)
