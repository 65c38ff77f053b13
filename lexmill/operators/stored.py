"""Statements over the stored tables (glossaries, jobs, memory) and what is put together from stored sheets.

Tables are small and rewritten, not changed in place: each function returns the table as it is to be written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squash
from ..functions.tokens import escaped
from ..sources.scratch import materialize
from .findings import CATEGORIES, described, ordered
from .glossary import KEY, upserted
from .ranks import numbered

#: The columns of a scorecard, in order.
SCORECARD = """model deck file direction doc_terms_mode translated_pct protected_token_integrity_pct glossary_adherence_pct doc_terms
doc_term_consistency_pct tag_integrity_pct warnings harmonised repaired ocr_segments seconds tokens_per_second""".split()
WORST = 15
PANEL_TEXTS = 2


def names(glossaries: DataFrame) -> DataFrame:
    return glossaries.select("name").orderBy("name")


def ensured(glossaries: DataFrame, name: str) -> DataFrame:
    """glossaries (id, name) with the name among them; a new one gets the next id."""
    top = glossaries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.count_if(F.col("name") == name).alias("known"))
    new = top.where("known = 0").select((F.col("top") + 1).cast(glossaries.schema["id"].dataType).alias("id"), F.lit(name).alias("name"))
    return glossaries.unionByName(new)


def seeded(glossaries: DataFrame, terms: DataFrame, name: str, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """glossaries and terms with the glossary of that name among them; a new one starts with the seed's terms (columns of
    terms but ids, and seq), one that is there keeps its own."""
    after = ensured(glossaries, name)
    if not glossaries.where(F.col("name") == name).isEmpty():
        return after, terms
    own = after.where(F.col("name") == name).first().id
    return after, upserted(terms, seed.withColumn("glossary_id", F.lit(own).cast(terms.schema["glossary_id"].dataType)))


def ids_of(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """The ids of the terms with these natural keys."""
    return terms.join(keys.select(*KEY).distinct(), KEY).select("id", *KEY)


def recorded(jobs: DataFrame, reports: DataFrame, order: str = "seq") -> DataFrame:
    """jobs with a row for each report; warnings is how many issues it has."""
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(reports.withColumn("warnings", F.size("issues")), [order], "id", top + 1)
    return jobs.unionByName(new.withColumn("id", F.col("id").cast(jobs.schema["id"].dataType)).select(*jobs.columns))


def cleared(table: DataFrame) -> tuple[int, DataFrame]:
    """How many rows there were, and the table without them."""
    return table.count(), table.limit(0)


def restored_sheet(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Terms of a written sheet (doc_id, source_term, target_term, notes) with the segments (doc_id, seg_id, plain) that
    have them; unresolved ones and those of a single segment are left out. A document's terms meet its own segments."""
    term = F.col("source_term")
    ascii_ = ~term.rlike(r"[^\x00-\x7f]")
    exact = ((F.upper(term) == term) & term.rlike("[A-Z]")) | term.rlike("[0-9]")
    bounded = F.concat(F.when(exact, "").otherwise("(?i)"), F.lit("(?<![A-Za-z0-9])"), escaped(term), F.lit("(?:s|es)?(?![A-Za-z0-9])"))
    known = rows.where(~F.contains(F.coalesce("notes", F.lit("")), F.lit("UNRESOLVED"))).withColumn("__find", F.when(ascii_, bounded).otherwise(escaped(term)))
    met = known.join(segments.select("doc_id", "seg_id", "plain"), "doc_id").where(F.regexp_like("plain", F.col("__find")))
    counted = met.groupBy("doc_id", "source_term", "target_term").agg(F.count_distinct("seg_id").alias("occurrences"))
    return counted.where("occurrences >= 2")


def still_drawn(segments: DataFrame, drawn: DataFrame) -> DataFrame:
    """Segments (doc_id, seg_id, source, target) that were translated and whose source is among the drawn texts
    (doc_id, text) all the same."""
    changed = segments.where(F.col("target").isNotNull()).withColumn("__key", squash(F.col("source"))).where(F.col("__key") != squash(F.col("target")))
    return changed.join(drawn.select("doc_id", squash(F.col("text")).alias("__key")), ["doc_id", "__key"], "left_semi").drop("__key")


def scorecard(*runs: DataFrame) -> DataFrame:
    """Rows of evaluation runs under each other, in the fixed columns; what a run doesn't have is null."""
    first, *more = runs
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first.select(*(F.col(c) if c in first.columns else F.lit(None).cast("string").alias(c) for c in SCORECARD))


def worst(findings: DataFrame, most: int = WORST) -> DataFrame:
    """The first serious findings, in their order, each with how many more there are."""
    serious = findings.where("severity <> 'info'")
    n = serious.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more"))
    return ordered(serious).limit(most).join(F.broadcast(n))


def panel(findings: DataFrame) -> DataFrame:
    """category, n, texts: how many findings a category has, and its first distinct sentences by page.

    The sentences are counted and written once. Only the first of each task's sentences meet in a category's task, and
    its counts are summed apart from them.
    """
    said = findings.where(F.col("category").isin(*CATEGORIES)).select("category", described().alias("text"), F.coalesce(F.try_element_at("pages", F.lit(1)), F.lit(0)).alias("page"))
    first = materialize(said.groupBy("category", "text").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("n")), "panel", pack=True)
    place = F.row_number().over(W.partitionBy("category").orderBy("page", "text"))
    top = first.select("category", "page", "text").withColumn("place", place).where(F.col("place") <= PANEL_TEXTS)
    texts = top.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]).alias("texts"))
    return first.groupBy("category").agg(F.sum("n").alias("n")).join(F.broadcast(texts), "category")
