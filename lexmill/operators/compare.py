"""A document against its translation or its written copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import strip_tags


def paired_by_id(segments: DataFrame, translated: DataFrame) -> DataFrame:
    """segments with target, the text of the same place in the other document."""
    other = translated.select("seg_id", strip_tags(F.col("source")).alias("target"))
    return segments.join(other, "seg_id", "left")


def page_counts(segments: DataFrame, translated: DataFrame) -> DataFrame:
    """Per document both numbers of pages, and the error if they differ."""
    count = lambda df, n: df.groupBy("doc_id").agg(F.max("container").alias(n))
    met = count(segments, "n").join(count(translated, "n_other"), "doc_id", "full")
    error = F.concat(F.lit("The files have a different number of slides ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" and "), F.coalesce("n_other", F.lit(0)).cast("string"), F.lit(")."))
    return met.select("doc_id", "n", "n_other", F.when(~F.col("n").eqNullSafe(F.col("n_other")), error).alias("error"))


def changed(segments: DataFrame) -> DataFrame:
    """Segments whose translation isn't their source."""
    return segments.where(F.col("target").isNotNull() & (F.col("target") != F.col("source")))


def new_fonts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per page the fonts (array column fonts) that only the written copy has."""
    met = after.join(before.select("page", F.col("fonts").alias("__old")), "page", "left")
    return met.select("page", F.array_sort(F.array_except("fonts", F.coalesce("__old", F.array().cast("array<string>")))).alias("fonts")).where("size(fonts) > 0")


def overflowing(before: DataFrame, after: DataFrame, slack: float = 1.05) -> DataFrame:
    """Shapes whose text is higher than their box and than it was before, with some slack."""
    met = after.join(before.select("shape_key", F.col("text_height").alias("__was")), "shape_key", "left")
    limit = F.greatest("box_height", F.coalesce("__was", F.lit(0.0))) * slack
    return met.where(F.col("text_height") > limit).select(*after.columns)


def last_by_text(segments: DataFrame) -> DataFrame:
    """(shape_key, text, translation): a shape's texts with the translation of the last segment that has each."""
    return segments.groupBy("shape_key", F.trim("plain").alias("text")).agg(F.max_by("target", "pos").alias("translation"))


def usable_models(models: DataFrame, main: str, src: str, tgt: str) -> DataFrame:
    """models (model, installed, languages) with why one can't repair another's work; null where it can."""
    lacks = F.size(F.array_except(F.array(F.lit(src), F.lit(tgt)), F.col("languages"))) > 0
    why = F.when(F.col("model") == main, "repair model is the same as the main model").when(~F.col("installed"), F.concat("model", F.lit(" is not installed")))
    return models.withColumn("reason", why.when(lacks, F.concat("model", F.lit(" is not used for this language pair"))))
