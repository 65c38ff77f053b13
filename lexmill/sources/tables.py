"""Reading and writing: the input tables, glossaries and reports as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a glossary, in order.
GLOSSARY = ["source_term", "target_term", "source_lang", "target_lang", "category", "notes", "do_not_translate", "priority", "context"]
BOM = "\ufeff"
AS_IT_IS = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # writing drops blanks at the ends else


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supported(path: str):
    """Column: the format of a path, or null."""
    suffix = F.lower(F.element_at(F.split(F.col(path), r"\."), -1))
    return F.when(suffix.isin("pptx", "pdf"), suffix)


def clean_glossary(raw: DataFrame) -> DataFrame:
    """Typed rows of a glossary whose cells are strings; rows without a source term are dropped."""
    cell = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    raw = raw.withColumnsRenamed({c: c.lstrip(BOM) for c in raw.columns})
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in GLOSSARY if c not in raw.columns})
    out = raw.select(*(cell(c).alias(c) for c in GLOSSARY)).where("source_term <> ''")
    priority = F.when(F.col("priority") == "", "normal").otherwise(F.lower("priority"))
    return out.withColumns({"do_not_translate": F.lower("do_not_translate").isin("true", "1", "yes"), "priority": priority})


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    return clean_glossary(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def write_glossary(terms: DataFrame, path: str) -> None:
    """As CSV with a byte order mark before the header, which tells spreadsheets that it is UTF-8."""
    flags = F.when(F.col("do_not_translate"), "true").otherwise("false")
    rows = terms.withColumn("do_not_translate", flags).select(*GLOSSARY).withColumnRenamed(GLOSSARY[0], BOM + GLOSSARY[0])
    rows.write.mode("overwrite").csv(path, header=True, **AS_IT_IS)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_review(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, **AS_IT_IS)


def restored(segments: DataFrame, review: DataFrame) -> DataFrame:
    """Segments with the translations of a review sheet; empty ones are none."""
    found = review.select(F.col("segment").alias("seg_id"), F.nullif("translation", F.lit("")).alias("translation")).dropDuplicates(["seg_id"])
    return segments.join(found, "seg_id", "left")


def first_of_each_blob(images: DataFrame, content: str = "content") -> DataFrame:
    """images with the SHA-1 digest of their content and whether they are its first; the work on a blob is done once."""
    digest = images.withColumn("digest", F.sha1(F.col(content).cast("binary")))
    firsts = digest.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return digest.join(firsts, "digest").withColumn("is_first", F.col("id") == F.col("first_id"))
