"""Runs found by their files: a listing as a table, with the parts of the names as columns.

A run is a review sheet <name>_<source>-<target>_<kind>.review.csv, a file or a folder of parts, beside its output
<run>.pdf or <run>.pptx and perhaps its terms <run>.terms.csv.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
REVIEW = r"([^/]+)\.review\.csv(?:/|$)"
RUN = r"^(.+)_([a-z]{2})-([a-z]{2})_(vote|verify)$"
FORMATS = ("pdf", "pptx")  # a run with both counts as the first


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and time of all files below a folder; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select("path", "length", "modificationTime")


def discovered(listed: DataFrame, originals: DataFrame) -> DataFrame:
    """The runs among listed files (path, as of files()) whose original <name>.<format> is among the originals' files:
    folder, run, name, src, tgt, kind, format, review (the path of the sheet, file or folder) and whether there are terms."""
    path = F.regexp_replace("path", "%20", " ")
    reviews = listed.select(F.regexp_extract(path, r"^(.*?)/" + REVIEW, 1).alias("folder"), F.regexp_extract(path, REVIEW, 1).alias("run")).where("run <> ''").distinct()
    part = lambda i: F.regexp_extract("run", RUN, i)
    runs = reviews.where(F.col("run").rlike(RUN)).select("*", part(1).alias("name"), part(2).alias("src"), part(3).alias("tgt"), part(4).alias("kind"))
    beside = listed.select(F.regexp_extract(path, r"^(.*?)/([^/]+)\.(terms\.csv|pdf|pptx)(?:/|$)", 1).alias("folder"), F.regexp_extract(path, r"/([^/]+)\.(?:terms\.csv|pdf|pptx)(?:/|$)", 1).alias("run"), F.regexp_extract(path, r"\.(terms\.csv|pdf|pptx)(?:/|$)", 1).alias("what"))
    has = beside.groupBy("folder", "run").agg(F.bool_or(F.col("what") == FORMATS[0]).alias("first"), F.bool_or(F.col("what") == "terms.csv").alias("terms"))
    runs = runs.join(has, ["folder", "run"], "left").withColumn("format", F.when(F.coalesce("first", F.lit(False)), FORMATS[0]).otherwise(FORMATS[1]))
    there = originals.select(F.regexp_extract(F.regexp_replace("path", "%20", " "), r"/([^/]+)\.(?:pdf|pptx)(?:/|$)", 1).alias("name"), F.regexp_extract("path", r"\.(pdf|pptx)(?:/|$)", 1).alias("format"))
    runs = runs.join(there.distinct(), ["name", "format"], "left_semi")
    review = F.concat("folder", F.lit("/"), "run", F.lit(".review.csv"))
    return runs.select("folder", "run", "name", "src", "tgt", "kind", "format", review.alias("review"), F.coalesce("terms", F.lit(False)).alias("terms"))


def reviews(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """The rows of the runs' review sheets, with run and folder. Paths of runs come to the driver: one row a run."""
    paths = [r.review for r in runs.select("review").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "segment string, page string, source string, translation string, checks string, folder string, run string")
    rows = spark.read.csv(paths, header=True, multiLine=True, escape='"')
    path = F.regexp_replace(F.col("_metadata.file_path"), "%20", " ")
    return rows.select("*", F.regexp_extract(path, r"^(.*?)/" + REVIEW, 1).alias("folder"), F.regexp_extract(path, REVIEW, 1).alias("run"))
