"""Evaluation: tallies of seeded errors, confusion matrices, consistency, character error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded_tally(seeded: DataFrame, findings: DataFrame, intended: DataFrame) -> DataFrame:
    """Per mutation and over all (mutation null): injected, detected by the intended check, flagged by any.

    seeded: seg_id, mutation; findings by segment: seg_id, code; intended: mutation, code.
    """
    any_ = findings.select("seg_id").distinct().withColumn("__any", F.lit(True))
    meant = findings.join(F.broadcast(intended), "code").select("seg_id", "mutation").distinct().withColumn("__meant", F.lit(True))
    rows = seeded.join(any_, "seg_id", "left").join(meant, ["seg_id", "mutation"], "left")
    return rows.rollup("mutation").agg(F.count(F.lit(1)).alias("injected"), F.count("__meant").alias("detected"), F.count("__any").alias("flagged"))


def sampled(seeded: DataFrame, n: int = 6) -> DataFrame:
    """n of each mutation, by hash."""
    order = W.partitionBy("mutation").orderBy(F.md5(F.col("seg_id").cast("binary")), "seg_id")
    return seeded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def per_hundred(findings: DataFrame, n_paragraphs: int) -> DataFrame:
    return findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.count(F.lit(1)) / F.lit(max(1, n_paragraphs)), 6).alias("per_100"))


def confusion(measured: DataFrame, key: list[str], actual: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn in one row; null predictions are none."""
    a, p = F.coalesce(F.col(actual), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    return measured.dropDuplicates(key).agg(*(F.count_if(c).alias(n) for n, c in (("tp", a & p), ("fp", ~a & p), ("fn", a & ~p), ("tn", ~a & ~p))))


def consistency(used: DataFrame) -> DataFrame:
    """Per term: n, share of the most used variant, share of acceptable ones. used: term, variant, acceptable."""
    counts = used.groupBy("term", "variant").agg(F.count(F.lit(1)).alias("n"), F.count_if("acceptable").alias("good"))
    return counts.groupBy("term").agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("consistent"), (F.sum("good") / F.sum("n")).alias("correct"))


def overall(scores: DataFrame) -> DataFrame:
    """Means over terms, weighted by how often each stands."""
    mean = lambda c: F.round(F.sum(F.col("n") * F.col(c)) / F.nullif(F.sum("n"), F.lit(0)), 6)
    return scores.agg(F.sum("n").alias("n"), mean("consistent").alias("consistent"), mean("correct").alias("correct"))


def character_errors(reference: DataFrame, recognised: DataFrame, key: str = "page") -> DataFrame:
    """Per page: reference characters, errors to the closest recognised line, their rate.

    The lines of a page are few; pages meet by key, so no line meets those of another page.
    """
    met = reference.where("line <> ''").join(recognised.where("line <> ''").select(key, F.col("line").alias("read")), key, "left")
    best = met.groupBy(key, "line_no", "line").agg(F.min(F.coalesce(F.levenshtein("line", "read"), F.length("line"))).alias("d"))
    return best.groupBy(key).agg(F.sum(F.length("line")).alias("chars"), F.sum("d").alias("errors"), F.round(F.sum("d") / F.greatest(F.sum(F.length("line")), F.lit(1)), 6).alias("rate"))
