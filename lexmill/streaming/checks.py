"""The checks that look at one pair at a time, over a stream of pairs; they keep no state, so they need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import strip_tags
from ..functions.tokens import protected_tokens
from ..operators.validate import problems, score


def validated(pairs: DataFrame, src: str, tgt: str) -> DataFrame:
    """A stream (or table) of pairs (source, target, …) with problems and score."""
    tokens = protected_tokens(strip_tags(F.col("source")))
    rows = pairs.withColumn("problems", problems(F.col("source"), F.coalesce("target", F.lit("")), tokens, src, tgt))
    return rows.withColumn("score", score(F.col("problems")))
