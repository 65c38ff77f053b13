"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, its source's target over its source's size. Prefix sums
of the expected copies run through each source in the order (size, md5 of doc_id, doc_id); one offset per source is
added, and a document is emitted once for every integer boundary that its stretch crosses. As neighbours in that order
have like sizes, the words taken stay within about one large document of the target.

DataFrame functions only. Defined results: null text has size 0; a null source is a source of its own, last in order;
repeated rows are documents of their own; null doc_ids come last among documents of a size; sources without words
have target 0 and take none; an empty table gives an empty result; extra columns, whatever their names, pass through
mix() untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, quoted, unboxed, with_ranks

MOST = 3  # copies of a document, and target over size of a source


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(key, size) rows to one row per key: source_size, n_docs, target.

    Weights repeat through the keys in order. Shares of all words are by weight; a target above MOST times its source's
    size stops there, and the excess goes to the others by weight, again until none is above. Only four sums a round
    come to the driver.
    """
    totals = materialize(sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    ranked, before = with_ranks(totals.withColumn("one", F.lit(1)), ["one", "key"], ["one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("__before") + F.col("__inside") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = materialize(ranked.join(before, ["__part", "one"]).select("key", "source_size", "n_docs", weight.cast("long").alias("weight")), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    left, share, n_capped = total, None, -1
    while True:
        cap = F.col("source_size") * MOST
        above = F.lit(False) if share is None else F.lit(float(left)) * F.col("weight") / F.lit(float(share)) >= cap
        caps, free, n = weighed.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count(F.when(above, 1))).first()
        if n == n_capped or not free:
            break
        left, share, n_capped = total - caps, free, n
    if not share:
        return weighed.select("key", "source_size", "n_docs", F.col("source_size").cast("double").alias("target"))
    fair = F.lit(float(left)) * F.col("weight") / F.lit(float(share))
    return weighed.select("key", "source_size", "n_docs", F.least(fair, (F.col("source_size") * MOST).cast("double")).alias("target"))


def offset_of(key: str, seed: int) -> Column:
    """In [0, 1), from the seed and the source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"mix:{seed}:"), F.col(key)).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def sample(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", row: Column | None = None) -> DataFrame:
    """One row per document: doc_id, row (which tells documents apart), key, size, source_size, target, copies."""
    row = F.monotonically_increasing_id() if row is None else row
    narrow = docs.select(quoted(doc_id).alias("doc_id"), row.alias("row"), source_key(quoted(source)).alias("key"), size_of(quoted(text)).alias("size"))
    narrow = materialize(narrow.withColumn("mix", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "mix-sizes", pack=True)
    targets = source_targets(narrow.select("key", "size"), weights)
    rows, facts = with_ranks(narrow, ["key", "size", "mix", "doc_id", "row"], ["key"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    facts = facts.join(targets, "key").withColumn("rate", rate).withColumn("offset", offset_of("key", seed))
    rank = F.col("__before") + F.col("__inside")
    crossed = F.floor(F.col("offset") + F.col("rate") * rank) - F.floor(F.col("offset") + F.col("rate") * (rank - 1))
    out = rows.join(facts, ["__part", "key"])
    return out.select("doc_id", "row", "key", "size", "source_size", "target", F.least(crossed, F.lit(MOST)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", stored: bool = False) -> DataFrame:
    """The mixture itself: docs' columns, each document as often as it was drawn. stored: see common.numbered().

    Documents move once, by row, to meet their copies.
    """
    rows = numbered(docs, stored)
    asked = rows.select("row", *[F.col("doc")[c].alias(k) for k, c in (("doc_id", doc_id), ("text", text), ("source", source))])
    drawn = sample(asked, weights, seed, row=F.col("row")).where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    return unboxed(rows.join(drawn, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)
