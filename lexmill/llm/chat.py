"""Chat formatting with collapse of cumulative snapshots.

A log of conversations often holds the same conversation after every turn. Rolling hashes over the turns, four sums
that each turn adds its position-bound 32-bit hash words to, name every prefix of a conversation; a conversation whose
name is that of a proper prefix of another is dropped by an anti-join, of equal ones the smallest conv_id stays, and
those left are rendered. Sums run over windows, so a long conversation spills instead of filling memory, and both sides
of the anti-join have one row per name, so a popular first turn is one row.

DataFrame functions only. Defined results: turns go by (turn, role, text), nulls first; null roles render as
"unknown", null texts as empty, and each equals only its like; repeated turns stay; a turn of a null conv_id belongs to
no other and is a conversation by itself, so that such turns, however many, gather in no one place; an empty table gives
an empty result; extra columns, whatever their names, are ignored. A rendered conversation is one row, so each must fit
one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, quoted

NAME = ["n", "p0", "p1", "p2", "p3"]


def _mark(n: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", n.cast("string"), F.coalesce(F.concat(F.lit("r"), "role"), F.lit("-")), F.coalesce("said", F.lit("-"))).cast("binary"), 256)


def _words(mark: Column) -> dict[str, Column]:
    return {f"p{i}": F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}


def _turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(quoted(conv_id).alias("conv_id"), quoted(turn).alias("turn"), quoted(role).alias("role"), quoted(text).alias("text"), F.sha2(quoted(text).cast("binary"), 256).alias("said"))


def _lone(rows: DataFrame) -> DataFrame:
    """Turns of no conversation, with their names."""
    one = F.lit(1).cast("long")
    return rows.where("conv_id is null").withColumns({"n": one, "last": F.lit(True)} | _words(_mark(one)))


def prefixes(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, last, n and the four sums: a row for each turn, the name of the prefix that ends with it."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("said").asc_nulls_first()]
    every = _turns(turns, conv_id, turn, role, text).drop("text")
    rows = every.where("conv_id is not null")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).cast("long"))
    rows = rows.withColumn("mark", _mark(F.col("n")))
    whole = W.partitionBy("conv_id").orderBy("n")
    words = {k: F.sum(v).over(whole.rowsBetween(W.unboundedPreceding, 0)) for k, v in _words(F.col("mark")).items()}
    rows = rows.withColumns(words | {"last": F.lead("n").over(whole).isNull()}).select("conv_id", "last", *NAME)
    return rows.unionByName(_lone(every).select("conv_id", "last", *NAME))


def maximal(turns: DataFrame, **names: str) -> DataFrame:
    """conv_id, n_turns, n_equal and the name of the conversations that no other continues; of equal ones the smallest
    conv_id (null: last)."""
    named = materialize(prefixes(turns, **names), "chat-prefixes", pack=True)
    ended = named.where("last").groupBy(*NAME).agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    going = named.where("not last").select(*NAME).distinct()
    return ended.join(going, NAME, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_equal", *NAME)


def render(turns: DataFrame, keep: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """One row per conversation of keep, rendered turn by turn."""
    one = lambda role, text: F.concat(F.lit(opening), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(closing + "\n"))
    every = _turns(turns, conv_id, turn, role, text)
    rows = every.where("conv_id is not null").select("conv_id", F.struct("turn", "role", "said", "text").alias("t"))
    kept = keep.select("conv_id", "n_turns", "n_equal").join(rows, "conv_id")
    said = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: one(t["role"], t["text"])), "")
    grouped = kept.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_equal").alias("n_equal"), said.alias("rendered"))
    lone = _lone(every).groupBy(*NAME).agg(F.any_value(F.struct("role", "text")).alias("t"))
    alone = keep.where("conv_id is null").join(lone, NAME).select("conv_id", "n_turns", "n_equal", one(F.col("t.role"), F.col("t.text")).alias("rendered"))
    return grouped.select("conv_id", "n_turns", "n_equal", "rendered").unionByName(alone)


def format_chats(turns: DataFrame, **names: str) -> DataFrame:
    return render(turns, materialize(maximal(turns, **names), "chat-maximal"), **names)
