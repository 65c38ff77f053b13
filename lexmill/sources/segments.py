"""Documents as ordered segments, and segments with their translations as pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..functions.tags import strip_tags

LINES_A_PAGE = 10


def segments_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, seg_id, container, kind, source: a row for each line that isn't blank. The first line is the title."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "source"))
    return (
        lines.where(F.col("source").rlike(r"\S"))
        .withColumn("seg_id", F.concat(F.col("doc_id").cast("string"), F.lit("/r"), F.col("pos").cast("string")))
        .withColumn("container", (F.floor(F.col("pos") / LINES_A_PAGE) + 1).cast("int"))
        .withColumn("kind", F.when(F.col("pos") == 0, "title").otherwise("body"))
        .select("doc_id", "pos", "seg_id", "container", "kind", "source")
    )


def with_identifiers(segments: DataFrame) -> DataFrame:
    """Test input: identifiers, numbers, units and tags put into some segments by rule."""
    line, doc, pos = F.col("source"), F.col("doc_id").cast("string"), F.col("pos").cast("string")
    put = (
        F.when(F.col("pos") % 6 == 1, F.concat(line, F.lit(" Set AHU-"), doc, F.lit(" to 24 °C via TCP/IP.")))
        .when(F.col("pos") % 6 == 3, F.concat(line, F.lit(" See https://x.example.com/a"), pos, F.lit(" and 1,250 kWh.")))
        .when(F.col("pos") % 6 == 4, F.concat(F.lit("<g1>"), line, F.lit("</g1> by <g2>BMS</g2>")))
        .otherwise(line)
    )
    return segments.withColumn("source", put)


def mutated(segments: DataFrame) -> DataFrame:
    """Test pairs: a translation made from each source by one of eight rules, named in the column mutation."""
    plain = strip_tags(F.col("source"))
    k = (F.col("doc_id") * 31 + F.col("pos")) % 8
    rules: list[tuple[str, Column]] = [
        ("copied", F.col("plain")),
        ("upper", F.upper(F.replace("plain", F.lit("ß"), F.lit("ss")))),
        ("last_word_dropped", F.regexp_replace("plain", " [^ ]*$", "")),
        ("digits_changed", F.translate("plain", "0123456789", "1234567890")),
        ("tokens_dropped", F.regexp_replace("plain", "[A-Z][A-Z0-9]+", "")),
        ("line_added", F.concat("plain", F.lit("\nextra line"))),
        ("missing", F.lit(None).cast("string")),
        ("next_line", F.coalesce(strip_tags(F.col("__next")), F.col("plain"))),
    ]
    # Sources are what is shuffled; all that is made of them comes after. A page's lines follow each other, so in this
    # order windows over pages need no sort of their own.
    order = [c for c in ("container", "pos") if c in segments.columns]
    out = segments.withColumn("__next", F.lead("source").over(W.partitionBy("doc_id").orderBy(*order))).withColumn("plain", plain)
    name, target = F.lit(None), F.lit(None)
    for i, (rule, column) in enumerate(rules):
        name, target = (F.when(k == i, rule), F.when(k == i, column)) if i == 0 else (name.when(k == i, rule), target.when(k == i, column))
    return out.withColumns({"mutation": name, "target": target}).drop("__next")


def encoded_runs(runs: DataFrame) -> DataFrame:
    """(para, source): formatted runs (para, seq, style, text) as text with tags, as encoded()."""
    held = runs.groupBy("para").agg(F.array_sort(F.collect_list(F.struct("seq", "style", "text"))).alias("runs"))
    return held.select("para", encoded(F.col("runs")).alias("source"))


def encoded(runs: Column) -> Column:
    """A paragraph's runs in their order, an array of structs with style, perhaps null, and text, as text with tags. The
    style of most characters has none; the others are numbered as they first appear; runs of blanks go without, and
    neighbours of a style share a tag."""

    def size(rs, style):
        length = lambda r: F.length(F.trim(r["text"])).cast("long")
        return F.aggregate(rs, F.lit(None).cast("long"), lambda n, r: F.when(r["style"].eqNullSafe(style), let(length(r), lambda k: F.coalesce(n + k, n, k))).otherwise(n))

    def main(rs, styles):
        return F.array_max(F.transform(styles, lambda s, i: F.struct(size(rs, s).alias("n"), (-i).alias("at"), s.alias("style"))))

    def told(rs, styles, main):
        others = F.transform(F.filter(styles, lambda s: ~s.eqNullSafe(main["style"])), lambda s: F.struct(s.alias("style")))
        put = lambda others: F.transform(rs, lambda r: F.when(r["style"].eqNullSafe(main["style"]) | (F.trim(r["text"]) == ""), r["text"]).otherwise(_tagged(r["text"], F.array_position(others, F.struct(r["style"].alias("style"))))))
        return let(others, put)

    styles = lambda rs: F.array_distinct(F.transform(rs, lambda r: r["style"]))
    out = let(runs, lambda rs: let(styles(rs), lambda ss: let(main(rs, ss), lambda m: told(rs, ss, m))))
    return F.regexp_replace(F.array_join(out, ""), r"</g(\d+)><g\1>", "")


def _tagged(text: Column, tid: Column) -> Column:
    return let(tid.cast("string"), lambda t: F.concat(F.lit("<g"), t, F.lit(">"), text, F.lit("</g"), t, F.lit(">")))
