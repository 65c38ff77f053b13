"""Runs of paragraphs that are arrays of their rows."""

import random

from pyspark.sql import functions as F

from lexmill import queries
from lexmill.sources import segments


def plain(runs):
    styles = list(dict.fromkeys(s for s, _ in runs))
    size = {s: sum(len(t.strip(" ")) for x, t in runs if x == s) for s in styles}
    main = max(styles, key=lambda s: (size[s], -styles.index(s)))
    others, out, last = [s for s in styles if s != main], "", None
    for s, t in runs:
        tid = others.index(s) + 1 if s != main and t.strip(" ") else None
        if tid and tid == last:
            out = out.removesuffix(f"</g{tid}>") + f"{t}</g{tid}>"
        else:
            out += f"<g{tid}>{t}</g{tid}>" if tid else t
        last = tid if tid else (last if not t else None)
    return out


def test_arrays_and_tables_of_runs_agree(spark):
    r = random.Random(3)
    held = [[(r.choice(["a", "b", None, "c"]), r.choice(["x ", "long", " ", "", "y"])) for _ in range(r.randint(1, 9))] for _ in range(60)]
    table = [(p, i, s, t) for p, runs in enumerate(held) for i, (s, t) in enumerate(runs)]
    of_table = {x.para: x.source for x in segments.encoded_runs(spark.createDataFrame(table, "para int, seq int, style string, text string").repartition(5)).collect()}
    rows = spark.createDataFrame([(p, runs) for p, runs in enumerate(held)], "para int, runs array<struct<style:string,text:string>>")
    of_rows = {x.para: x.source for x in rows.select("para", segments.encoded(F.col("runs")).alias("source")).collect()}
    assert of_table == of_rows == {p: plain(runs) for p, runs in enumerate(held)}


def test_runs_of_a_line_are_not_dealt_out(spark):
    plan = queries.runs_encoded(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 1
