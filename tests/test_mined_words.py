"""Mining against a plain version, and what of a document it makes rows of."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lexmill import queries
from lexmill.operators import terms


def plain(rows):
    found = defaultdict(set)
    for doc, seg, text in rows:
        ws = [w for w in re.split(r"\s+", re.sub(terms.CUTS.replace(r"(?U:\s)", r"\s"), " | ", text or "")) if w]
        for i in range(len(ws)):
            for n in range(2, 6):
                g = ws[i : i + n]
                if len(g) == n and all(re.match(r"^[A-Za-z][A-Za-z\-]*\Z", w) for w in g):
                    g = [w.lower() for w in g]
                    if g[0] not in terms.STOP and g[-1] not in terms.STOP and any(len(w) >= 4 for w in g):
                        found[doc, " ".join(g)].add(seg)
    return {(doc, phrase, seg, len(segs)) for (doc, phrase), segs in found.items() if len(segs) >= 2 for seg in segs}


def test_mined_as_by_a_plain_version(spark):
    r = random.Random(7)
    words = ["feed", "water", "Pump", "of", "the", "an", "ab", "K", "ſafe", "x-ray", "é", "9", "and,", "(oil", "|", "-", "end.", "\n", "  ", "LINE"]
    rows = [(doc, f"{doc}/{i}", None if r.random() < 0.05 else " ".join(r.choices(words, k=r.randint(0, 12)))) for doc in (1, 2, None, 5) for i in range(25)]
    rows += [(9, "9/0", "one line with one line with one line"), (10, "10/0", ""), (11, "11/0", "two words"), (11, "11/1", "two words"), (11, "11/2", "two words")]
    out = terms.mined_english(spark.createDataFrame(rows, "doc_id long, seg_id string, source string"))
    got = [tuple(x) for x in out.select("doc_id", "phrase", "seg_id", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert (11, "two words", "11/0", 3) in got and not [x for x in got if x[0] == 9]


def test_only_words_that_recur_with_the_next_are_rows(spark, monkeypatch):
    """Rows of all words, and windows over them, took gigabytes in a task."""
    held = {}
    monkeypatch.setattr(terms, "materialize", lambda df, name: held.setdefault(name, df))
    out = terms.mined_english(queries.lines(spark, "/root/testdata/sf0.001"))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Window [") == 1 and plan.count("Exchange hashpartitioning") == 1
    ws = F.array(*[F.lit(w) for w in "a b c a b d a c b".split()], F.lit(None).cast("string"))
    assert spark.range(1).select(terms._recurring_pairs(ws).alias("at")).first().at == [0, 3]
